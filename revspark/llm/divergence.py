"""How the sources of a language differ in their words: shares of all kept terms, compared pair by pair and term by term.

Tasks count terms in DuckDB and deal them by a hash of language and term to shards, packed into one row for each task
and shard. A shard sums its terms in DuckDB and keeps those in enough documents. With the totals that Spark sums
over shards, a second pass over the kept counts gives, in SQL, each shard's part of every pair's distance and its
highest terms of each source. Spark adds up parts and ranks.

A pair's sum needs no row for terms that a source lacks: such a term has the source's least share z, so that
sum |p - q| = V |za - zb| + sum over a's terms (|p - zb| - |za - zb|) + the same for b + sum over common terms
(|p - q| - |p - zb| - |za - q| + |za - zb|).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, stored
from .textvec import slices

LEAST_DOCUMENTS = 30
TOP = 50
#: Shares are whole numbers of this unit; so many occurrences are added to each term.
UNIT, ADDED = 1_000_000_000, 5
#: Rows of counts that a task holds before it sums them, and bytes of text that one statement reads.
HELD_ROWS, STEP = 4_000_000, 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
COUNTS = "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT"
SUMMED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"


def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
    con.execute(f"CREATE TABLE counts ({COUNTS})")
    return con


def _summed(con, most: int) -> None:
    """Sums the table of counts where it has grown beyond `most` rows."""
    if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > most:
        con.execute(f"CREATE TABLE less AS {SUMMED}")
        con.execute("DROP TABLE counts")
        con.execute("ALTER TABLE less RENAME TO counts")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def counted(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, payload): counts of (lang, source, term) and the number of documents with it, of each task, dealt by language and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        count = f"""INSERT INTO counts SELECT lang, source, term, sum(n), count(*) FROM (
            SELECT row, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM (
                SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS row FROM part)) GROUP BY row, term)
            GROUP BY lang, source, term"""

        def dealt() -> Iterator[pa.RecordBatch]:
            _summed(con, -1)
            con.execute(f"CREATE TABLE dealt AS SELECT CAST(hash(lang, term) % {shards} AS INTEGER) AS shard, * FROM counts ORDER BY shard, lang, term")
            for (shard,) in con.execute("SELECT DISTINCT shard FROM dealt ORDER BY shard").fetchall():
                got = con.sql(f"SELECT * EXCLUDE shard FROM dealt WHERE shard = {shard}").to_arrow_table()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_packed(got)], pa.binary())], ["shard", "payload"])
            con.execute("DROP TABLE dealt")
            con.execute("DELETE FROM counts")

        for batch in batches:
            for b in slices(batch, "text", STEP):
                con.register("part", pa.Table.from_batches([b]))
                con.execute(count)
                con.unregister("part")
                _summed(con, HELD_ROWS)
                if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > HELD_ROWS // 2:
                    yield from dealt()
        yield from dealt()
        con.close()

    return mapped(docs.select("text", "lang", "source"), run, "shard int, payload binary")


def kept(counts: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, lang, source, term, n): counts of the terms in at least `least` documents of their language; the rows without source are the language's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        of = None
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if of is not None and of != shard:
                    yield from out(con, of)
                of = shard
                con.register("part", _unpacked(payload))
                con.execute("INSERT INTO counts SELECT * FROM part")
                con.unregister("part")
                _summed(con, HELD_ROWS)
        if of is not None:
            yield from out(con, of)
        con.close()

    def out(con, shard: int) -> Iterator[pa.RecordBatch]:
        enough = f"SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= {least}"
        rows = f"SELECT CAST({shard} AS INTEGER) AS shard, lang, NULL AS source, term, n FROM enough UNION ALL SELECT {shard}, lang, source, term, CAST(sum(counts.n) AS BIGINT) FROM counts SEMI JOIN enough USING (lang, term) GROUP BY lang, source, term"
        yield from con.sql(f"WITH enough AS MATERIALIZED ({enough}) {rows}").to_arrow_table().cast(KEPT).to_batches()
        con.execute("DELETE FROM counts")

    return mapped(counts.repartitionById(shards, "shard").sortWithinPartitions("shard"), run, "shard int, lang string, source string, term string, n bigint")


KEPT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])

_SHARE = "CAST(1 + {unit} * (CAST({n} AS HUGEINT) + {added}) // (total + {added} * terms) AS BIGINT)"


def _share(n: str) -> str:
    return _SHARE.format(n=n, unit=UNIT, added=ADDED)


#: The shard's parts. kept: its rows; groups: lang, source (null: the whole language), total, terms, which are the kept terms of the language.
PARTS = f"""WITH shares AS MATERIALIZED (SELECT lang, source, term, n, {_share("n")} AS p, {_share("0")} AS z FROM kept JOIN groups USING (lang, source) WHERE source IS NOT NULL),
    whole AS (SELECT k.lang, k.term, {_share("n")} AS p FROM kept k JOIN groups g ON k.lang = g.lang AND k.source IS NULL AND g.source IS NULL),
    sources AS MATERIALIZED (SELECT lang, source, {_share("0")} AS z FROM groups WHERE source IS NOT NULL AND terms > 0),
    here AS (SELECT lang, count(*) AS terms FROM kept WHERE source IS NULL GROUP BY lang),
    levels AS MATERIALIZED (SELECT lang, source, z, p, count(*) AS times FROM shares GROUP BY ALL),
    differences AS (
        SELECT a.lang, a.source AS a, b.source AS b, h.terms * abs(a.z - b.z) AS d FROM sources a JOIN sources b ON a.lang = b.lang AND a.source < b.source JOIN here h ON h.lang = a.lang
        UNION ALL SELECT x.lang, least(x.source, y.source), greatest(x.source, y.source), x.times * (abs(x.p - y.z) - abs(x.z - y.z)) FROM levels x JOIN sources y ON x.lang = y.lang AND x.source <> y.source
        UNION ALL SELECT x.lang, x.source, y.source, abs(x.p - y.p) - abs(x.p - y.z) - abs(x.z - y.p) + abs(x.z - y.z) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source),
    highest AS (SELECT s.lang, s.source, s.term, s.p - w.p AS value FROM shares s JOIN whole w USING (lang, term) WHERE s.p > w.p
        QUALIFY row_number() OVER (PARTITION BY s.lang, s.source ORDER BY value DESC, s.term) <= {TOP})
    SELECT 'pair' AS part, lang, a AS source, b AS item, CAST(sum(d) AS BIGINT) AS value FROM differences GROUP BY lang, a, b
    UNION ALL SELECT 'term', lang, source, term, value FROM highest"""

_PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def parts(rows: DataFrame, shards: int) -> DataFrame:
    """Every shard's part of the pairs' sums and its highest terms. rows: shard, lang, source, term (null: a group), n (a group's total), terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.execute("CREATE TABLE rows (shard INTEGER, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, terms BIGINT)")
        con.execute("CREATE VIEW kept AS SELECT lang, source, term, n FROM rows WHERE term IS NOT NULL")
        con.execute("CREATE VIEW groups AS SELECT lang, source, n AS total, terms FROM rows WHERE term IS NULL")
        of = None
        for b in batches:
            for shard in dict.fromkeys(b.column(0).to_pylist()):
                if of is not None and of != shard:
                    yield from out(con)
                of = shard
                con.register("part", pa.Table.from_batches([b]))
                con.execute(f"INSERT INTO rows SELECT * FROM part WHERE shard = {shard}")
                con.unregister("part")
        if of is not None:
            yield from out(con)
        con.close()

    def out(con) -> Iterator[pa.RecordBatch]:
        yield from con.sql(PARTS).to_arrow_table().cast(_PARTS).to_batches()
        con.execute("DELETE FROM rows")

    return mapped(rows.repartitionById(shards, "shard").sortWithinPartitions("shard"), run, "part string, lang string, source string, item string, value bigint")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language, all its other sources by distance, and its TOP overrepresented terms.

    docs: text, lang, source, null ones empty. Kept terms are in `least` documents of the language or more. Rows that
    repeat count each; an empty table gives no rows; a source without terms takes part with none. Other columns are ignored.
    Ties go to the lesser item by bytes. There are as many shards as shuffle partitions; a task holds the terms of its shard.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms = stored(kept(counted(docs, shards), shards, least), "divergence-terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    whole = stored(totals.where("source is null"), "divergence-languages")
    found = docs.select("lang", "source").distinct().join(totals.where("source is not null").drop("terms"), ["lang", "source"], "left").join(whole.select("lang", "terms"), "lang", "left")
    groups = stored(found.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms")), "divergence-groups")
    every = groups.unionByName(whole).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    mine = stored(parts(terms.withColumn("terms", F.lit(None).cast("bigint")).unionByName(every), shards), "divergence-parts")
    half = mine.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    own = mine.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    out = pairs.unionByName(own).withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' or rank <= {TOP}")
    out._parts = terms, whole, groups, mine
    return out
