"""The queries op1 to op13 over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, importance, licenses, nbsvm, nnpu, packing, passages, pii, sentencepieces, simhash, telephony, training_order
from .common import release, stored, table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _fold(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def _classified(scored: DataFrame, held_out: F.Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), "doc_id")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.read(training_order.written(table(spark, sf_dir, "documents"), key=20240607)).drop("ids")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled PCM is a column of the result, and so stored wherever that is written."""
    return telephony.decode(stored(telephony.encode(table(spark, sf_dir, "documents")), "telephony-media"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nbsvm.fit(docs, labels.where(_fold(5) != 0).select("doc_id", F.col("quality").alias("label")))
    return _classified(model.score(docs, "doc_id"), _fold(5) == 0)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(passages.near_duplicates(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nnpu.fit(docs, labels.where(_fold(4) != 2).select("doc_id", F.col("toxic").alias("label")))
    return _classified(model.score(docs, "doc_id"), _fold(4) == 2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    kept = stored(weighed, "importance-weights")
    release(*weighed._parts)
    return importance.drawn(kept, percent=10, seed=2024, least=importance.features_of(20))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    out = stored(encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")), "sentencepiece-digests")
    release(*encoded._parts)
    return out


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that its base phrases decide."""
    return op1_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that its base patterns decide."""
    return op2_personal_data(spark, sf_dir).drop("spans")


def telephony_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that the payload read back decides."""
    return op6_telephony(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def _licenses_sql() -> str:
    base = [(t.label, t.words()) for t in licenses.TEMPLATES if t.base]
    found = " UNION ALL ".join(
        f"SELECT row, unnest(list_filter(range(0, len(w) - {len(phrase) - 1}), lambda i : {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase))})) AS pos, '{label}' AS label FROM words" for label, phrase in base
    )
    return f"""WITH words AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x : x <> '') AS w FROM documents), found AS ({found}),
    places AS (SELECT row, count(*) AS n, min(pos) AS a, max(pos) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS l FROM found GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM words LEFT JOIN places USING (row)""".replace("\\\\", "\\")


def _personal_data_sql() -> str:
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    doubled = "CAST(digits[len(digits) - i] AS INT) * (1 + i % 2)"
    luhn = f"list_sum(list_transform(range(0, len(digits)), lambda i : {doubled} - CASE WHEN {doubled} > 9 THEN 9 ELSE 0 END)) % 10 = 0"
    holds = {"email": "true", "ip": "list_max(list_transform(string_split(hit, '.'), lambda p : CAST(p AS HUGEINT))) <= 255", "card": f"len(digits) BETWEEN 12 AND 19 AND {luhn}", "phone": "len(digits) BETWEEN 9 AND 15"}
    hits = " UNION ALL ".join(
        f"SELECT row, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(h) + 1)) AS k, unnest(h) AS hit, g FROM (SELECT row, regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS g FROM texts) x WHERE len(h) > 0"
        for rank, (kind, p) in enumerate(patterns.items())
    )
    checks = " OR ".join(f"(kind = '{kind}' AND CASE WHEN kind = '{kind}' THEN {test} END)" for kind, test in holds.items())
    return f"""WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), hits AS ({hits}),
    placed AS (SELECT row, kind, rank, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, sum(len(g[k])) OVER w + coalesce(sum(len(hit)) OVER (PARTITION BY row, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM hits WINDOW w AS (PARTITION BY row, kind ORDER BY k)),
    good AS (SELECT row, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + len(hit) AS BIGINT) AS e FROM placed WHERE {checks}),
    spans AS (SELECT row, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)} FROM good GROUP BY row)
    SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in patterns)}, sha256(coalesce(spans, '')) AS base_sha256 FROM texts LEFT JOIN spans USING (row)"""


_TELEPHONY_SQL = f"""SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(t || repeat(' ', CAST(p - n AS INT))) AS payload_sha256
FROM (SELECT doc_id, t, n, greatest(1, (n + {telephony.UNIT - 1}) // {telephony.UNIT}) * {telephony.UNIT} AS p FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents) a) b"""

_TRANSLATED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DIVERGENCE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    found AS (SELECT row, lang, source, unnest(regexp_extract_all({_TRANSLATED.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, count(*) OVER (PARTITION BY g.lang, g.source) AS v
      FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    shares AS (SELECT lang, source, term, n, 1 + 1000000000 * (CAST(n AS HUGEINT) + 5) // (total + 5 * v) AS p FROM dense),
    whole AS (SELECT lang, term, 1 + 1000000000 * (CAST(n AS HUGEINT) + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= 50""".replace("\\\\", "\\")

_IMPORTANCE_WORDS = "regexp_extract_all(" + _TRANSLATED.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _importance_sql() -> str:
    """DuckDB has no crc32: bit by bit over the bytes of every distinct word, each step once for all bits of a byte by a table of 256."""
    table = "SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i : xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS step FROM (SELECT unnest(range(256)) AS b)"
    hashed = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(word) + 1), lambda i : CAST(('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS INT), 2)) AS BIGINT))), lambda c, b : xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""WITH steps AS (SELECT list(CAST(step AS BIGINT) ORDER BY b) AS steps FROM ({table})),
    docs AS (SELECT row_number() OVER () AS row, doc_id, {_IMPORTANCE_WORDS} AS w FROM documents),
    own AS (SELECT row, unnest(w) AS word FROM docs), there AS (SELECT unnest({_IMPORTANCE_WORDS}) AS word FROM benchmark),
    buckets AS (SELECT word, {hashed} % 10000 AS bucket FROM (SELECT word FROM own UNION SELECT word FROM there), steps),
    s AS (SELECT bucket, count(*) AS n FROM own JOIN buckets USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM there JOIN buckets USING (word) GROUP BY bucket),
    gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
    sums AS (SELECT row, sum(gain) AS gain, count(*) AS n FROM own JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row),
    scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(CAST(gain - (gain % n + n) % n AS BIGINT) // n, 0) AS BIGINT) AS weight, CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM docs LEFT JOIN sums USING (row)),
    placed AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_features >= 20) OVER () AS total FROM placed)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * total // 100 THEN r END AS rank FROM ranked""".replace("\\\\", "\\")


QUERIES = {"op1_licenses": op1_licenses, "op2_personal_data": op2_personal_data, "op3_training_order": op3_training_order, "op4_decontamination": op4_decontamination, "op5_packing": op5_packing, "op6_telephony": op6_telephony, "op7_quality": op7_quality, "op8_simhash": op8_simhash, "op9_passages": op9_passages, "op10_toxicity": op10_toxicity, "op11_divergence": op11_divergence, "op12_importance": op12_importance, "op13_sentencepiece": op13_sentencepiece,
    "licenses_base": licenses_base, "personal_data_base": personal_data_base, "telephony_payload": telephony_payload}
#: SQL says what the contracts' fixed rules decide; no SQL has the methods' own columns, hashes of words or token ids.
SQL: dict[str, str] = {"licenses_base": _licenses_sql(), "personal_data_base": _personal_data_sql(), "telephony_payload": _TELEPHONY_SQL, "op11_divergence": _DIVERGENCE_SQL, "op12_importance": _importance_sql()}
