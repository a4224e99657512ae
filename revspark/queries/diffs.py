"""Queries on the parsing of diffs and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, diff
from ..sources import synthetic as S
from . import estimated, query

FLAGS = "CAST(false AS BOOLEAN) AS added, CAST(false AS BOOLEAN) AS deleted, CAST(false AS BOOLEAN) AS renamed"


@query("diff_parse", f"SELECT DISTINCT diff_id, 0 AS file_idx, path, path AS old_path, {FLAGS} FROM {{l}} t")
def diff_parse(spark, sf):
    return diff.files(S.diffs(spark, sf)).drop("binary", "chunk")


@query(
    "diff_hunks",
    """SELECT diff_id, 0 AS file_idx, hunk AS hunk_idx, old_start, CAST(count(*) FILTER (WHERE mark <> '+') AS INT) AS old_count, new_start,
    CAST(count(*) FILTER (WHERE mark <> '-') AS INT) AS new_count, 'part ' || CAST(hunk AS STRING) AS header FROM {l} t GROUP BY diff_id, hunk, old_start, new_start""",
)
def diff_hunks(spark, sf):
    return diff.hunks(S.diffs(spark, sf)).drop("path", "body")


@query(
    "hunk_header",
    """SELECT k, CASE WHEN k % 4 = 3 THEN 0 ELSE k END AS old_start, CASE k % 4 WHEN 1 THEN 1 WHEN 3 THEN 0 ELSE 7 END AS old_count, CASE WHEN k % 4 = 3 THEN 0 ELSE k + 2 END AS new_start,
    CASE k % 4 WHEN 0 THEN 9 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END AS new_count, CASE k % 4 WHEN 0 THEN 'func a' WHEN 1 THEN '' WHEN 2 THEN 'x @@ y' ELSE '@@ broken' END AS header
    FROM (SELECT DISTINCT CAST(p_partkey AS INT) AS k FROM part) t""",
)
def hunk_header(spark, sf):
    k = F.col("k").cast("string")
    line = F.when(F.expr("k % 4 = 0"), F.concat(F.lit("@@ -"), k, F.lit(",7 +"), (F.col("k") + 2).cast("string"), F.lit(",9 @@ func a")))
    line = line.when(F.expr("k % 4 = 1"), F.concat(F.lit("@@ -"), k, F.lit(" +"), (F.col("k") + 2).cast("string"), F.lit(" @@")))
    line = line.when(F.expr("k % 4 = 2"), F.concat(F.lit("@@ +"), (F.col("k") + 2).cast("string"), F.lit(",-3 -"), k, F.lit(",7 @@ x @@ y"))).otherwise("@@ broken")
    keys = S.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("k")).distinct()
    return keys.select("k", diff.hunk_header(line).alias("h")).select("k", "h.*")


@query(
    "hunk_lines",
    """SELECT diff_id, hunk AS hunk_idx, CAST(row_number() OVER (PARTITION BY diff_id, hunk ORDER BY n) - 1 AS INT) AS line_idx, CASE mark WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 0 END AS type,
    text AS content, CAST(CASE WHEN mark = '+' THEN 0 ELSE rel_old END AS INT) AS old_num, CAST(CASE WHEN mark = '-' THEN 0 ELSE rel_new END AS INT) AS new_num,
    CAST(CASE WHEN mark <> '-' THEN new_start - 1 + rel_new END AS INT) AS abs_new FROM {l} t""",
)
def hunk_lines(spark, sf):
    return diff.lines(S.diffs(spark, sf)).drop("file_idx", "path")


ADDED = "SELECT diff_id, path AS file, CAST(new_start - 1 + rel_new AS INT) AS line, text FROM {l} t WHERE mark = '+'"


@query("diff_added_scan", ADDED)
def diff_added_scan(spark, sf):
    return diff.added_lines(S.diffs(spark, sf)).drop("seq")


@query("taint_diff_scan", "SELECT diff_id, path AS file, CAST(new_start - 1 + rel_new AS INT) AS line, CASE mark WHEN '+' THEN text ELSE ' ' || text END AS text, mark = '+' AS added FROM {l} t WHERE mark <> '-'")
def taint_diff_scan(spark, sf):
    return diff.new_side(S.diffs(spark, sf)).where("file <> ''").drop("seq")


@query("raw_added_scan", "SELECT diff_id, CAST(n + 3 + hunk AS INT) AS pos, text FROM {l} t WHERE mark = '+'")
def raw_added_scan(spark, sf):
    return diff.raw_added(S.diffs(spark, sf))


@query("hunk_new_start", "SELECT DISTINCT diff_id, hunk, new_start FROM {l} t")
def hunk_new_start(spark, sf):
    rows = diff.hunks(S.diffs(spark, sf))
    line = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count")
    return rows.select("diff_id", F.col("hunk_idx").alias("hunk"), diff.hunk_new_start(line).alias("new_start"))


@query("source_lines", "SELECT doc_id, CAST(line AS INT) AS line, text FROM {dl} t")
def source_lines(spark, sf):
    docs = S.documents(spark, sf).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return diff.source_lines(docs).withColumnRenamed("path", "doc_id")


@query("file_line_range", "SELECT doc_id, CAST(line AS INT) AS line, text FROM {dl} t WHERE line BETWEEN 2 AND 4")
def file_line_range(spark, sf):
    docs = S.documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return diff.line_range(docs, 2, 4).select(F.col("path").cast("long").alias("doc_id"), "line", "text")


@query("combine_changes", "SELECT diff_id, string_agg(CASE WHEN mark = ' ' THEN '' ELSE text || chr(10) END, '' ORDER BY n) AS raw FROM {l} t GROUP BY diff_id")
def combine_changes(spark, sf):
    rows = S.line_items(spark, sf)
    text = F.when(F.col("mark") == " ", "").when(F.col("mark") == "+", F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return diff.combine(rows.select("diff_id", F.col("n").alias("seq"), text.alias("diff")))


@query(
    "diff_summary",
    """SELECT *, CAST(files AS STRING) || ' files changed, ' || CAST(insertions AS STRING) || ' insertions(+), ' || CAST(deletions AS STRING) || ' deletions(-)' AS summary FROM (
    SELECT diff_id, CAST(1 AS BIGINT) AS files, count(*) FILTER (WHERE mark = '+') AS insertions, count(*) FILTER (WHERE mark = '-') AS deletions FROM {l} t GROUP BY diff_id) s""",
)
def diff_summary(spark, sf):
    return diff.summary(S.diffs(spark, sf))


@query("language_histogram", "SELECT diff_id, regexp_extract(path, '\\.[^.]*$') AS ext, CAST(1 AS BIGINT) AS n, CAST(1 AS INT) AS rank FROM {l} t GROUP BY diff_id, path")
def language_histogram(spark, sf):
    return diff.language_histogram(diff.files(S.diffs(spark, sf)))


@query(
    "primary_languages",
    """SELECT ext, n, CAST(row_number() OVER (ORDER BY n DESC, ext) AS INT) AS rank FROM (SELECT regexp_extract(path, '\\.[^.]*$') AS ext, count(DISTINCT diff_id) AS n FROM {l} t GROUP BY 1) s""",
)
def primary_languages(spark, sf):
    every = diff.files(S.diffs(spark, sf)).withColumn("diff_id", F.lit(0).cast("long"))
    return diff.language_histogram(every).drop("diff_id")


@query("hunk_count", "SELECT count(DISTINCT diff_id * 2 + hunk) AS hunks, count(DISTINCT path) AS files_reviewed FROM {l} t WHERE diff_id % 5 <> 4")
def hunk_count(spark, sf):
    from ..operators.rules import excluded

    kept = diff.hunks(S.diffs(spark, sf)).where(~excluded(F.col("path")))
    return kept.agg(F.count("*").alias("hunks"), F.countDistinct("path").alias("files_reviewed"))


def _sized(spark, sf):
    return budget.file_tokens(diff.files(S.diffs(spark, sf)))


@query(
    "file_tokens",
    f"""SELECT diff_id, 0 AS file_idx, path, CAST(false AS BOOLEAN) AS deleted, CAST(p + 20 + 10 * hunks + lines AS BIGINT) AS tokens FROM
    (SELECT diff_id, count(DISTINCT hunk) AS hunks, sum(tokens + 1) AS lines FROM ({estimated("SELECT diff_id, hunk, text FROM {l} t")}) a GROUP BY diff_id) x
    JOIN (SELECT diff_id, text AS path, tokens AS p FROM ({estimated("SELECT DISTINCT diff_id, path AS text FROM {l} t")}) b) y USING (diff_id)""",
)
def file_tokens(spark, sf):
    return _sized(spark, sf)


def _corpus(spark, sf):
    """Files of one large change: customers stand for changes, orders for their files."""
    sized = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("diff_id"), F.col("o_orderkey").alias("file_idx"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("tokens"), (F.col("o_orderstatus") == "F").alias("deleted"))
    return sized


@query(
    "chunk_files",
    """WITH RECURSIVE rows AS MATERIALIZED (SELECT o_custkey AS diff_id, o_orderkey AS file_idx, CAST(floor(o_totalprice / 1000) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    steps AS (SELECT diff_id, file_idx, tokens, k, tokens AS used, 0 AS chunk FROM rows WHERE k = 1
      UNION ALL SELECT r.diff_id, r.file_idx, r.tokens, r.k, CASE WHEN s.used + r.tokens > 400 THEN r.tokens ELSE s.used + r.tokens END, CASE WHEN s.used + r.tokens > 400 THEN s.chunk + 1 ELSE s.chunk END
      FROM steps s JOIN rows r ON r.diff_id = s.diff_id AND r.k = s.k + 1) SELECT diff_id, file_idx, tokens, chunk FROM steps""",
)
def chunk_files(spark, sf):
    return budget.chunk(_corpus(spark, sf).drop("deleted"), 400)


@query(
    "truncate_files",
    """SELECT diff_id, file_idx, tokens, deleted FROM (SELECT *, sum(tokens) OVER w AS s, row_number() OVER w AS n FROM (
      SELECT o_custkey AS diff_id, o_orderkey AS file_idx, CAST(floor(o_totalprice / 1000) AS BIGINT) AS tokens, o_orderstatus = 'F' AS deleted FROM orders) t WHERE NOT deleted
      WINDOW w AS (PARTITION BY diff_id ORDER BY file_idx)) u WHERE s <= 400 OR n = 1""",
)
def truncate_files(spark, sf):
    return budget.truncate_files(_corpus(spark, sf), 400)


@query(
    "truncate_memory",
    """SELECT key, pos, content FROM (SELECT *, sum(strlen(content)) OVER (PARTITION BY key ORDER BY pos) AS s FROM (
      SELECT conv_id AS key, turn AS pos, text AS content FROM conversations WHERE text <> '') t) u WHERE s <= 800""",
)
def truncate_memory(spark, sf):
    rows = S.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return budget.truncate_memory(rows, 200)
