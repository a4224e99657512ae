"""Review relations derived from the order tables, for queries that need diffs and findings.

One order is one diff and one line item one line of it. The same SQL text builds the lines in
Spark and, in oracles, elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A line's mark and text, by its line item.
MARK = "CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END"
TEXT = """CASE l_linenumber
      WHEN 1 THEN CASE WHEN l_partkey % 3 = 0 THEN 'func h' || CAST(l_partkey AS STRING) || '(name string, r *http.Request) error'
                  ELSE 'q := fmt.Sprintf("SELECT * FROM t WHERE id = %s", p' || CAST(l_partkey AS STRING) || ')' END
      WHEN 2 THEN CASE WHEN l_partkey % 4 = 0 THEN 'cmd := exec.Command(name)' ELSE 'cmd := exec.Command(p' || CAST(l_partkey AS STRING) || ')' END
      WHEN 3 THEN 'password := "pw' || CAST(l_partkey AS STRING) || 'zz"'
      WHEN 4 THEN 'defer f' || CAST(l_partkey AS STRING) || '.Close()'
      WHEN 5 THEN CASE WHEN l_partkey % 3 = 0 THEN 'h := md5.New() // cache key' ELSE 'h := md5.New()' END
      WHEN 6 THEN '// TODO fix auth ' || CAST(l_partkey AS STRING)
      ELSE 'rows, err := db.Query("select " + name)' END"""

#: Lines of diffs: (diff_id, n, mark, text, part, hunk, pos), n from 1 within the diff; hunks have four lines, the last the rest.
LINES = f"""
SELECT diff_id, n, mark, text, part, CASE WHEN n <= 4 THEN 0 ELSE 1 END AS hunk FROM (
  SELECT l_orderkey AS diff_id, l_partkey AS part,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS n,
    {MARK} AS mark,
    {TEXT} AS text
  FROM lineitem) t
"""

#: File name and first line numbers of a diff, by diff_id.
PATH = "'svc/order_' || CAST(diff_id AS STRING) || CASE diff_id % 5 WHEN 2 THEN '.py' WHEN 3 THEN '.js' WHEN 4 THEN '.min.js' ELSE '.go' END"
OLD_START = "CAST(10 + diff_id % 5 + 90 * hunk AS INT)"
NEW_START = "CAST(10 + diff_id % 7 + 100 * hunk AS INT)"

#: Findings: one per line that isn't a context line, with repeats of message, severities from 0 to 4 and gaps.
FINDINGS = f"""
SELECT diff_id, CAST(n AS BIGINT) AS seq,
  CASE part % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'correctness' WHEN 2 THEN 'static:security' ELSE 'performance' END AS concern,
  CAST(part % 5 AS INT) AS severity, {PATH} AS file, CAST(10 + diff_id % 7 + n * (part % 3) AS INT) AS line,
  CAST(CASE WHEN part % 2 = 0 THEN 0 ELSE 10 + diff_id % 7 + n * (part % 3) + part % 4 END AS INT) AS end_line,
  CASE part % 7 WHEN 0 THEN 'Possible SQL injection in query' WHEN 1 THEN 'hardcoded secret in code' WHEN 2 THEN 'Weak hash md5 used for password'
    WHEN 3 THEN 'path traversal through user input' WHEN 4 THEN 'unchecked error return' WHEN 5 THEN 'possible sql injection in the query' ELSE 'data race on shared map' END AS message,
  CASE part % 6 WHEN 0 THEN 'use placeholders' WHEN 1 THEN 'x := clean(x)' WHEN 2 THEN '' WHEN 3 THEN 'return err' ELSE 'add a check' END AS fix,
  CASE WHEN part % 5 = 0 THEN 'because input reaches it' ELSE '' END AS reasoning,
  CASE part % 8 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-798' WHEN 2 THEN 'CWE-327' ELSE '' END AS cwe,
  CAST(part % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence, part % 3 = 0 AS sast_source
FROM ({LINES}) l WHERE mark <> ' '
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LINES)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FINDINGS)


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, raw): unified diffs with one file and one or two hunks each."""
    # Line items stay narrow until they are in order: their texts are made within the diff's row. One shuffle, no window.
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("diff_id"), F.struct(*order).alias("item")).repartition("diff_id")
    text = reduce(lambda t, c: t.replace(c, f"x.{c}"), order, f"({MARK}) || ({TEXT})")
    per = items.groupBy("diff_id").agg(F.sort_array(F.collect_list("item")).alias("items")).select("diff_id", F.expr(f"transform(items, x -> {text})").alias("rows"))
    path = F.expr(PATH)

    def hunk(k: int) -> F.Column:
        mine = F.slice("rows", 1, 4) if k == 0 else F.slice("rows", F.lit(5), F.size("rows"))

        def side(other: str) -> F.Column:
            return F.size(F.filter(mine, lambda r: ~F.startswith(r, F.lit(other))))

        old, new = F.expr(OLD_START.replace("hunk", str(k))), F.expr(NEW_START.replace("hunk", str(k)))
        head = F.format_string("@@ -%d,%d +%d,%d @@ part %d", old, side("+"), new, side("-"), F.lit(k))
        return F.when(F.size("rows") > 4 * k, F.concat(F.lit("\n"), head, F.lit("\n"), F.array_join(mine, "\n"))).otherwise("")

    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path)
    return per.select("diff_id", F.concat(head, hunk(0), hunk(1)).alias("raw"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name)
