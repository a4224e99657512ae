"""Queries on answers of a language model, made from findings by a fixed recipe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assist as A
from ..operators import budget, diff
from ..operators import responses as R
from ..plans.store import stored
from ..sources import synthetic as S
from . import estimated, query, tokens_sql


def _responses(spark, sf):
    """One answer per diff: fenced JSON, JSON amid prose with a trailing comma, or loose braces."""
    item = F.to_json(F.struct("file", "line", F.col("message"), F.lit("high").alias("severity"), F.col("confidence")))
    per = S.findings(spark, sf).groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))), lambda x: x["i"]).alias("items"))
    joined = F.array_join("items", ",\n")
    content = F.when(F.expr("diff_id % 3 = 0"), F.concat(F.lit("```json\n["), joined, F.lit("]\n```"))).when(F.expr("diff_id % 3 = 1"), F.concat(F.lit("Found:\n["), joined, F.lit(",]\nDone"))).otherwise(F.concat(F.lit("I saw "), joined, F.lit(" there")))
    return per.select("diff_id", F.lit("security").alias("concern"), content.alias("content"))


@query("parse_response", "SELECT diff_id, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY seq) - 1 AS INT) AS pos, file, line, message, 3 AS severity, CASE WHEN confidence > 0 AND confidence <= 1 THEN confidence ELSE CAST(0.6 AS DOUBLE) END AS confidence FROM {f} t")
def parse_response(spark, sf):
    return R.findings(_responses(spark, sf)).select("diff_id", "pos", "file", "line", "message", "severity", "confidence")


@query("regex_findings", "SELECT diff_id, count(*) AS n, min(message) AS least FROM {f} t GROUP BY diff_id")
def regex_findings(spark, sf):
    rows = _responses(spark, sf).select("diff_id", F.explode(R.regex_items(F.col("content"))).alias("i"))
    return rows.groupBy("diff_id").agg(F.count("*").alias("n"), F.min("i.message").alias("least"))


@query("extract_json_array", "SELECT diff_id, diff_id % 3 <> 2 AS found FROM {f} t GROUP BY diff_id")
def extract_json_array(spark, sf):
    return _responses(spark, sf).select("diff_id", (R.json_array(F.col("content")) != "").alias("found"))


@query("extract_json_object", "SELECT diff_id, true AS found FROM {f} t GROUP BY diff_id")
def extract_json_object(spark, sf):
    return _responses(spark, sf).select("diff_id", F.startswith(R.json_object(F.col("content")), F.lit('{"file"')).alias("found"))


@query("lenient_json", "SELECT p_partkey, '{\"a\": \"x' || chr(92) || 'ny\", \"b\": [1, 2' || ']}' AS fixed FROM part")
def lenient_json(spark, sf):
    keys = S.table(spark, sf, "part").select("p_partkey")
    return keys.select("p_partkey", R.lenient_json(F.lit('// note\n{"a": "x\ny", "b": [1, 2,]}')).alias("fixed"))


@query("parse_filter_response", "SELECT diff_id, seq, severity > 1 AS confirmed, CAST(severity AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence, 'because ' || message AS reasoning FROM {f} t")
def parse_filter_response(spark, sf):
    text = F.format_string("CONFIRMED: %s\nCONFIDENCE: 0.%d\nREASONING: because %s", F.when(F.col("severity") > 1, "yes").otherwise("no"), "severity", "message")
    return S.findings(spark, sf).select("diff_id", "seq", R.filter_verdict(text).alias("v")).select("diff_id", "seq", "v.*")


@query("parse_reflect", "SELECT diff_id, seq, 'drop' AS action, severity AS score FROM {f} t")
def parse_reflect(spark, sf):
    text = F.format_string('```\n[{"index": 0, "action": "drop", "score": %d}]\n```', "severity")
    return S.findings(spark, sf).select("diff_id", "seq", F.explode(R.reflections(text)).alias("r")).select("diff_id", "seq", "r.action", "r.score")


@query(
    "reflect_prompt",
    f"""SELECT diff_id, 'Check these findings against the diff below.' || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || listed || chr(10) || '## Diff' || chr(10) || chr(10) || '```diff' || chr(10) || raw || '```' || chr(10) AS prompt FROM
    (SELECT diff_id, string_agg(i || '. [' || sev || '][' || concern || '] ' || file || ':' || line || ' \u2014 ' || message || chr(10) || CASE WHEN fix <> '' THEN '   Fix: ' || fix || chr(10) ELSE '' END, '' ORDER BY i) AS listed FROM (
      SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY seq) - 1 AS i, CASE severity WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS sev FROM {{f}} t) a GROUP BY diff_id) b
    JOIN (SELECT diff_id, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || string_agg(part, chr(10) ORDER BY hunk) AS raw FROM (
      SELECT diff_id, path, hunk, '@@ -' || old_start || ',' || count(*) FILTER (mark <> '+') || ' +' || new_start || ',' || count(*) FILTER (mark <> '-') || ' @@ part ' || hunk || chr(10) || string_agg(mark || text, chr(10) ORDER BY n) AS part
      FROM {{l}} t GROUP BY diff_id, path, hunk, old_start, new_start) u GROUP BY diff_id, path) c USING (diff_id)""",
)
def reflect_prompt(spark, sf):
    from ..operators.prompts import reflect_prompt

    return reflect_prompt(S.findings(spark, sf), S.diffs(spark, sf)).select("diff_id", "prompt")


@query("parse_eval", "SELECT p_partkey, 'case ' || CAST(p_partkey AS STRING) AS name, 'security' AS concern FROM part")
def parse_eval(spark, sf):
    text = F.format_string('{"name": "s", "cases": [{"name": "case %d", "diff": "", "expect_findings": [{"concern": "security"}], "deny_findings": []}]}', "p_partkey")
    got = S.table(spark, sf, "part").select("p_partkey", F.explode(R.eval_suite(text)).alias("c"))
    return got.select("p_partkey", "c.name", F.get("c.expect_findings", F.lit(0))["concern"].alias("concern"))


@query("review")
def review(spark, sf):
    from ..plans.review import Review, echo_provider

    return Review(provider=echo_provider).run(S.diffs(spark, sf)).select("diff_id", "rank", "concern", "severity", "file", "line", "message", "confidence", "sast_source")


@query("review_stats")
def review_stats(spark, sf):
    from ..plans.review import Review, echo_provider

    r = Review(provider=echo_provider)
    return r.stats(r.run(S.diffs(spark, sf)))


@query("filter_code_context", "SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(k - 5, 0) + 1 : least(k + 5, len(string_split(text, chr(10))))], chr(10)) AS context FROM (SELECT doc_id, text, CAST(doc_id % 9 AS INT) AS k FROM documents) t")
def filter_code_context(spark, sf):
    return S.documents(spark, sf).select("doc_id", A.code_context(F.col("text"), (F.col("doc_id") % 9).cast("int")).alias("context"))


@query(
    "relevant_diff",
    """SELECT diff_id, substr(string_agg(t, chr(10) ORDER BY hunk, n), 1, 500) AS part FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY hunk, n) AS k FROM (
    SELECT diff_id, hunk, n, mark || text AS t FROM {l} a UNION ALL SELECT diff_id, hunk, 0, '@@ -' || CAST(old_start AS STRING) || ',' || CAST(count(*) FILTER (WHERE mark <> '+') AS STRING) || ' +' || CAST(new_start AS STRING) || ',' ||
      CAST(count(*) FILTER (WHERE mark <> '-') AS STRING) || ' @@ part ' || CAST(hunk AS STRING) FROM {l} b GROUP BY diff_id, hunk, old_start, new_start) u) v WHERE k <= 8 GROUP BY diff_id""",
)
def relevant_diff(spark, sf):
    return S.diffs(spark, sf).select("diff_id", A.relevant_diff(F.col("raw"), F.expr(S.PATH), F.lit(3)).alias("part"))


@query("context_enrich", "SELECT diff_id, hunk AS hunk_idx, CAST(b AS INT) AS line FROM (SELECT DISTINCT diff_id, hunk, new_start FROM {l} t) h, generate_series(1, 3) g(k), LATERAL (SELECT new_start - k AS b) x WHERE b >= 1")
def context_enrich(spark, sf):
    return A.context_lines(diff.hunks(S.diffs(spark, sf))).select("diff_id", "hunk_idx", "line")


_OLD = "'old ' || CAST(k AS STRING) || ' of ' || CAST(diff_id AS STRING)"


@query(
    "context_enrich_text",
    f"""SELECT diff_id, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || string_agg(block || head || body, chr(10) ORDER BY hunk) AS enriched FROM (
      SELECT diff_id, path, hunk, '@@ -' || old_start || ',' || count(*) FILTER (mark <> '+') || ' +' || new_start || ',' || count(*) FILTER (mark <> '-') || ' @@ part ' || hunk || chr(10) AS head, string_agg(mark || text, chr(10) ORDER BY n) AS body,
        CASE WHEN hunk = 0 THEN chr(10) || '--- Context before (lines ' || greatest(1, old_start - 10) || '-' || (old_start - 1) || ') ---' || chr(10) ||
          list_aggregate(list_transform(generate_series(greatest(1, old_start - 10), old_start - 1), lambda k : '  ' || k || ' | ' || {_OLD} || chr(10)), 'string_agg', '') ELSE '' END AS block
      FROM {{l}} t GROUP BY diff_id, path, hunk, old_start, new_start) u GROUP BY diff_id, path""",
)
def context_enrich_text(spark, sf):
    """Files of 24 lines: the first hunk has lines before it, the second lies beyond the end."""
    d = stored(S.diffs(spark, sf), "context-diffs")
    code = F.expr(f"array_join(transform(sequence(1, 24), k -> {_OLD}), '\n')")
    return A.with_context(d, d.select("diff_id", F.expr(S.PATH).alias("path"), code.alias("content"))).select("diff_id", "enriched")


@query("parse_fix_response", "SELECT p_partkey, 'x := ' || CAST(p_partkey AS STRING) AS fixed_code, 'because' AS explanation FROM part WHERE p_partkey % 3 > 0")
def parse_fix_response(spark, sf):
    text = F.expr("case when p_partkey % 3 = 0 then 'sorry' else 'FIXED: x := ' || cast(p_partkey as string) || char(10) || 'EXPLANATION: because' end")
    return S.table(spark, sf, "part").select("p_partkey", A.parse_fix(text).alias("f")).where("f is not null").select("p_partkey", "f.fixed_code", "f.explanation")


@query("parse_improvements", "SELECT p_partkey, 'a' || CAST(p_partkey AS STRING) AS file FROM part")
def parse_improvements(spark, sf):
    text = F.format_string('[{"file": "a%d", "description": "d", "after": "x"}, {"file": "b", "description": "d"}]', "p_partkey")
    return S.table(spark, sf, "part").select("p_partkey", F.explode(A.parse_improvements(text)).alias("i")).select("p_partkey", "i.file")


@query("parse_description", "SELECT diff_id, CASE WHEN diff_id % 2 = 0 THEN 'T' ELSE 'Update ' || path END AS title, CASE WHEN diff_id % 2 = 0 THEN 'high' ELSE 'low' END AS risk FROM (SELECT DISTINCT diff_id, path FROM {l} t) u")
def parse_description(spark, sf):
    text = F.expr("""case when diff_id % 2 = 0 then '{"title": "T", "risk": "high"}' else 'none' end""")
    d = diff.files(S.diffs(spark, sf))
    return d.select("diff_id", A.parse_description(text, F.col("path"), F.lit("s")).alias("d")).select("diff_id", "d.title", "d.risk")


@query("fused_prompt", "SELECT diff_id, 'head' || chr(10) || section || chr(10) || '<diff_content>' AS prompt FROM (SELECT diff_id, string_agg('- ' || file || ':' || CAST(line AS STRING) || ' ' || message, chr(10) ORDER BY seq) AS section FROM {f} t WHERE sast_source GROUP BY diff_id) u")
def fused_prompt(spark, sf):
    from ..operators.prompts import sast_section

    rows = sast_section(S.findings(spark, sf).where("sast_source"))
    return rows.select("diff_id", A.fused_prompt(F.lit("head\n<diff_content>"), F.col("section")).alias("prompt"))


@query(
    "describe_truncate",
    f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY file_idx) AS k FROM ({estimated("SELECT doc_id % 50 AS diff_id, doc_id AS file_idx, coalesce(text, '') AS text FROM documents")}) t),
    steps AS (SELECT diff_id, CAST(0 AS BIGINT) AS file_idx, CAST(0 AS BIGINT) AS k, CAST(7 AS BIGINT) AS n, CAST(5 AS BIGINT) AS code, true AS fits FROM (SELECT DISTINCT diff_id FROM rows) d
      UNION ALL SELECT r.diff_id, r.file_idx, r.k, s.n + r.n, s.code + r.code, {tokens_sql("s.n", "s.code")} + r.tokens <= 4000 FROM steps s JOIN rows r ON r.diff_id = s.diff_id AND r.k = s.k + 1 WHERE s.fits)
    SELECT diff_id, file_idx FROM steps WHERE fits AND k > 0""",
)
def describe_truncate(spark, sf):
    docs = S.documents(spark, sf).select((F.col("doc_id") % 50).alias("diff_id"), F.col("doc_id").alias("file_idx"), "text")
    return budget.sections_within(docs, 4000).select("diff_id", "file_idx")


@query("filter_findings", "SELECT diff_id, seq, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY severity < 2 DESC, seq) AS INT) AS place FROM {f} t WHERE severity < 2 OR NOT contains(message, 'md5')")
def filter_findings(spark, sf):
    from ..operators.findings import gate
    from ..plans.review import ask

    f = S.findings(spark, sf)
    asked = f.withColumns({"code_context": F.lit(""), "system_prompt": F.lit("")}).withColumn("prompt", A.validation_prompt())
    answers = ask(asked.select("diff_id", "seq", "system_prompt", "prompt"), _doubtful)
    return gate(f, A.verdicts(answers)).select("diff_id", "seq", "place")


def _doubtful(system: str, prompt: str) -> str:
    return "CONFIRMED: no" if "md5" in prompt else "CONFIRMED: yes\nCONFIDENCE: 0.9"
