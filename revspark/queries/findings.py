"""Queries on the algebra of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff
from ..operators import findings as O
from ..operators import reports, similar
from ..sources import git
from ..sources import synthetic as S
from . import literal, query

_SEV = "CASE severity WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END"


def _f(spark, sf):
    return S.findings(spark, sf)


def _sides(spark, sf):
    """Scanner's and model's findings."""
    f = _f(spark, sf)
    return f.where("sast_source"), f.where("not sast_source")


@query("exact_dedup", "SELECT diff_id, seq, file, line, message FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, file, line, message ORDER BY seq) AS n FROM {f} t) u WHERE n = 1")
def exact_dedup(spark, sf):
    return O.exact_dedup(_f(spark, sf)).select("diff_id", "seq", "file", "line", "message")


@query("document_exact_dedup", "SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def document_exact_dedup(spark, sf):
    return S.documents(spark, sf).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_WORDS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(concern || ' ' || message), '\\s+'), lambda w : trim(w, '.,;:!?\"''()[]{}')), lambda w : w <> ''))"


_LEADER = "{'seq': x.seq, 'file': x.file, 'line': x.line, 'w': x.w}"
_TAKES = """((len(l.w) = 0 AND len(x.w) = 0) OR (len(l.w) > 0 AND len(x.w) > 0 AND CAST(len(list_intersect(l.w, x.w)) AS DOUBLE) / CAST(len(list_distinct(list_concat(l.w, x.w))) AS DOUBLE) >= 0.8))
      AND (l.file <> x.file OR abs(l.line - x.line) <= 5)"""


@query(
    "near_dedup",
    f"""WITH RECURSIVE rows AS (SELECT diff_id, seq, file, line, confidence, {_WORDS} AS w, row_number() OVER (PARTITION BY diff_id ORDER BY seq) AS k FROM {{f}} t),
    steps AS (SELECT diff_id, k, seq, confidence, seq AS lead, [{_LEADER}] AS leaders FROM rows x WHERE k = 1
      UNION ALL SELECT diff_id, k, seq, confidence, coalesce(hit, seq), CASE WHEN hit IS NULL THEN list_append(leaders, me) ELSE leaders END FROM (
        SELECT x.diff_id, x.k, x.seq, x.confidence, s.leaders, {_LEADER} AS me, list_min(list_transform(list_filter(s.leaders, lambda l : {_TAKES}), lambda l : l.seq)) AS hit FROM steps s JOIN rows x ON x.diff_id = s.diff_id AND x.k = s.k + 1) y),
    marked AS (SELECT diff_id, seq, lead, count(*) OVER (PARTITION BY diff_id, lead) AS n, row_number() OVER (PARTITION BY diff_id, lead ORDER BY confidence DESC, seq) AS place FROM steps)
    SELECT diff_id, seq, CASE WHEN n > 1 THEN lead END AS group_id, n > 1 AND place = 1 AS is_rep, place = 1 AS is_unique FROM marked""",
)
def near_dedup(spark, sf):
    return similar.near_dedup(_f(spark, sf)).select("diff_id", "seq", "group_id", "is_rep", "is_unique")


@query(
    "word_jaccard_pairs",
    f"""WITH w AS (SELECT diff_id, seq, {_WORDS} AS w FROM {{f}} t) SELECT diff_id, a, b, similarity FROM (SELECT x.diff_id, x.seq AS a, y.seq AS b,
    CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / CAST(len(list_distinct(list_concat(x.w, y.w))) AS DOUBLE) AS similarity FROM w x JOIN w y ON x.diff_id = y.diff_id AND x.seq < y.seq) p WHERE similarity >= 0.8""",
)
def word_jaccard_pairs(spark, sf):
    return similar.similar_pairs(_f(spark, sf))


def _overlap(a: str, b: str) -> str:
    from ..functions.text import STOP_WORDS

    def words(m: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({m}), '[ ,.:;()\\[\\]\"''\\-_/\\\\]+'), lambda w : strlen(w) >= 3 AND NOT list_contains([{', '.join(map(literal, STOP_WORDS))}], w))"

    x, y = words(a), words(b)
    return f"(len({x}) > 0 AND len({y}) > 0 AND len(list_filter({x}, lambda w : list_contains({y}, w))) >= least(len({x}), len({y})) * CAST(0.4 AS DOUBLE))"


@query("message_overlap", f"SELECT DISTINCT x.message AS a, y.message AS b, {_overlap('x.message', 'y.message')} AS overlap FROM (SELECT DISTINCT message FROM {{f}} t) x, (SELECT DISTINCT message FROM {{f}} t) y")
def message_overlap(spark, sf):
    m = _f(spark, sf).select("message").distinct()  # seven texts, each with each
    pairs = m.select(F.col("message").alias("a"), F.lit(1).alias("k")).join(m.select(F.col("message").alias("b"), F.lit(1).alias("k")), "k")
    return pairs.select("a", "b", O.message_overlap(F.col("a"), F.col("b")).alias("overlap"))


def _fusion_sql(kind: str) -> str:
    mine, theirs = ("{}.seq % 2 = 0", "{}.seq % 2 = 1") if kind != "beside" else ("{}.seq % 2 = 1", "{}.seq % 2 = 0")
    test = _overlap("s.message", "o.message")
    test = f"NOT {test}" if kind == "beside" else test
    exists = f"EXISTS (SELECT 1 FROM {{f}} o WHERE ({theirs.format('o')}) AND o.diff_id = s.diff_id AND o.file = s.file AND o.line = s.line AND {test})"
    return f"SELECT diff_id, seq, message FROM {{f}} s WHERE ({mine.format('s')}) AND {'NOT ' if kind == 'dismissed' else ''}{exists}"


def _parties(spark, sf):
    """Findings taken in turn as the scanner's and the model's, so that places coincide."""
    f = _f(spark, sf)
    return f.where("seq % 2 = 0"), f.where("seq % 2 = 1")


@query("fusion_confirmed", _fusion_sql("confirmed"))
def fusion_confirmed(spark, sf):
    return O.fusion(*_parties(spark, sf))[0].select("diff_id", "seq", "message")


@query("fusion_dismissed", _fusion_sql("dismissed"))
def fusion_dismissed(spark, sf):
    return O.fusion(*_parties(spark, sf))[1].select("diff_id", "seq", "message")


@query("fusion_unaddressed", _fusion_sql("beside"))
def fusion_unaddressed(spark, sf):
    return O.fusion(*_parties(spark, sf))[2].select("diff_id", "seq", "message")


_HUNKS = "(SELECT diff_id, path, hunk, new_start AS s, new_start + CAST(count(*) FILTER (WHERE mark <> '-') AS INT) AS e FROM {l} h GROUP BY diff_id, path, hunk, new_start)"


@query("comment_map_added", f"SELECT diff_id, seq, line FROM {{f}} t WHERE EXISTS (SELECT 1 FROM {_HUNKS} h WHERE h.diff_id = t.diff_id AND h.path = t.file AND t.line >= h.s AND t.line < h.e)")
def comment_map_added(spark, sf):
    return O.comment_map(_f(spark, sf), diff.hunks(S.diffs(spark, sf))).select("diff_id", "seq", "line")


@query(
    "comment_map_context",
    f"""SELECT diff_id, seq, line FROM {{f}} t WHERE EXISTS (SELECT 1 FROM {_HUNKS} h WHERE h.diff_id = t.diff_id AND h.path = t.file AND t.line >= h.s AND t.line < h.e)
    OR EXISTS (SELECT 1 FROM {{l}} x WHERE x.diff_id = t.diff_id AND ((x.mark <> '-' AND x.rel_new = t.line) OR (x.mark <> '+' AND x.rel_old = t.line)))""",
)
def comment_map_context(spark, sf):
    d = S.diffs(spark, sf)
    return O.comment_map(_f(spark, sf), diff.hunks(d), diff.lines(d), "context").select("diff_id", "seq", "line")


@query("comment_map_file", "SELECT diff_id, seq, line FROM {f} t WHERE EXISTS (SELECT 1 FROM {l} x WHERE x.diff_id = t.diff_id AND x.path = t.file)")
def comment_map_file(spark, sf):
    return O.comment_map(_f(spark, sf), diff.hunks(S.diffs(spark, sf)), mode="file").select("diff_id", "seq", "line")


_CODE = "regexp_matches(fix, ':=|func |if |for |return |\\{|\\}|//|import|var |const ')"


@query(
    "inline_comments",
    f"""SELECT diff_id, seq, file AS path, line AS start_line, end_line, '**[' || upper({_SEV}) || ']** ' || message || chr(10) || CASE WHEN reasoning <> '' THEN chr(10) || '> ' || reasoning || chr(10) ELSE '' END
    || CASE WHEN fix <> '' AND NOT {_CODE} THEN chr(10) || '**Fix:** ' || fix || chr(10) ELSE '' END AS body, CASE WHEN fix <> '' AND {_CODE} THEN fix ELSE '' END AS suggestion FROM {{f}} t""",
)
def inline_comments(spark, sf):
    return O.comments(_f(spark, sf))


@query(
    "filter_gate",
    """SELECT diff_id, seq, severity < 2 AS passed_through, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY severity >= 2, seq) AS INT) AS place FROM {f} t
    WHERE severity < 2 OR (CASE WHEN seq % 3 = 0 THEN false ELSE CASE seq % 3 WHEN 1 THEN line % 2 = 0 ELSE true END AND CASE seq % 3 WHEN 1 THEN confidence ELSE CAST(0.9 AS DOUBLE) END >= CAST(0.6 AS DOUBLE) END)""",
)
def filter_gate(spark, sf):
    f = _f(spark, sf)
    verdicts = f.where("seq % 3 <> 0").select("diff_id", "seq", F.expr("case seq % 3 when 1 then line % 2 = 0 else true end").alias("confirmed"), F.expr("case seq % 3 when 1 then confidence else 0.9D end").alias("confidence"))
    return O.gate(f, verdicts).select("diff_id", "seq", "passed_through", "place")


@query(
    "apply_reflection",
    f"""SELECT diff_id, seq, CASE WHEN p % 4 = 1 THEN 3 ELSE severity END AS severity, CASE WHEN p % 4 IN (1, 2) THEN 'new ' || CAST(p AS STRING) ELSE message END AS message FROM (
    SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY seq) - 1 AS p FROM {{f}} t) u WHERE p % 4 <> 0 AND NOT (p % 4 <> 3 AND p % 5 > 0 AND p % 5 < 3)""",
)
def apply_reflection(spark, sf):
    f = _f(spark, sf)
    n = f.groupBy("diff_id").agg(F.count("*").alias("n")).select("diff_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("index"))
    v = n.where("index % 4 <> 3").select("diff_id", "index", F.lit(1).alias("pos"), F.expr("case index % 4 when 0 then 'drop' when 1 then 'adjust' else 'keep' end").alias("action"), F.lit("high").alias("severity"), F.expr("index % 5").alias("score"), F.concat(F.lit("new "), F.col("index").cast("string")).alias("message"))
    stale = v.withColumns({"pos": F.lit(0), "action": F.lit("drop")})
    return O.reflect(f, v.unionByName(stale), 3).select("diff_id", "seq", "severity", "message")


@query(
    "llm_confidence_join",
    """SELECT t.diff_id, t.seq, coalesce((SELECT min_by(i.confidence, i.seq) FROM {f} i WHERE i.sast_source AND i.confidence > 0 AND i.confidence <= 1 AND i.diff_id = t.diff_id AND i.file = t.file AND i.line = t.line), CAST(0.6 AS DOUBLE)) AS model_conf FROM {f} t""",
)
def llm_confidence_join(spark, sf):
    f = _f(spark, sf)
    items = f.where("sast_source").select("diff_id", F.col("seq").alias("pos"), "file", "line", "confidence")
    return O.model_confidence(f, items).select("diff_id", "seq", "model_conf")


@query("default_llm_conf", "SELECT diff_id, seq, CASE WHEN confidence > 0 AND confidence <= 1 THEN confidence ELSE CAST(0.6 AS DOUBLE) END AS confidence FROM {f} t")
def default_llm_conf(spark, sf):
    return _f(spark, sf).select("diff_id", "seq", O.default_confidence(F.col("confidence")).alias("confidence"))


@query("severity_at_least", "SELECT diff_id, seq, severity FROM {f} t WHERE severity >= 3")
def severity_at_least(spark, sf):
    return O.at_least(_f(spark, sf), "high").select("diff_id", "seq", "severity")


@query("max_severity_failed", "SELECT diff_id, max(severity) AS max_severity, bool_or(severity >= 4) AS failed FROM {f} t GROUP BY diff_id")
def max_severity_failed(spark, sf):
    return O.failed(_f(spark, sf), 4)


@query("parse_severity", "SELECT o_orderkey, CASE lower(trim(substr(o_orderpriority, 3))) WHEN 'urgent' THEN 0 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity FROM orders")
def parse_severity(spark, sf):
    return S.table(spark, sf, "orders").select("o_orderkey", O.parse_severity(F.expr("substr(o_orderpriority, 3)")).alias("severity"))


@query("confidence_bands", "SELECT diff_id, CASE WHEN confidence >= CAST(0.7 AS DOUBLE) THEN 'high' WHEN confidence >= CAST(0.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band, count(*) AS n, min(seq) AS first_seq FROM {f} t GROUP BY 1, 2")
def confidence_bands(spark, sf):
    return _f(spark, sf).groupBy("diff_id", O.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("confidence_stats", "SELECT concern, floor(sum(k) / CAST(10 AS DOUBLE) / count(*) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS avg_confidence, count(*) FILTER (WHERE k >= 7) AS high, count(*) FILTER (WHERE k < 5) AS low FROM (SELECT concern, round(confidence * 10) AS k FROM {f} t) u GROUP BY concern")
def confidence_stats(spark, sf):
    return O.confidence_stats(_f(spark, sf), "concern")


@query("stats_by_severity", "SELECT diff_id, severity, concern, count(*) AS n FROM {f} t GROUP BY GROUPING SETS ((diff_id, severity), (diff_id, concern), (diff_id))")
def stats_by_severity(spark, sf):
    return O.counts(_f(spark, sf))


@query("severity_rollup", "SELECT concern, severity, count(*) AS n FROM {f} t GROUP BY ROLLUP (concern, severity)")
def severity_rollup(spark, sf):
    return _f(spark, sf).rollup("concern", "severity").agg(F.count("*").alias("n"))


@query("rank_findings", "SELECT diff_id, seq, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY severity DESC, file, line, seq) AS INT) AS rank FROM {f} t")
def rank_findings(spark, sf):
    return O.ranked(_f(spark, sf)).select("diff_id", "seq", "rank")


@query("union_findings", "SELECT diff_id, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY CASE WHEN sast_source THEN 0 ELSE 1 END, seq) AS BIGINT) AS seq, message FROM {f} t")
def union_findings(spark, sf):
    return O.union(*_sides(spark, sf)).select("diff_id", "seq", "message")


_EXPECT = "(SELECT diff_id AS case_id, CAST(x AS INT) AS exp_id, CASE x WHEN 1 THEN 'SECURITY' ELSE '' END AS concern, CASE x WHEN 2 THEN 'high' ELSE '' END AS min_severity, CASE x WHEN 3 THEN 'SQL Injection' ELSE '' END AS message_contains, '' AS file FROM (SELECT DISTINCT diff_id FROM {f} a) d, generate_series(1, 3) g(x))"


@query(
    "eval_expectations",
    f"""SELECT case_id, exp_id, EXISTS (SELECT 1 FROM {{f}} t WHERE t.diff_id = e.case_id AND (e.concern = '' OR lower(e.concern) = t.concern) AND (e.min_severity = '' OR t.severity >= 3)
    AND (e.message_contains = '' OR contains(lower(t.message), lower(e.message_contains)))) AS met FROM {_EXPECT} e""",
)
def eval_expectations(spark, sf):
    f = _f(spark, sf)
    return O.expectations_met(_expected(f), f)


def _expected(f):
    x = f.select(F.col("diff_id").alias("case_id")).distinct().withColumn("exp_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return x.withColumns({"concern": F.expr("case exp_id when 1 then 'SECURITY' else '' end"), "min_severity": F.expr("case exp_id when 2 then 'high' else '' end"), "message_contains": F.expr("case exp_id when 3 then 'SQL Injection' else '' end"), "file": F.lit("")})


@query(
    "eval_summary",
    f"""SELECT count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pass_rate FROM (
    SELECT diff_id, bool_or(concern = 'security') AND bool_or(severity >= 3) AND bool_or(contains(lower(message), 'sql injection')) AS ok FROM {{f}} t GROUP BY diff_id) u""",
)
def eval_summary(spark, sf):
    met = eval_expectations(spark, sf).groupBy("case_id").agg(F.bool_and("met").alias("passed"))
    return O.eval_summary(met)


def _fix_sql() -> str:
    parts = []
    for k, (words, cwes, title, category, effort, priority, conf) in enumerate(O.FIXES):
        test = " OR ".join([f"contains(low, {literal(w)})" for w in words] + [f"cwe = {literal(c)}" for c in cwes])
        parts.append(f"SELECT diff_id, finding_id, seq, {k} AS rule, {literal(title)} AS title, {literal(category)} AS category, sev AS severity, {literal(effort)} AS estimated_effort, {priority} AS priority, CAST({conf} AS DOUBLE) AS confidence FROM x WHERE {test}")
    base = f"SELECT diff_id, file || ':' || CAST(line AS STRING) || ':' || concern AS finding_id, seq, cwe, {_SEV} AS sev, lower(concern || ' ' || message || ' ' || cwe) AS low FROM {{f}} t"
    return f"WITH x AS ({base}), c AS ({' UNION ALL '.join(parts)}) SELECT diff_id, finding_id, title, category, severity, estimated_effort, priority, confidence FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, finding_id ORDER BY confidence DESC, rule, seq) AS n FROM c) u WHERE n = 1"


@query("best_fix", _fix_sql())
def best_fix(spark, sf):
    return O.fixes(_f(spark, sf))


@query("sort_fixes", f"SELECT diff_id, finding_id, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY priority, confidence DESC, finding_id) AS INT) AS place FROM ({_fix_sql()}) z")
def sort_fixes(spark, sf):
    return O.sorted_fixes(O.fixes(_f(spark, sf))).select("diff_id", "finding_id", "place")


@query(
    "sarif_results",
    """SELECT diff_id, seq, concern AS rule_id, CASE WHEN severity >= 3 THEN 'error' WHEN severity = 2 THEN 'warning' WHEN severity = 1 THEN 'note' ELSE 'none' END AS level,
    message || CASE WHEN fix <> '' THEN chr(10) || chr(10) || 'Fix: ' || fix ELSE '' END || CASE WHEN reasoning <> '' THEN chr(10) || chr(10) || 'Reasoning: ' || reasoning ELSE '' END AS text,
    file AS uri, line AS start_line, CASE WHEN end_line > 0 AND end_line <> line THEN end_line END AS end_line FROM {f} t""",
)
def sarif_results(spark, sf):
    return O.sarif_rows(_f(spark, sf))


@query("sarif_rules", "SELECT diff_id, concern AS rule_id, min(seq) AS first_seq FROM {f} t GROUP BY diff_id, concern")
def sarif_rules(spark, sf):
    return O.sarif_rules(_f(spark, sf))


@query("sarif")
def sarif(spark, sf):
    return O.sarif(_f(spark, sf))


@query(
    "terminal_report",
    f"""SELECT diff_id, string_agg(part, chr(10) ORDER BY severity DESC) AS report FROM (SELECT diff_id, severity, '## ' || upper({_SEV}) || ' (' || CAST(count(*) AS STRING) || ')' || chr(10) ||
    string_agg('- ' || file || ':' || CAST(line AS STRING) || ' ' || message, chr(10) ORDER BY seq) AS part FROM {{f}} t GROUP BY diff_id, severity) u GROUP BY diff_id""",
)
def terminal_report(spark, sf):
    return O.markdown_report(_f(spark, sf))


def _reviewed(spark, sf):
    """All diffs with their numbers of files and hunks."""
    return S.line_items(spark, sf).groupBy("diff_id").agg(F.lit(1).alias("files"), F.countDistinct("hunk").alias("hunks"))


_REVIEWED = "(SELECT diff_id, count(DISTINCT hunk) AS hunks FROM {l} l GROUP BY diff_id)"
_UPPER = f"upper({_SEV})"


@query(
    "github_review",
    f"""SELECT diff_id, coalesce('## Review \u2014 ' || n || ' findings' || chr(10) || chr(10) || entries, '\u2705 No issues found.') AS body FROM {_REVIEWED} r LEFT JOIN (
    SELECT diff_id, count(*) AS n, string_agg('- **[' || {_UPPER} || ']** `' || file || CASE WHEN line > 0 THEN ':' || line ELSE '' END || '` \u2014 ' || message || chr(10) || CASE WHEN fix <> '' THEN '  - Fix: ' || fix || chr(10) ELSE '' END, '' ORDER BY seq) AS entries FROM {{f}} t GROUP BY diff_id) e USING (diff_id)""",
)
def github_review(spark, sf):
    return reports.pull_request(_f(spark, sf), _reviewed(spark, sf))


@query(
    "terminal_text",
    f"""SELECT diff_id, '{"=" * 51}' || chr(10) || '  CODE REVIEW' || chr(10) || '  1 files, ' || hunks || ' hunks analyzed' || chr(10) || '{"=" * 51}' || chr(10) || chr(10) ||
    coalesce(parts || '{"=" * 51}' || chr(10) || '  SUMMARY: ' || n || ' findings (' || counts || ')' || chr(10) || '{"=" * 51}' || chr(10), '  No issues found.' || chr(10) || chr(10)) AS report FROM {_REVIEWED} r LEFT JOIN (
    SELECT diff_id, sum(n) AS n, string_agg('  ' || sev || ' (' || n || ')' || chr(10) || chr(10) || entries, '' ORDER BY severity DESC) AS parts, string_agg(n || ' ' || sev, ', ' ORDER BY severity DESC) AS counts FROM (
      SELECT diff_id, severity, {_UPPER} AS sev, count(*) AS n, string_agg('    * ' || message || chr(10) || '      ' || file || CASE WHEN line > 0 THEN ':' || line || CASE WHEN end_line > 0 AND end_line <> line THEN '-' || end_line ELSE '' END ELSE '' END || '  [' || concern || ']' || chr(10) ||
        CASE WHEN reasoning <> '' THEN '      > ' || reasoning || chr(10) ELSE '' END || CASE WHEN fix <> '' THEN '      Fix: ' || fix || chr(10) ELSE '' END || chr(10), '' ORDER BY seq) AS entries FROM {{f}} t GROUP BY diff_id, severity) p GROUP BY diff_id) e USING (diff_id)""",
)
def terminal_text(spark, sf):
    return reports.terminal(_f(spark, sf), _reviewed(spark, sf))


@query(
    "json_report",
    f"""SELECT diff_id, coalesce(CAST(report AS VARCHAR), '[]') AS report FROM {_REVIEWED} r LEFT JOIN (SELECT diff_id, to_json(list({{'concern': concern, 'severity': {_SEV}, 'file': file, 'line': line, 'end_line': end_line, 'message': message, 'fix': fix, 'reasoning': reasoning, 'cwe': cwe, 'confidence': confidence}} ORDER BY seq)) AS report
    FROM {{f}} t GROUP BY diff_id) e USING (diff_id)""",
)
def json_report(spark, sf):
    return reports.as_json(_f(spark, sf), _reviewed(spark, sf))


def _digest(*parts: str) -> str:
    return "sha256(" + " || ".join(f"CAST(strlen({p}) AS STRING) || ':' || {p}" for p in parts) + ")"


@query("digest", f"SELECT doc_id, {_digest('coalesce(text, chr(0))', 'lang')} AS digest FROM documents")
def digest(spark, sf):
    return S.documents(spark, sf).select("doc_id", O.digest(F.coalesce("text", F.lit("\0")), F.col("lang")).alias("digest"))


_REPORT = f"'review/' || {_digest(literal('corpus'), 'CAST(diff_id AS STRING)')}"


@query(
    "quality_export",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY seq) - 1 AS ord, {_REPORT} AS report, {_SEV} AS sev FROM {{f}} t)
    SELECT 'finding/' || {_digest('report', 'CAST(ord AS STRING)', 'concern', 'sev', 'file', 'CAST(line AS STRING)', 'CAST(end_line AS STRING)', 'message', 'fix', 'reasoning', 'cwe')} AS id, 'finding' AS kind, diff_id, severity, line,
      {_digest('message')} AS message_digest, {_digest('file')} AS file_digest FROM p
    UNION ALL SELECT {_REPORT}, 'report', diff_id, max(severity), CAST(count(*) AS INT), '', '' FROM {{f}} t GROUP BY diff_id""",
)
def quality_export(spark, sf):
    return O.quality_graph(_f(spark, sf), "corpus")[0]


@query("export_edges", f"SELECT diff_id % 100 AS bucket, count(*) AS edges FROM {{f}} t GROUP BY 1")
def export_edges(spark, sf):
    nodes, edges = O.quality_graph(_f(spark, sf), "corpus")
    placed = nodes.where("kind = 'finding'").select(F.col("id").alias("to_id"), (F.col("diff_id") % 100).alias("bucket"))
    return edges.join(placed, "to_id").groupBy("bucket").agg(F.count("*").alias("edges"))


def _nodes(spark, sf):
    """Quality nodes: parts with two metrics."""
    def metric(name, value, limit):
        return F.struct(F.lit(name).alias("name"), F.col(value).cast("double").alias("value"), F.lit(limit).alias("threshold"), F.when(F.col(value) > limit, "fail").otherwise("pass").alias("status"))

    p = S.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"), F.col("p_brand").alias("type"), F.array(metric("size", "p_size", 25.0), metric("price", "p_retailprice", 1000.0)).alias("metrics"))


@query("failed_metrics", "SELECT p_partkey AS node_id, 'size' AS name, CAST(p_size AS DOUBLE) AS value, CAST(25 AS DOUBLE) AS threshold FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'price', p_retailprice, CAST(1000 AS DOUBLE) FROM part WHERE p_retailprice > 1000")
def failed_metrics(spark, sf):
    return O.failed_metrics(_nodes(spark, sf))


@query("top_issues", "SELECT node_id, name, value, threshold FROM (SELECT p_partkey AS node_id, 'size' AS name, CAST(p_size AS DOUBLE) AS value, CAST(25 AS DOUBLE) AS threshold FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'price', p_retailprice, CAST(1000 AS DOUBLE) FROM part WHERE p_retailprice > 1000) t ORDER BY value DESC, node_id, name LIMIT 10")
def top_issues(spark, sf):
    return O.top_issues(_nodes(spark, sf), 10)


@query("graph_spec", "SELECT p_partkey AS id, 'path' AS key, p_name AS text FROM part UNION ALL SELECT p_partkey, 'type', p_brand FROM part UNION ALL SELECT p_partkey, 'metrics', '2' FROM part UNION ALL SELECT p_partkey, 'metric_size', printf('%.2f', CAST(p_size AS DOUBLE)) FROM part UNION ALL SELECT p_partkey, 'metric_price', printf('%.2f', p_retailprice) FROM part")
def graph_spec(spark, sf):
    return O.graph_spec(_nodes(spark, sf))


@query("find_by_path", "SELECT p_partkey AS id, p_name AS path FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def find_by_path(spark, sf):
    nodes = _nodes(spark, sf)
    least = nodes.agg(F.min("path").alias("path"))
    return nodes.join(F.broadcast(least), "path", "left_semi").select("id", "path")


@query("memory_store", "SELECT id, content, seq FROM (SELECT file || ':' || CAST(line AS STRING) || ':' || concern AS id, message AS content, seq, row_number() OVER (PARTITION BY file, line, concern ORDER BY seq DESC) AS n FROM {f} t) u WHERE n = 1")
def memory_store(spark, sf):
    rows = _f(spark, sf).select(O.finding_id().alias("id"), F.col("message").alias("content"), "seq")
    return O.first_by(rows, ["id"], [F.desc("seq")])


@query(
    "memory_recall",
    """SELECT item_id, memory_id, score, place FROM (SELECT item_id, memory_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, memory_id) AS INT) AS place FROM (
    SELECT b.item_id, d.memory_id, count(*) AS score FROM (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) b
    JOIN (SELECT DISTINCT conv_id AS memory_id, unnest(string_split(lower(text), ' ')) AS w FROM conversations) d ON b.w = d.w AND b.w <> '' GROUP BY 1, 2) s) u WHERE place <= 5""",
)
def memory_recall(spark, sf):
    items = S.table(spark, sf, "benchmark").select("item_id", "text")
    memory = S.table(spark, sf, "conversations").select(F.col("conv_id").alias("memory_id"), "text")
    return O.recall(items, memory, "item_id", "memory_id", 5)


@query("prompt_limit", "SELECT diff_id, seq, substr(message, 1, 20) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY seq) AS n FROM {f} t WHERE sast_source) u WHERE n <= 2")
def prompt_limit(spark, sf):
    return O.first_of_diff(_sides(spark, sf)[0], 2).select("diff_id", "seq", F.substring("message", 1, 20).alias("evidence"))


@query("export_limit", "SELECT diff_id, seq FROM (SELECT diff_id, seq, row_number() OVER (PARTITION BY diff_id ORDER BY seq) AS n FROM {f} t) u WHERE n <= 2")
def export_limit(spark, sf):
    return O.first_of_diff(_f(spark, sf), 2).select("diff_id", "seq")


@query("duplicate_id_dedup", "SELECT id, seq FROM (SELECT file || ':' || CAST(line AS STRING) || ':' || concern AS id, seq, row_number() OVER (PARTITION BY file, line, concern ORDER BY seq) AS n FROM {f} t) u WHERE n = 1")
def duplicate_id_dedup(spark, sf):
    return O.first_by(_f(spark, sf).select(O.finding_id().alias("id"), "seq"), ["id"], ["seq"])


@query("memory_sort", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS INT) AS place FROM conversations")
def memory_sort(spark, sf):
    return O.placed(S.table(spark, sf, "conversations"), ["conv_id"], [F.desc(F.length("text")), "turn"]).select("conv_id", "turn", "place")


@query("contract_convert", f"SELECT diff_id, seq, concern AS category, {_SEV} AS severity, file AS path, line AS start_line, end_line, message, fix AS suggestion, cwe, confidence FROM {{f}} t")
def contract_convert(spark, sf):
    return O.contract(_f(spark, sf))


@query("quality_events", f"SELECT 'observed/' || {_digest('id', literal('2024-01-01T00:00:00Z'))} AS id, id AS subject FROM (SELECT {_REPORT} AS id FROM {{f}} t GROUP BY diff_id) u")
def quality_events(spark, sf):
    nodes, _ = O.quality_graph(_f(spark, sf), "corpus")
    return O.observed(nodes.where("kind = 'report'"), "2024-01-01T00:00:00Z")


@query("git_context", "SELECT c_name AS path, array_to_string((list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey))[1:5], ' ') AS recent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def git_context(spark, sf):
    last = git.recent(_commits(spark, sf), ["path"], [F.desc("o_orderdate"), "o_orderkey"])
    return last.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("o_orderkey").cast("string").alias("k")))), lambda x: x["k"]), " ").alias("recent"))


def _commits(spark, sf):
    """Orders as commits, customers as files, nations as changes."""
    joined = S.table(spark, sf, "orders").join(S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("path"), "o_orderdate", "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("text"))


@query(
    "git_context_text",
    """SELECT key, chr(10) || '## Git Context' || chr(10) || chr(10) || string_agg('### ' || path || ' \u2014 Recent changes:' || chr(10) || lines || chr(10), '' ORDER BY path) AS text FROM (
      SELECT key, path, string_agg('  - ' || text || chr(10), '' ORDER BY n) AS lines FROM (SELECT c_nationkey AS key, c_name AS path, o_orderkey || ' ' || o_orderpriority AS text, row_number() OVER (PARTITION BY c_name ORDER BY o_orderdate DESC, o_orderkey) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey) a WHERE n <= 5 GROUP BY key, path) b GROUP BY key""",
)
def git_context_text(spark, sf):
    return git.context_text(git.recent(_commits(spark, sf), ["path"], [F.desc("o_orderdate"), "o_orderkey"]), "key")
