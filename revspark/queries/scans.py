"""Queries on line scans and data flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, flow, prompts, rules, rulesets, taint
from ..rules_catalog import RULES
from ..schemas import SEVERITIES
from ..sources import synthetic as S
from . import SQL, literal, query


def rule_sql(rows: str, text: str, chosen: list, columns: str) -> str:
    """Oracle of a rule scan: every rule's patterns in RE2 as they stand in the catalogue."""

    def one(r) -> str:
        no = "" if r.antipattern is None else f" AND NOT regexp_matches({text}, {literal(r.antipattern)})"
        return (
            f"SELECT {columns}, {literal(r.rule_id)} AS rule_id, {SEVERITIES.index(r.severity)} AS severity, {literal(r.category)} AS category, {literal(r.cwe)} AS cwe, "
            f"CAST({rules.confidence(r)!r} AS DOUBLE) AS confidence FROM {rows} t WHERE regexp_matches({text}, {literal(r.pattern)}){no}"
        )

    return " UNION ALL ".join(map(one, chosen))


COLUMNS = ["rule_id", "severity", "category", "cwe", "confidence"]
GO = [r for r in RULES if r.language in ("go", "any")]
ADDED = "(SELECT diff_id, path AS file, CAST(new_start - 1 + rel_new AS INT) AS line, text FROM {l} a WHERE mark = '+')"


@query("diff_rule_scan", rule_sql(ADDED, "text", GO, "diff_id, file, line"))
def diff_rule_scan(spark, sf):
    hits = rules.scan(diff.added_lines(S.diffs(spark, sf)), "go")
    return hits.select("diff_id", "file", "line", *COLUMNS)


@query("rule_rows_scan", rule_sql(ADDED, "text", GO, "diff_id, file, line"))
def rule_rows_scan(spark, sf):
    hits = rulesets.scan(diff.added_lines(S.diffs(spark, sf)), rulesets.as_rows(spark, RULES), "go")
    return hits.select("diff_id", "file", "line", "rule_id", "severity", "category", "cwe", "confidence")


@query("static_scan", rule_sql(f"(SELECT * FROM {ADDED} b WHERE file LIKE '%.go')", "text", GO, "diff_id, file, line") + " UNION ALL " + rule_sql(f"(SELECT * FROM {ADDED} b WHERE file LIKE '%.py')", "text", [r for r in RULES if r.language in ("python", "any")], "diff_id, file, line") + " UNION ALL " + rule_sql(f"(SELECT * FROM {ADDED} b WHERE file LIKE '%.js')", "text", [r for r in RULES if r.language in ("javascript", "any")], "diff_id, file, line"))
def static_scan(spark, sf):
    rows = diff.added_lines(S.diffs(spark, sf)).withColumn("language", rules.detect_language(F.col("file")))
    return rules.scan(rows).select("diff_id", "file", "line", *COLUMNS)


SECRETS = [r for r in RULES if r.rule_id in ("SEC-GO-004", "SEC-PY-007", "SEC-JS-005", "SEC-RB-004")]


@query("secret_scan_documents", rule_sql("{dl}", "text", SECRETS, "doc_id, CAST(line AS INT) AS line"))
def secret_scan_documents(spark, sf):
    docs = S.documents(spark, sf).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return rules.scan(diff.source_lines(docs), rules.EVERY, SECRETS).select(F.col("path").alias("doc_id"), "line", *COLUMNS)


JAVASCRIPT = [r for r in RULES if r.language in ("javascript", "any")]


@query("static_scan_file", rule_sql("(SELECT page_id, unnest(generate_series(1, len(string_split(html, chr(10))))) AS line, unnest(string_split(html, chr(10))) AS text FROM pages)", "text", JAVASCRIPT, "page_id, CAST(line AS INT) AS line"))
def static_scan_file(spark, sf):
    pages = S.table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    return rules.scan(diff.source_lines(pages), "javascript").select(F.col("path").alias("page_id"), "line", *COLUMNS)


@query("rule_hits_by_severity", f"SELECT severity, count(*) AS hits, count(DISTINCT rule_id) AS rules FROM ({rule_sql(ADDED, 'text', GO, 'diff_id')}) h GROUP BY severity")
def rule_hits_by_severity(spark, sf):
    hits = rules.scan(diff.added_lines(S.diffs(spark, sf)), "go")
    return hits.groupBy("severity").agg(F.count("*").alias("hits"), F.countDistinct("rule_id").alias("rules"))


_CATALOG = ", ".join(f"({literal(r.rule_id)}, {k}, {literal(r.language)}, {literal(r.cwe)}, CAST({rules.confidence(r)!r} AS DOUBLE), {literal(r.message)}, {literal(r.fix)})" for k, r in enumerate(RULES))


@query(
    "rule_catalog",
    f"""SELECT language, files, rule_id, rule_language, cwe, confidence FROM (SELECT CASE diff_id % 5 WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN 'javascript' ELSE 'go' END AS language, count(DISTINCT path) AS files FROM {{l}} t GROUP BY 1) x
    JOIN (VALUES {_CATALOG}) r(rule_id, rule_no, rule_language, cwe, confidence, message, fix) ON rule_language IN (language, 'any')""",
)
def rule_catalog(spark, sf):
    """The rules that the files of all diffs are scanned with, by language."""
    paths = S.line_items(spark, sf).select("diff_id").distinct().select(F.expr(S.PATH).alias("path"))
    found = paths.groupBy(rules.detect_language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))
    either = found.select("language", "files", F.explode(F.array("language", F.lit("any"))).alias("rule_language"))
    return either.join(F.broadcast(rules.rules_table(spark)), "rule_language").select("language", "files", "rule_id", "rule_language", "cwe", "confidence")


@query(
    "static_findings",
    f"""SELECT diff_id, row_number() OVER (PARTITION BY diff_id ORDER BY file, rule_no, line) AS seq, 'static:' || category AS concern, severity, file, line, 0 AS end_line, message, fix, '' AS reasoning, h.cwe, h.confidence, true AS sast_source
    FROM ({rule_sql(ADDED, "text", GO, "diff_id, file, line")}) h JOIN (VALUES {_CATALOG}) r(rule_id, rule_no, rule_language, cwe, confidence, message, fix) USING (rule_id)""",
)
def static_findings(spark, sf):
    return rules.findings_of(rules.scan(diff.added_lines(S.diffs(spark, sf)), "go"))


@query(
    "finding_rule",
    """SELECT rule_id, count(*) AS n FROM (SELECT CASE WHEN category = 'performance' AND rule_id LIKE 'SEC%' THEN NULL ELSE rule_id END AS rule_id FROM (""" + rule_sql(ADDED, "text", GO, "diff_id") + ") h) g GROUP BY rule_id",
)
def finding_rule(spark, sf):
    found = rules.finding_rule(static_findings(spark, sf))
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("detect_language", "SELECT DISTINCT path, CASE diff_id % 5 WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN 'javascript' ELSE 'go' END AS language FROM {l} t")
def detect_language(spark, sf):
    return diff.files(S.diffs(spark, sf)).select("path", rules.detect_language(F.col("path")).alias("language"))


@query("exclude_filter", "SELECT DISTINCT diff_id, path FROM {l} t WHERE diff_id % 5 <> 4")
def exclude_filter(spark, sf):
    return diff.files(S.diffs(spark, sf)).where(~rules.excluded(F.col("path"))).select("diff_id", "path")


@query(
    "sast_checks",
    """WITH a AS (SELECT diff_id, path, text, path LIKE '%.go' AS go FROM {l} t WHERE mark = '+')
    SELECT diff_id, 'sql-injection' AS check_id, CAST(0.7 AS DOUBLE) AS confidence, text AS evidence FROM a WHERE go AND contains(text, 'fmt.Sprintf') AND contains(text, 'SELECT')
    UNION ALL SELECT diff_id, 'sql-injection', CAST(0.6 AS DOUBLE), text FROM a WHERE go AND contains(text, 'Query(') AND contains(text, '+')
    UNION ALL SELECT diff_id, 'hardcoded-secret', CAST(0.5 AS DOUBLE), text FROM a, (VALUES ('password'), ('secret'), ('api_key'), ('apikey'), ('token'), ('private_key')) v(w) WHERE contains(lower(text), w) AND contains(text, '=') AND contains(text, '"')
      AND NOT contains(lower(text), 'test') AND NOT contains(lower(text), 'example') AND NOT contains(lower(text), 'xxx')
    UNION ALL SELECT diff_id, 'command-injection', CAST(0.6 AS DOUBLE), text FROM a WHERE go AND contains(text, 'exec.Command') AND contains(text, '+')
    UNION ALL SELECT diff_id, 'unchecked-error', CAST(0.3 AS DOUBLE), text FROM a WHERE go AND contains(text, '(') AND contains(text, ')') AND NOT contains(text, '=') AND length(text) > 10
      AND NOT regexp_matches(text, '^(//|defer|go |if |for |return |func )')""",
)
def sast_checks(spark, sf):
    rows = diff.added_lines(S.diffs(spark, sf))
    return rules.keyword_checks(rows, path="file").select("diff_id", "check_id", "confidence", "evidence")


@query("sast_applies_to", "SELECT check_id, count(*) AS n FROM (SELECT DISTINCT path FROM {l} t) p, (VALUES ('sql-injection'), ('hardcoded-secret'), ('command-injection'), ('path-traversal'), ('unchecked-error')) c(check_id) WHERE check_id IN ('hardcoded-secret', 'path-traversal') OR path LIKE '%.go' GROUP BY check_id")
def sast_applies_to(spark, sf):
    checks = ["sql-injection", "hardcoded-secret", "command-injection", "path-traversal", "unchecked-error"]
    on = F.array_compact(F.array(*(F.when(rules.applies_to(c, F.col("path")), F.lit(c)) for c in checks)))
    return diff.files(S.diffs(spark, sf)).select(F.explode(on).alias("check_id")).groupBy("check_id").agg(F.count("*").alias("n"))


CONVENTIONS = [("no-md5", r"(?i)\bmd5\b"), ("avoid-exec", r"(?i)\bexec\b"), ("prefer-alternative", r"(?i)\bhttp\.request\b")]


@query("convention_check", " UNION ALL ".join(f"SELECT diff_id, CAST(n + 3 + hunk AS INT) AS pos, {literal(name)} AS convention FROM {{l}} t WHERE mark = '+' AND regexp_matches(text, {literal(p)})" for name, p in CONVENTIONS))
def convention_check(spark, sf):
    return rules.convention_check(diff.raw_added(S.diffs(spark, sf)), CONVENTIONS).select("diff_id", "pos", "convention")


@query(
    "parse_convention",
    r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'no-' || replace(w, ' ', '-') WHEN 4 THEN 'prefer-alternative' ELSE 'avoid-' || replace(w, ' ', '-') END AS name, '(?i)\b' || w || '\b' AS pattern
    FROM (SELECT p_partkey, lower(p_type) AS w FROM part) t""",
)
def parse_convention(spark, sf):
    k = F.col("p_partkey") % 5
    words = F.when(k == 0, F.lit("Never use ")).when(k == 1, F.lit("Please don't use ")).when(k == 2, F.lit("Do not use ")).when(k == 3, F.lit("Avoid ")).otherwise(F.lit("Use slog not "))
    rows = S.table(spark, sf, "part").select("p_partkey", F.concat(words, "p_type", F.lit(". Always, really")).alias("rule"))
    return rows.join(rules.parse_conventions(rows.select("rule").distinct()), "rule").select("p_partkey", "name", "pattern")


@query(
    "route_concerns",
    """WITH t AS (SELECT diff_id, lower(string_agg(text, chr(10))) AS raw, bool_or(mark = '+' AND (contains(lower(text), 'func ') OR contains(lower(text), 'def '))) AS fresh FROM {l} x GROUP BY diff_id)
    SELECT diff_id, 'security' AS concern FROM t WHERE regexp_matches(raw, 'auth|password|token|secret|crypto|hash|session|cookie|cors|csrf|sql|exec|eval|inject|sanitize|escape|permission|role|admin')
    UNION ALL SELECT diff_id, 'performance' FROM t WHERE regexp_matches(raw, 'loop|for |while|range|append|map\\[|query|select |join|cache|pool|buffer|batch')
    UNION ALL SELECT diff_id, 'test_coverage' FROM t WHERE fresh
    UNION ALL SELECT diff_id, c FROM t, (VALUES ('correctness'), ('maintainability'), ('style')) v(c)""".replace("\\\\", "\\"),
)
def route_concerns(spark, sf):
    return rules.route_concerns(S.diffs(spark, sf))


_ROUTED = SQL["route_concerns"]


@query("build_concerns", f"SELECT diff_id, concern AS name FROM ({_ROUTED}) r WHERE concern IN ('security', 'performance', 'correctness', 'style')")
def build_concerns(spark, sf):
    """The concerns that each diff calls for and that have a prompt."""
    return _prompted(spark, sf).select("diff_id", "name")


def _prompted(spark, sf):
    known = prompts.concerns(spark).withColumnRenamed("name", "concern")
    return rules.route_concerns(S.diffs(spark, sf)).join(F.broadcast(known), "concern").select("diff_id", F.col("concern").alias("name"), "system_prompt")


@query(
    "system_prompt",
    f"SELECT diff_id, concern AS name, 'You review code for ' || concern || '. ' || CASE concern {' '.join(f'WHEN {literal(k)} THEN {literal(v)}' for k, v in prompts.CONCERNS.items())} END || chr(10) || {literal(prompts.ANSWER)} AS system_prompt FROM ({_ROUTED}) r WHERE concern IN ('security', 'performance', 'correctness', 'style')",
)
def system_prompt(spark, sf):
    return _prompted(spark, sf)


def _source_sql(text: str, names: list) -> str:
    return f"CASE {' '.join(f'WHEN regexp_matches({text}, {literal(p)}) THEN {literal(n)}' for n, p in names)} END"


_CLEAN = literal("|".join(taint.SANITIZERS))
_SINKS = ", ".join(f"({literal(n)}, {literal(cwe)}, {SEVERITIES.index(sev)}, {literal(kind)}, {literal(fix)}, {literal(p)})" for n, cwe, sev, kind, fix, p in taint.SINKS)
_TRACK = f"""WITH RECURSIVE rows AS MATERIALIZED (
      SELECT diff_id, file, line, text, added, k, sig, name, value, {_source_sql("value", taint.SOURCES)} AS known, regexp_matches(value, {_CLEAN}) AS clean, regexp_matches(text, {_CLEAN}) AS safe,
        coalesce({_source_sql("text", taint.SOURCES[:0:-1])}, '{taint.PARAMETER}') AS entry,
        list_filter(list_transform(string_split(inner_, ','), lambda p : string_split(trim(regexp_replace(p, '\\s+', ' ', 'g')), ' ')[1]), lambda n : n <> '' AND NOT list_contains([{', '.join(map(literal, taint.BUILTIN_TYPES))}], n)) AS params
      FROM (SELECT *, regexp_matches(text, {literal(taint.SIGNATURE)}) AS sig, regexp_extract(text, {literal(taint.SIGNATURE)}, 2) AS inner_, regexp_extract(text, {literal(taint.ASSIGNMENT)}, 1) AS name, regexp_extract(text, {literal(taint.ASSIGNMENT)}, 2) AS value
        FROM (SELECT diff_id, path AS file, CAST(new_start - 1 + rel_new AS INT) AS line, trim(text) AS text, mark = '+' AS added, row_number() OVER (PARTITION BY diff_id ORDER BY n) AS k FROM {{l}} t WHERE mark <> '-' AND path LIKE '%.go') a) b),
    steps AS (SELECT diff_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(n VARCHAR, s VARCHAR)[]) AS state FROM (SELECT DISTINCT diff_id FROM rows) d
      UNION ALL SELECT r.diff_id, r.k, CASE WHEN sig THEN list_transform(params, lambda p : {{'n': p, 's': entry}}) WHEN name = '' THEN state ELSE list_concat(list_filter(state, lambda e : e.n <> name),
          CASE WHEN clean THEN [] WHEN known IS NOT NULL THEN [{{'n': name, 's': known}}] ELSE list_transform(list_filter(list_sort(state), lambda e : contains(value, e.n))[1:1], lambda e : {{'n': name, 's': e.s}}) END) END
        FROM steps s JOIN rows r ON r.diff_id = s.diff_id AND r.k = s.k + 1)
    SELECT r.diff_id, r.file, r.line, e.n AS variable, e.s AS source, x.sink, x.cwe, x.severity, x.sink_type, 'Tainted data from ' || e.s || ' flows to ' || x.sink || ' without sanitization' AS message, x.fix
    FROM (SELECT diff_id, k, unnest(state) AS e FROM steps) s JOIN rows r ON r.diff_id = s.diff_id AND r.k = s.k JOIN (VALUES {_SINKS}) x(sink, cwe, severity, sink_type, fix, pattern) ON regexp_matches(r.text, x.pattern)
    WHERE NOT r.sig AND r.added AND NOT r.safe AND contains(r.text, e.n)"""


@query("taint_track", _TRACK)
def taint_track(spark, sf):
    return taint.track(diff.new_side(S.diffs(spark, sf)))


@query(
    "taint_sinks",
    """SELECT diff_id, n, sink FROM (SELECT diff_id, n, text, unnest(['SQL query execution', 'command execution', 'log output']) AS sink FROM {l} t WHERE mark = '+') s
    WHERE CASE sink WHEN 'SQL query execution' THEN regexp_matches(text, '(?:\\.Query|\\.QueryRow|\\.Exec)\\s*\\(') WHEN 'command execution' THEN regexp_matches(text, 'exec\\.Command\\s*\\(')
      ELSE regexp_matches(text, '(?:log\\.|slog\\.|logger\\.|fmt\\.Print)(?:Println|Printf|Info|Debug|Warn|Error|Fatal|Sprintf|Sprintln)') END""".replace("\\\\", "\\"),
)
def taint_sinks(spark, sf):
    return S.line_items(spark, sf).where("mark = '+'").select("diff_id", "n", F.explode(taint.sinks_of(F.col("text"))).alias("sink"))


@query("is_sanitized", "SELECT diff_id, n, regexp_matches(text, " + literal("|".join(taint.SANITIZERS)) + ") AS clean FROM {l} t")
def is_sanitized(spark, sf):
    return S.line_items(spark, sf).select("diff_id", "n", taint.is_sanitized(F.col("text")).alias("clean"))


@query("func_params", "SELECT diff_id, n, name FROM {l} t, (VALUES ('name'), ('r')) v(name) WHERE text LIKE 'func h%'")
def func_params(spark, sf):
    rows = S.line_items(spark, sf).where("text like 'func h%'")
    return rows.select("diff_id", "n", F.explode(taint.parameters(F.col("text"))).alias("name"))


@query("taint_confidence", "SELECT k, least(greatest(CAST(0.8 AS DOUBLE) - CAST(0.1 AS DOUBLE) * (k % 3) - CAST(0.2 AS DOUBLE) * (CASE WHEN k % 4 < 2 THEN 0 ELSE 1 END), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS confidence FROM (SELECT CAST(p_partkey AS INT) AS k FROM part) t")
def taint_confidence(spark, sf):
    source = F.expr("case k % 4 when 0 then 'function-parameter' when 1 then 'os.Args' when 2 then 'json-decode' else 'unknown' end")
    keys = S.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("k"))
    return keys.select("k", taint.confidence(source, F.col("k") % 3).alias("confidence"))


@query("taint_message_parts", "SELECT k, CASE WHEN k % 3 = 2 THEN 'unknown' ELSE 'src ' || k END AS source, CASE WHEN k % 3 = 2 THEN 'unknown' ELSE 'sink ' || k END AS sink FROM (SELECT CAST(p_partkey AS STRING) AS k FROM part) t".replace("k % 3", "CAST(k AS INT) % 3"))
def taint_message_parts(spark, sf):
    message = F.expr("case cast(k as int) % 3 when 0 then '[T] SQL: src ' || k || ' -> sink ' || k || ' via variable x' when 1 then '[T] SQL: src ' || k || ' -> sink ' || k else 'plain ' || k end")
    keys = S.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"))
    return keys.select("k", taint.message_parts(message).alias("m")).select("k", "m.*")


def _flow_tables(spark, sf):
    """Values are parts; an order's consecutive line items are uses of one by the next; parts of size 1 are parameters."""
    li = S.line_items(spark, sf).select("diff_id", "n", "part", "mark")
    a, b = li.alias("a"), li.alias("b")
    e = a.join(b, F.expr("a.diff_id = b.diff_id and a.n + 1 = b.n")).selectExpr("a.part as src", "b.part as dst", "case when b.part % 7 = 0 then 'sanitizer' when b.part % 11 = 0 then 'sink' else 'passthrough' end as kind")
    return e.distinct().withColumn("sink_kind", F.when(F.col("kind") == "sink", "SQL_INJECTION"))


_FLOW = """e AS (SELECT DISTINCT a.part AS src, b.part AS dst, CASE WHEN b.part % 7 = 0 THEN 'sanitizer' WHEN b.part % 11 = 0 THEN 'sink' ELSE 'passthrough' END AS kind
  FROM {l} a JOIN {l} b ON a.diff_id = b.diff_id AND a.n + 1 = b.n)"""


@query("ssa_reachability", f"WITH RECURSIVE {_FLOW}, r(node) AS (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE e.kind = 'passthrough') SELECT DISTINCT node FROM r")
def ssa_reachability(spark, sf):
    return _reached(spark, sf)[0].select("node")


def _reached(spark, sf):
    from ..plans.store import stored

    edges = stored(_flow_tables(spark, sf), "ssa-edges")
    seeds = S.table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"), F.lit("function-parameter").alias("source"))
    return taint.reach(seeds, edges, lambda df: stored(df, "ssa")), edges


@query("ssa_sort_cap", f"WITH RECURSIVE {_FLOW}, r(node) AS (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE e.kind = 'passthrough') SELECT DISTINCT 'f.go' AS file, CAST(e.dst AS INT) AS line, 'SQL_INJECTION' AS kind FROM e JOIN r ON e.src = r.node WHERE e.kind = 'sink' ORDER BY line LIMIT 20")
def ssa_sort_cap(spark, sf):
    reached, edges = _reached(spark, sf)
    values = edges.select(F.col("dst").alias("value_id")).distinct().withColumns({"pos_file": F.lit("f.go"), "pos_line": F.col("value_id").cast("int")})
    return taint.sink_findings(reached, edges, values, 20).drop("source")


#: A program made of line items: a part is a function, its line items are instructions over its values 10 k + 1 (parameter) to 10 k + 7 (returned).
#: Functions call only such of the next of three levels, k % 3.
_USES = """SELECT CASE l_returnflag WHEN 'R' THEN 'Store' WHEN 'A' THEN 'BinOp' ELSE 'Phi' END AS op, 10 * l_partkey + 1 + l_orderkey % 6 AS src, 10 * l_partkey + 2 + (l_orderkey + l_suppkey) % 6 AS dst,
  CASE WHEN l_orderkey % 5 = 0 THEN 10 * l_partkey + 7 END AS base FROM lineitem WHERE l_linenumber < 3"""
_CALLS = """SELECT l_orderkey * 8 + l_linenumber AS site, CASE l_linenumber WHEN 3 THEN CASE WHEN l_partkey % 3 < 2 THEN 'app.f' || CAST(3 * l_suppkey + l_partkey % 3 + 1 AS STRING) ELSE 'strings.Join' END
    WHEN 4 THEN 'path/filepath.Clean' WHEN 5 THEN '(*database/sql.DB).Query' WHEN 6 THEN 'fmt.Sprintf' ELSE 'os.Getenv' END AS callee, CAST(0 AS INT) AS index, 10 * l_partkey + 1 + l_orderkey % 6 AS arg,
  CASE WHEN l_linenumber <> 5 THEN 10 * l_partkey + 2 + l_suppkey % 6 END AS result, 'p' || CAST(l_partkey AS STRING) || '.go' AS file, CAST(l_orderkey * 8 + l_linenumber AS INT) AS line FROM lineitem WHERE l_linenumber >= 3"""
_PARAMS = "SELECT 'app.f' || CAST(p_partkey AS STRING) AS callee, CAST(0 AS INT) AS index, 10 * p_partkey + 1 AS value, CASE WHEN p_size = 1 THEN '*net/http.Request' ELSE 'string' END AS type FROM part"
_RETURNS = "SELECT 'app.f' || CAST(p_partkey AS STRING) AS callee, 10 * p_partkey + 7 AS value FROM part"

_SSA = f"""WITH RECURSIVE uses AS ({_USES}), calls AS ({_CALLS}), params AS ({_PARAMS}), returns AS ({_RETURNS}),
    flow AS MATERIALIZED (SELECT src, dst FROM uses UNION SELECT src, base FROM uses WHERE op = 'Store' AND base IS NOT NULL UNION SELECT arg, result FROM calls WHERE callee IN ('strings.Join', 'fmt.Sprintf')),
    enter AS MATERIALIZED (SELECT DISTINCT arg AS src, value AS dst, site FROM calls JOIN params USING (callee, index)),
    leave AS MATERIALIZED (SELECT DISTINCT value AS src, result AS dst, site FROM calls JOIN returns USING (callee)),
    p2(entry, here) AS (SELECT dst, dst FROM enter WHERE (dst // 10) % 3 = 2 UNION SELECT entry, dst FROM p2 JOIN flow ON src = here),
    s2 AS MATERIALIZED (SELECT DISTINCT e.src, l.dst FROM p2 JOIN leave l ON l.src = here JOIN enter e ON e.dst = entry AND e.site = l.site), with2 AS MATERIALIZED (SELECT * FROM flow UNION SELECT * FROM s2),
    p1(entry, here) AS (SELECT dst, dst FROM enter WHERE (dst // 10) % 3 = 1 UNION SELECT entry, dst FROM p1 JOIN with2 ON src = here),
    s1 AS MATERIALIZED (SELECT DISTINCT e.src, l.dst FROM p1 JOIN leave l ON l.src = here JOIN enter e ON e.dst = entry AND e.site = l.site), same AS MATERIALIZED (SELECT * FROM with2 UNION SELECT * FROM s1),
    moves AS MATERIALIZED (SELECT src, dst, i AS a, i AS b FROM same, (VALUES (0), (1)) v(i) UNION SELECT src, dst, i, 1 FROM enter, (VALUES (0), (1)) v(i) UNION SELECT src, dst, 0, 0 FROM leave),
    r(node, inside, source) AS (SELECT value, 0, 'http.Request parameter' FROM params WHERE type LIKE '%net/http.Request%' UNION SELECT result, 0, 'os.Getenv' FROM calls WHERE callee = 'os.Getenv'
      UNION SELECT dst, b, source FROM r JOIN moves ON src = node AND a = inside)
    SELECT file, line, 'SQL_INJECTION' AS kind, min(source) AS source, 4 AS severity, 'CWE-89' AS cwe, '[SSA-TAINT-SQL_INJECTION] untrusted data from ' || min(source) || ' reaches SQL query execution across function boundaries without sanitization' AS message,
      {literal(flow.SINKS[0][4])} AS fix FROM calls JOIN r ON arg = node WHERE callee LIKE '%database/sql%' GROUP BY file, line"""


@query("ssa_taint", _SSA)
def ssa_taint(spark, sf):
    from ..plans.store import stored

    li, parts = S.table(spark, sf, "lineitem"), S.table(spark, sf, "part")
    uses, calls = (spark.sql(q.replace("FROM lineitem", "FROM {t}"), t=li) for q in (_USES, _CALLS))
    params, returns = (spark.sql(q.replace("FROM part", "FROM {t}"), t=parts) for q in (_PARAMS, _RETURNS))
    edges = stored(flow.use_edges(uses).unionByName(flow.call_edges(calls, params, returns)), "flow-edges")
    reached = flow.reach(flow.seeds(calls, params), edges, lambda df: stored(df, "flow"))
    return flow.findings(reached, calls)
