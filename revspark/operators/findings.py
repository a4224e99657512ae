"""The algebra of findings: duplicates, fusion, gates, joins with diffs, statistics, ranking.

Everything is keyed by diff_id, so that one partitioning by it can serve a chain of operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digest, looks_like_code, message_overlap
from ..plans.store import stored
from ..schemas import SEVERITIES, parse_severity, severity_name

DOUBLE = "double"


def union(*parts: DataFrame) -> DataFrame:
    """All findings, numbered anew in the order of the parts within each diff."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("seq", F.row_number().over(W.partitionBy("diff_id").orderBy("_part", "seq")).cast("long")).drop("_part")


def exact_dedup(findings: DataFrame) -> DataFrame:
    """The first finding of every (file, line, message) of a diff."""
    first = F.row_number().over(W.partitionBy("diff_id", "file", "line", "message").orderBy("seq"))
    return findings.withColumn("_n", first).where("_n = 1").drop("_n")


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def recall(questions: DataFrame, memory: DataFrame, question: str, entry: str, k: int, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(question, entry, score, place): the k entries of memory that share most distinct words with each question's text.

    Both sides have an id column and text; rows of one id count together; null texts have no words. Ties go to the least entry.

    A question's words are looked up rarest first, in rounds of those that at most four times as many entries have as the rarest one left. An entry that none of them found shares at most the
    words that are left; once the k-th best entry has more than that already, the common words are never joined. Of the entries found only
    those that could still be among the k are compared whole.
    """

    def words(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.split(F.lower("text"), " ")).alias("_word")).where("_word <> ''").distinct()

    entries = keep(words(memory, entry), "recall-entries")
    often = entries.groupBy("_word").agg(F.count("*").alias("_n"))
    asked = words(questions, question).join(often, "_word")  # words that no entry has don't matter
    ordered = asked.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("_n", "_word"))).alias("_words"))
    ordered = keep(ordered.select(question, "_words", F.size("_words").alias("_left"), F.lit(0).alias("_done")), "recall-questions")
    open_, parts = ordered, []
    while not open_.isEmpty():
        rest = F.slice("_words", F.col("_done") + 1, F.col("_left"))
        step = F.size(F.filter(rest, lambda w: w["_n"] <= 4 * F.get("_words", F.col("_done"))["_n"]))
        open_ = open_.withColumn("_step", step)
        now = open_.select(question, F.explode(F.slice("_words", F.col("_done") + 1, F.col("_step"))).alias("_w")).select(question, F.col("_w._word").alias("_word"))
        parts.append(keep(now.join(entries, "_word").groupBy(question, entry).agg(F.count("*").alias("score")), "recall-scores"))
        found = reduce(DataFrame.unionByName, parts).groupBy(question, entry).agg(F.sum("score").alias("score"))
        rank = F.row_number().over(W.partitionBy(question).orderBy(F.desc("score")))
        kth = found.withColumn("_r", rank).where(F.col("_r") == k).select(question, F.col("score").alias("_kth"))
        moved = open_.select(question, "_words", (F.col("_left") - F.col("_step")).alias("_left"), (F.col("_done") + F.col("_step")).alias("_done"))
        judged = keep(moved.join(kth, question, "left").withColumn("_kth", F.coalesce("_kth", F.lit(0))), "recall-judged")
        parts_done = judged.where("_left = 0 or _kth > _left").select(question, "_words", "_left", "_kth")
        settled = parts_done if len(parts) == 1 else settled.unionByName(parts_done)
        open_ = judged.where("_left > 0 and _kth <= _left").select(question, "_words", "_left", "_done")
    if not parts:
        return ordered.select(question, F.lit(None).cast(memory.schema[entry].dataType).alias(entry), F.lit(0).cast("long").alias("score"), F.lit(0).alias("place"))
    found = reduce(DataFrame.unionByName, parts).groupBy(question, entry).agg(F.sum("score").alias("score"))
    close = found.join(settled, question).where(F.col("score") + F.col("_left") >= F.col("_kth"))
    rest = F.slice("_words._word", F.size("_words") - F.col("_left") + 1, F.col("_left"))
    whole = entries.groupBy(entry).agg(F.collect_list("_word").alias("_has"))
    exact = close.where("_left > 0").join(whole, entry).select(question, entry, (F.col("score") + F.size(F.array_intersect(rest, "_has"))).alias("score"))
    score = exact.unionByName(close.where("_left = 0").select(question, entry, "score"))
    place = F.row_number().over(W.partitionBy(question).orderBy(F.desc("score"), entry))
    return score.withColumn("place", place).where(F.col("place") <= k)


def fusion(sast: DataFrame, llm: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirmed and dismissed findings of the scanner, and findings of the model at a scanner's place about something else."""
    keys = ["diff_id", "file", "line"]
    theirs = llm.select(*keys, F.col("message").alias("_m"))
    mine = sast.select(*keys, F.col("message").alias("_m"))

    def cond(a: DataFrame, b: DataFrame, overlap: Column) -> Column:
        return (a["diff_id"] == b["diff_id"]) & (a["file"] == b["file"]) & (a["line"] == b["line"]) & overlap

    agree = message_overlap(sast["message"], theirs["_m"])
    confirmed = sast.join(theirs, cond(sast, theirs, agree), "left_semi")
    dismissed = sast.join(theirs, cond(sast, theirs, agree), "left_anti")
    beside = llm.join(mine, cond(llm, mine, ~message_overlap(llm["message"], mine["_m"])), "left_semi")
    return confirmed, dismissed, beside


def comment_map(findings: DataFrame, hunks: DataFrame, lines: DataFrame | None = None, mode: str = "added") -> DataFrame:
    """Findings at places that a mode admits: added (within a hunk's new range), context (also its line numbers), file, none.

    Ranges join on the file, with the line's range as a further condition.
    """
    if mode == "none":
        return findings
    h = hunks.select(F.col("diff_id").alias("_d"), F.col("path").alias("_p"), F.col("new_start").alias("_s"), (F.col("new_start") + F.col("new_count")).alias("_e"))
    same = (F.col("diff_id") == F.col("_d")) & (F.col("file") == F.col("_p"))
    if mode == "file":
        return findings.join(h.select("_d", "_p").distinct(), same, "left_semi")
    inside = same & (F.col("line") >= F.col("_s")) & (F.col("line") < F.col("_e"))
    if mode == "added":
        return findings.join(h, inside, "left_semi")
    if lines is None:
        raise ValueError("mode context needs the diffs' lines")
    points = lines.select(F.col("diff_id").alias("_d"), F.col("path").alias("_p"), F.explode(F.array("old_num", "new_num")).alias("_s")).where("_s > 0").withColumn("_e", F.col("_s") + 1)
    return findings.join(h.unionByName(points.distinct()), inside, "left_semi")


def comments(findings: DataFrame) -> DataFrame:
    """(diff_id, seq, path, start_line, end_line, body, suggestion): findings as inline comments."""
    label = F.upper(severity_name(F.col("severity")))
    body = F.concat(F.lit("**["), label, F.lit("]** "), F.col("message"), F.lit("\n"))
    body = F.concat(body, F.when(F.col("reasoning") != "", F.concat(F.lit("\n> "), F.col("reasoning"), F.lit("\n"))).otherwise(""))
    code = (F.col("fix") != "") & looks_like_code(F.col("fix"))
    body = F.concat(body, F.when((F.col("fix") != "") & ~code, F.concat(F.lit("\n**Fix:** "), F.col("fix"), F.lit("\n"))).otherwise(""))
    return findings.select("diff_id", "seq", F.col("file").alias("path"), F.col("line").alias("start_line"), "end_line", body.alias("body"), F.when(code, F.col("fix")).otherwise("").alias("suggestion"))


def gate(findings: DataFrame, verdicts: DataFrame, min_severity: int = 2, threshold: float = 0.6) -> DataFrame:
    """Findings under min_severity pass; others if a verdict (diff_id, seq, confirmed, confidence) confirms them at threshold.

    A finding without verdict counts as confirmed at 0.5. Passed ones come first in `place`.
    """
    v = verdicts.select("diff_id", "seq", "confirmed", F.col("confidence").alias("verdict"))
    rows = findings.join(v, ["diff_id", "seq"], "left")
    free = F.col("severity") < min_severity
    sure = F.coalesce("confirmed", F.lit(True)) & (F.coalesce("verdict", F.lit(0.5).cast(DOUBLE)) >= threshold)
    kept = rows.where(free | sure).withColumn("passed_through", free).drop("confirmed", "verdict")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("passed_through"), "seq")))


def reflect(findings: DataFrame, verdicts: DataFrame, min_score: int = 0) -> DataFrame:
    """Findings after a second opinion (diff_id, index, pos, action, severity, score, message) by place from 0.

    Of verdicts on one finding that with the greatest pos counts. drop removes, adjust sets severity and message, anything
    else sets the message; scores above 0 but under min_score remove too.
    """
    last = verdicts.groupBy("diff_id", "index").agg(F.max_by(F.struct("action", "severity", "score", "message"), "pos").alias("v"))
    place = F.row_number().over(W.partitionBy("diff_id").orderBy("seq")) - 1
    rows = findings.withColumn("index", place).join(last, ["diff_id", "index"], "left")
    action, score = F.coalesce("v.action", F.lit("")), F.coalesce("v.score", F.lit(0))
    kept = rows.where((action != "drop") & ~((F.lit(min_score) > 0) & (score > 0) & (score < min_score)))
    message = F.when(F.coalesce("v.message", F.lit("")) != "", F.col("v.message")).otherwise(F.col("message"))
    severity = F.when(F.coalesce("v.action", F.lit("")) == "adjust", parse_severity(F.coalesce("v.severity", F.lit("")))).otherwise(F.col("severity"))
    return kept.withColumn("severity", severity).withColumn("message", message).drop("v", "index")


def model_confidence(findings: DataFrame, items: DataFrame) -> DataFrame:
    """findings with model_conf: that of the first item (diff_id, pos, file, line, confidence) at their place within (0, 1], else 0.6."""
    valid = items.where("confidence > 0 and confidence <= 1").groupBy("diff_id", "file", "line").agg(F.min_by("confidence", "pos").alias("_c"))
    return findings.join(valid, ["diff_id", "file", "line"], "left").withColumn("model_conf", F.coalesce("_c", F.lit(0.6).cast(DOUBLE))).drop("_c")


def default_confidence(confidence: Column) -> Column:
    return F.when((confidence > 0) & (confidence <= 1), confidence).otherwise(F.lit(0.6).cast(DOUBLE))


def failed(findings: DataFrame, fail_on: int) -> DataFrame:
    """(diff_id, max_severity, failed) of every diff with findings."""
    return findings.groupBy("diff_id").agg(F.coalesce(F.max("severity"), F.lit(0)).alias("max_severity"), F.bool_or(F.col("severity") >= fail_on).alias("failed"))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.5, "medium").otherwise("low")


def round2(value: Column) -> Column:
    """Rounds half up in binary, as (x * 100 + 0.5) cut off."""
    return F.floor(value * F.lit(100.0).cast(DOUBLE) + F.lit(0.5).cast(DOUBLE)) / F.lit(100.0).cast(DOUBLE)


def confidence_stats(findings: DataFrame, by: str = "diff_id") -> DataFrame:
    """(by, avg_confidence, high, low): mean rounded to 2 places, counts from 0.7 and under 0.5.

    Millionths are summed as whole numbers, so that the order of addition doesn't show in the mean.
    """
    mean = F.sum(F.round(F.col("confidence") * 1_000_000).cast("long")) / F.lit(1_000_000.0) / F.count("confidence")
    return findings.groupBy(by).agg(round2(mean).alias("avg_confidence"), F.count_if(F.col("confidence") >= 0.7).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity, by name, or worse ones."""
    return findings.where(F.col("severity") >= SEVERITIES.index(severity))


def first_of_diff(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of every diff in the order of seq."""
    return findings.withColumn("_n", F.row_number().over(W.partitionBy("diff_id").orderBy("seq"))).where(F.col("_n") <= n).drop("_n")


def sorted_fixes(fixes: DataFrame) -> DataFrame:
    """fixes with place from 1 within their diff: by priority, then the surer, then the finding's id."""
    return fixes.withColumn("place", F.row_number().over(W.partitionBy("diff_id").orderBy("priority", F.desc("confidence"), "finding_id")))


def placed(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """rows with place from 1 in an order within their key."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def counts(findings: DataFrame) -> DataFrame:
    """(diff_id, severity, concern, n): totals by severity, by concern and over all; the absent key is null."""
    return findings.groupingSets([["diff_id", "severity"], ["diff_id", "concern"], ["diff_id"]], "diff_id", "severity", "concern").agg(F.count("*").alias("n"))


def ranked(findings: DataFrame) -> DataFrame:
    """findings with rank: by severity from the worst, file, line, input order."""
    return findings.withColumn("rank", F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("severity"), "file", "line", "seq")))


def expectations_met(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, exp_id, met): whether a finding meets all that an expectation names.

    expected: case_id (a diff_id), exp_id, concern, min_severity, message_contains, file; empty fields don't count.
    """
    f = findings.select("diff_id", F.lower("concern").alias("_c"), F.col("severity").alias("_s"), F.lower("message").alias("_m"), F.lower("file").alias("_f"))
    e = expected.select("case_id", "exp_id", F.lower("concern").alias("c"), F.col("min_severity").alias("s"), F.lower("message_contains").alias("m"), F.lower("file").alias("fl"))
    ok = (F.col("case_id") == F.col("diff_id")) & ((F.col("c") == "") | (F.col("c") == F.col("_c"))) & ((F.col("s") == "") | (F.col("_s") >= parse_severity(F.col("s"))))
    ok = ok & ((F.col("m") == "") | F.contains("_m", F.col("m"))) & ((F.col("fl") == "") | (F.col("fl") == F.col("_f")))
    met = e.join(f, ok, "left_semi").select("case_id", "exp_id", F.lit(True).alias("_met"))
    return expected.select("case_id", "exp_id").join(met, ["case_id", "exp_id"], "left").select("case_id", "exp_id", F.coalesce("_met", F.lit(False)).alias("met"))


def eval_summary(results: DataFrame) -> DataFrame:
    """One row: passed, failed and pass_rate of (case_id, passed); the rate of no cases is 0."""
    n = F.count("*")
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.when(n == 0, F.lit(0.0)).otherwise(F.count_if("passed") / n).alias("pass_rate"))


# Fixes as (key words, weaknesses, title, category, effort, priority, confidence), in the order of the rules.
FIXES = [
    (["sql injection", "sqli"], ["CWE-89"], "Use parameterized queries to prevent SQL injection", "injection", "easy", 1, 0.85),
    (["xss", "cross-site scripting"], ["CWE-79"], "Escape or sanitize user input before rendering in HTML", "xss", "easy", 1, 0.85),
    (["hardcoded", "hard-coded", "secret", "credential", "api key", "password"], ["CWE-798"], "Move secrets to environment variables or a secret manager", "auth", "trivial", 2, 0.90),
    (["input validation", "missing validation", "unsanitized"], ["CWE-20"], "Add input validation middleware or handler-level checks", "input-validation", "moderate", 3, 0.80),
    (["weak crypto", "weak hash", "md5", "sha1", "des ", "rc4"], ["CWE-327", "CWE-328"], "Replace weak cryptographic algorithm with a modern alternative", "crypto", "moderate", 2, 0.90),
    (["path traversal", "directory traversal", "path injection"], ["CWE-22"], "Sanitize file paths with filepath.Clean and base-path check", "input-validation", "easy", 2, 0.85),
    (["ssrf", "server-side request forgery", "request forgery"], ["CWE-918"], "Validate outbound URLs against an allowlist", "ssrf", "moderate", 2, 0.80),
]


def finding_id() -> Column:
    return F.concat_ws(":", "file", F.col("line").cast("string"), "concern")


def fixes(findings: DataFrame) -> DataFrame:
    """(diff_id, finding_id, title, category, severity, estimated_effort, priority, confidence): the best fix of every finding id.

    The most confident rule wins, the earlier rule among equals, of the first finding with that id that it matches.
    """
    low = F.lower(F.concat_ws(" ", "concern", "message", "cwe"))

    def fix(k: int) -> Column:
        words, cwes, title, category, effort, priority, conf = FIXES[k]
        test = F.col("cwe").isin(cwes)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        row = F.struct(F.lit(-conf).alias("by"), F.lit(k).alias("rule"), F.col("seq").alias("at"), F.lit(title).alias("title"), F.lit(category).alias("category"), severity_name(F.col("severity")).alias("severity"), F.lit(effort).alias("estimated_effort"), F.lit(priority).alias("priority"), F.lit(conf).alias("confidence"))
        return F.when(test, row)

    rows = findings.select("diff_id", finding_id().alias("finding_id"), F.explode(F.array_compact(F.array(*map(fix, range(len(FIXES)))))).alias("x"))
    best = rows.groupBy("diff_id", "finding_id").agg(F.min("x").alias("x"))
    return best.select("diff_id", "finding_id", "x.title", "x.category", "x.severity", "x.estimated_effort", "x.priority", "x.confidence")


def sarif_level(severity: Column) -> Column:
    return F.when(severity >= 3, "error").when(severity == 2, "warning").when(severity == 1, "note").otherwise("none")


def _concern() -> Column:
    return F.when(F.col("concern") == "", "unknown").otherwise(F.col("concern"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(diff_id, seq, rule_id, level, text, uri, start_line, end_line): results of an interchange report, absent numbers null."""
    text = F.concat(F.col("message"), F.when(F.col("fix") != "", F.concat(F.lit("\n\nFix: "), F.col("fix"))).otherwise(""), F.when(F.col("reasoning") != "", F.concat(F.lit("\n\nReasoning: "), F.col("reasoning"))).otherwise(""))
    start = F.when((F.col("line") > 0) & (F.col("file") != ""), F.col("line"))
    end = F.when(start.isNotNull() & (F.col("end_line") > 0) & (F.col("end_line") != F.col("line")), F.col("end_line"))
    return findings.select("diff_id", "seq", _concern().alias("rule_id"), sarif_level(F.col("severity")).alias("level"), text.alias("text"), F.when(F.col("file") != "", F.col("file")).alias("uri"), start.alias("start_line"), end.alias("end_line"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(diff_id, rule_id, first_seq): distinct concerns in the order of first use."""
    return findings.groupBy("diff_id", _concern().alias("rule_id")).agg(F.min("seq").alias("first_seq"))


def sarif(findings: DataFrame, tool: str = "revspark", version: str = "dev") -> DataFrame:
    """(diff_id, report): one SARIF 2.1.0 document per diff."""
    r = sarif_rows(findings)
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")))
    place = F.when(F.col("uri").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct("text").alias("message"), place.alias("locations"))
    results = r.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", result.alias("r")))), lambda x: x["r"]).alias("results"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.concat("rule_id", F.lit(" check")).alias("text")).alias("shortDescription"))
    rules = sarif_rules(findings).groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", rule.alias("r")))), lambda x: x["r"]).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), "rules")
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")).alias("runs"))
    return results.join(rules, "diff_id").select("diff_id", F.to_json(log).alias("report"))


def markdown_report(findings: DataFrame) -> DataFrame:
    """(diff_id, report): findings by severity from the worst, with counts."""
    line = F.concat(F.lit("- "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("message"))
    per = findings.groupBy("diff_id", "severity").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]).alias("ls"))
    part = F.concat(F.lit("## "), F.upper(severity_name(F.col("severity"))), F.lit(" ("), F.size("ls").cast("string"), F.lit(")\n"), F.array_join("ls", "\n"))
    return per.groupBy("diff_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("severity", part.alias("p"))), asc=False), lambda x: x["p"]), "\n").alias("report"))


def quality_graph(findings: DataFrame, source: str, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, diff_id, severity, line, message_digest, file_digest) and edges (id, from_id, to_id) of bounded reports.

    Texts appear as digests only. Of every diff the first `limit` findings are shown; the report node counts all.
    """
    limit = limit if 0 < limit <= 1000 else 1000
    place = F.row_number().over(W.partitionBy("diff_id").orderBy("seq")) - 1
    report = F.concat(F.lit("review/"), digest(F.lit(source), F.col("diff_id").cast("string")))
    rows = first_of_diff(findings, limit).withColumn("_at", place).withColumn("_report", report)
    own = F.concat(F.lit("finding/"), digest(F.col("_report"), F.col("_at").cast("string"), F.col("concern"), severity_name(F.col("severity")), F.col("file"), F.col("line").cast("string"), F.col("end_line").cast("string"), F.col("message"), F.col("fix"), F.col("reasoning"), F.col("cwe")))
    rows = rows.withColumn("_id", own)
    nodes = rows.select(F.col("_id").alias("id"), F.lit("finding").alias("kind"), "diff_id", "severity", "line", digest(F.col("message")).alias("message_digest"), digest(F.col("file")).alias("file_digest"))
    top = findings.groupBy("diff_id").agg(F.max("severity").alias("severity"), F.count("*").cast("int").alias("line"))
    top = top.select(report.alias("id"), F.lit("report").alias("kind"), "diff_id", "severity", "line", F.lit("").alias("message_digest"), F.lit("").alias("file_digest"))
    edges = rows.select(F.concat(F.lit("contains/"), digest(F.col("_report"), F.col("_id"))).alias("id"), F.col("_report").alias("from_id"), F.col("_id").alias("to_id"))
    return nodes.unionByName(top), edges


def failed_metrics(nodes: DataFrame) -> DataFrame:
    """(node_id, name, value, threshold) of failed metrics of nodes (id, metrics)."""
    return nodes.select(F.col("id").alias("node_id"), F.explode("metrics").alias("m")).where("m.status = 'fail'").select("node_id", "m.name", "m.value", "m.threshold")


def top_issues(nodes: DataFrame, n: int) -> DataFrame:
    """The n failed metrics of greatest value; ties by node and name."""
    return failed_metrics(nodes).orderBy(F.desc("value"), "node_id", "name").limit(n)


def graph_spec(nodes: DataFrame) -> DataFrame:
    """(id, key, text): nodes' settings: path, type, number of metrics, each metric with two decimals."""
    metrics = F.transform("metrics", lambda m: F.struct(F.concat(F.lit("metric_"), m["name"]).alias("key"), F.format_string("%.2f", m["value"]).alias("text")))
    fixed = F.array(F.struct(F.lit("path").alias("key"), F.col("path").alias("text")), F.struct(F.lit("type").alias("key"), F.col("type").alias("text")), F.struct(F.lit("metrics").alias("key"), F.size("metrics").cast("string").alias("text")))
    return nodes.select("id", F.explode(F.concat(fixed, metrics)).alias("c")).select("id", "c.key", "c.text")


def severity_rank(name: str) -> int:
    return SEVERITIES.index(name) if name in SEVERITIES else 0


def contract(findings: DataFrame) -> DataFrame:
    """Findings under the names of the exchange format."""
    return findings.select("diff_id", "seq", F.col("concern").alias("category"), severity_name(F.col("severity")).alias("severity"), F.col("file").alias("path"), F.col("line").alias("start_line"), "end_line", "message", F.col("fix").alias("suggestion"), "cwe", "confidence")


def observed(nodes: DataFrame, at: str) -> DataFrame:
    """(id, subject): one event for each node's observation at a time given as text."""
    return nodes.select(F.concat(F.lit("observed/"), digest(F.col("id"), F.lit(at))).alias("id"), F.col("id").alias("subject"))
