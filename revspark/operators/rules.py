"""Line scans: the rule catalogue, keyword checks, conventions, exclusions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java_pattern
from ..rules_catalog import RULES, Rule
from ..schemas import SEVERITIES

# File name endings of languages, names excluded by default.
LANGUAGES = [
    ("go", [".go"]), ("python", [".py"]), ("typescript", [".ts", ".tsx"]), ("javascript", [".js", ".jsx"]), ("rust", [".rs"]),
    ("c", [".c", ".h"]), ("cpp", [".cpp", ".cc", ".cxx", ".hpp"]), ("java", [".java"]), ("ruby", [".rb"]), ("sql", [".sql"]),
]
DEFAULT_EXCLUDE = ["go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.min.js", "*.min.css", "*.map", "*.generated.*"]
PRONE_TO_FALSE_ALARMS = ["COR-GO-001", "COR-GO-002", "PERF-GO-003", "PERF-PY-001", "SEC-ANY-003"]
CONFIRMING_WORDS = ["without", "unsanitized", "injection", "traversal", "hardcoded", "disabled", "deprecated"]


#: In place of a language: rules of all languages.
EVERY = "*"


def detect_language(path: Column) -> Column:
    """The language of a file name, `any` for unknown ones."""
    name = F.lower(path)
    out = F.lit("any")
    for language, endings in reversed(LANGUAGES):
        out = F.when(reduce(or_, (F.endswith(name, F.lit(e)) for e in endings)), language).otherwise(out)
    return out


def confidence(rule: Rule) -> float:
    """Confidence of a rule's findings; depends on the rule alone."""
    value = 0.7
    if rule.antipattern is not None:
        value += 0.1
    if any(w in rule.message.lower() for w in CONFIRMING_WORDS):
        value += 0.1
    if rule.rule_id in PRONE_TO_FALSE_ALARMS:
        value -= 0.2
    return min(max(value, 0.0), 1.0)


#: Characters beyond ASCII that Java takes for ASCII letters where case doesn't matter.
_FOLDED = "\u017f\u0130\u0131\u212a"


def _may_match(text: Column, low: Column, pattern: str) -> Column | None:
    """Whether a text holds one of the strings without which the pattern can't match; None: there are none. low: the text in lower case.

    A search for bytes costs a small part of a regular expression. Where the pattern ignores case anywhere, all of it is taken to.
    """
    from .rulesets import needed

    found = needed(pattern.replace("(?i)", ""))
    if not found or not all(s.isascii() and len(s) > 1 for s in found):
        return None
    if "(?i" not in pattern:
        return reduce(or_, (F.contains(text, F.lit(s)) for s in sorted(found)))
    return reduce(or_, (F.contains(low, F.lit(s)) for s in sorted({s.lower() for s in found}))) | reduce(or_, (F.contains(text, F.lit(c)) for c in _FOLDED))


def _hits(text: Column, low: Column, rules: list[Rule], order: dict[str, int]) -> Column:
    """Places in the catalogue of the rules that a line matches. Patterns are literals, compiled once per task, and run where a line holds what they need."""

    def hit(r: Rule) -> Column:
        found = F.rlike(text, F.lit(java_pattern(r.pattern)))
        may = _may_match(text, low, r.pattern)
        if may is not None:
            found = may & found
        if r.antipattern is not None:
            found = found & ~F.rlike(text, F.lit(java_pattern(r.antipattern)))
        return F.when(found, F.lit(order[r.rule_id]))

    return F.array_compact(F.array(*map(hit, rules)))


def rules_table(spark, rules: list[Rule] = RULES) -> DataFrame:
    """The catalogue as a relation; its size is fixed, so that it may be broadcast."""
    rows = [(k, r.rule_id, r.language, SEVERITIES.index(r.severity), r.category, r.cwe, r.message, r.fix, confidence(r), r.antipattern is not None) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, rule_language string, severity int, category string, cwe string, message string, fix string, confidence double, has_antipattern boolean")


def scan(rows: DataFrame, language: str | None = None, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """rows joined with the rules that their text matches, one row each.

    language: only rules of it and of any language; EVERY: all given rules. None: each row's `language` column decides.
    Lines that match nothing leave in the scan; only hits meet the catalogue.
    """
    order = {r.rule_id: k for k, r in enumerate(rules)}
    low = F.col("_low")
    if language is not None:
        chosen = [r for r in rules if language == EVERY or r.language in (language.lower(), "any")]
        hits = _hits(F.col(text), low, chosen, order)
    else:
        parts = [F.when(F.col("language") == name, _hits(F.col(text), low, [r for r in rules if r.language == name], order)) for name in dict.fromkeys(r.language for r in rules) if name != "any"]
        hits = F.concat(F.coalesce(*parts, F.array().cast("array<int>")), _hits(F.col(text), low, [r for r in rules if r.language == "any"], order))
    found = rows.withColumn("_low", F.lower(text)).withColumn("rule_no", F.explode(hits)).drop("_low")
    return found.join(F.broadcast(rules_table(rows.sparkSession, rules)), "rule_no")


def findings_of(hits: DataFrame) -> DataFrame:
    """Findings of scanned lines (diff_id, seq, file, line, ...), in the order file, rule, line."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("diff_id").orderBy("file", "rule_no", "line", "seq")).cast("long")
    return hits.select(
        "diff_id", seq.alias("seq"), F.concat(F.lit("static:"), "category").alias("concern"), "severity", "file", "line", F.lit(0).alias("end_line"), "message", "fix",
        F.lit("").alias("reasoning"), "cwe", "confidence", F.lit(True).alias("sast_source"),
    )


def finding_rule(findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """findings with rule_id, the first rule of their concern whose id their message holds; null without any."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when((F.col("concern") == f"static:{r.category}") & F.contains("message", F.lit(r.rule_id)), r.rule_id).otherwise(out)
    return findings.withColumn("rule_id", out)


def glob_pattern(glob: str) -> str | None:
    """A file-name glob as an anchored regular expression; null if it is malformed. * and ? stop at /."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", at + 2)
            if end < 0:
                return None
            body = glob[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body).replace("\\", "\\\\") + "]")
            at = end
        elif c == "\\":
            at += 1
            if at >= len(glob):
                return None
            out.append(re.escape(glob[at]))
        else:
            out.append(re.escape(c))
        at += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def excluded(path: Column, globs: list[str] = DEFAULT_EXCLUDE) -> Column:
    """Whether a glob with / matches the path, or another one its last part."""
    base = F.regexp_extract(path, r"[^/]*\z", 0)
    tests = [F.lit(False)]
    for g in globs:
        pattern = glob_pattern(g)
        if "/" not in g:
            tests.append(base == g)
        if pattern is not None:
            tests.append(F.rlike(path if "/" in g else base, F.lit(pattern)))
    return reduce(or_, tests)


# Keyword checks with their languages, as (check, rule, message, severity, confidence).
SECRET_WORDS = ["password", "secret", "api_key", "apikey", "token", "private_key"]
CHECK_LANGUAGES = {"sql-injection": ["go", "python", "java", "php", "ruby"], "command-injection": ["go", "python", "ruby", "php"], "unchecked-error": ["go"]}
NOT_CALLS = ["//", "defer", "go ", "if ", "for ", "return ", "func "]


def _holds(text: Column, *parts: str) -> Column:
    return reduce(and_, (F.contains(text, F.lit(p)) for p in parts))


def extension(path: Column) -> Column:
    """From the last dot of a path's last part on, the dot included; empty without one."""
    return F.regexp_extract(F.regexp_extract(path, r"[^/\\]*\z", 0), r"\.[^.]*\z", 0)


def applies_to(check: str, path: Column) -> Column:
    """Whether a check's languages name the path's extension, with or without its dot; no languages: always."""
    languages = CHECK_LANGUAGES.get(check)
    return F.lit(True) if not languages else extension(path).isin([*languages, *("." + x for x in languages)])


def keyword_checks(rows: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """rows with check_id, message, severity, confidence and evidence of every keyword check that their text meets."""
    t, low = F.col(text), F.lower(F.col(text))
    trimmed = F.regexp_replace(t, r"\A[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+\z", "")

    def found(check: str, rule: str, message: str, severity: int, confidence: float, test: Column) -> Column:
        row = F.struct(F.lit(check).alias("check_id"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), trimmed.alias("evidence"))
        return F.when(test & applies_to(check, F.col(path)), row)

    real = _holds(t, "=", '"') & ~F.contains(low, F.lit("test")) & ~F.contains(low, F.lit("example")) & ~F.contains(low, F.lit("xxx"))
    call = _holds(trimmed, "(", ")") & ~F.contains(trimmed, F.lit("=")) & (F.octet_length(trimmed) > 10)
    checks = [
        found("sql-injection", "SQL Injection", "Potential SQL injection via fmt.Sprintf", 4, 0.7, _holds(t, "fmt.Sprintf", "SELECT")),
        found("sql-injection", "SQL Injection", "Potential SQL injection via string concatenation", 4, 0.6, _holds(t, "Query(", "+")),
        *(found("hardcoded-secret", "Hardcoded Secret", f"Potential hardcoded {w}", 3, 0.5, _holds(low, w) & real) for w in SECRET_WORDS),
        found("command-injection", "Command Injection", "Potential command injection via string concatenation", 4, 0.6, _holds(t, "exec.Command", "+")),
        found("path-traversal", "Path Traversal", "Potential path traversal with ../ in file operation", 3, 0.5, (_holds(t, "../") | _holds(t, "..\\\\")) & (_holds(t, "Open") | _holds(t, "Read") | _holds(t, "Write"))),
        found("unchecked-error", "Unchecked Error", "Possible unchecked error return", 2, 0.3, call & ~reduce(or_, (F.startswith(trimmed, F.lit(p)) for p in NOT_CALLS))),
    ]
    return rows.withColumn("_c", F.explode(F.array_compact(F.array(*checks)))).select(*rows.columns, "_c.*")


def parse_conventions(rules: DataFrame) -> DataFrame:
    """(rule, name, pattern) of written conventions: never use X; don't use, do not use or avoid X; use X not Y."""
    low = F.lower("rule")

    def phrase(after: Column) -> Column:
        cut = F.regexp_extract(F.trim(after), r"(?s)\A(.[^.,;!?()]*)", 1)
        return F.trim(F.substring(cut, 1, 40))

    def rest(prefix: str) -> Column:
        return F.when(F.contains(low, F.lit(prefix)), phrase(F.substring(low, F.instr(low, prefix) + len(prefix), F.length(low))))

    def row(kind: str, thing: Column) -> Column:
        name = F.lit("prefer-alternative") if kind == "prefer" else F.concat(F.lit(kind), F.replace(thing, F.lit(" "), F.lit("-")))
        quoted = F.regexp_replace(thing, r"([\\.+*?()|\[\]{}^$])", r"\\$1")
        return F.when(thing.isNotNull(), F.struct(name.alias("name"), F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\b")).alias("pattern"), thing.alias("thing")))

    kinds = [row("no-", rest("never use ")), *(row("avoid-", rest(p)) for p in ("don't use ", "do not use ", "avoid ")), row("prefer", rest(" not "))]
    return rules.select("rule", F.coalesce(*kinds).alias("_r")).select("rule", "_r.*")


def path_matches(path: Column, pattern: str) -> Column:
    """Small globs: * is everything, *.x an ending, anything else a part of the path."""
    if pattern == "*":
        return F.lit(True)
    return F.endswith(path, F.lit(pattern[1:])) if pattern.startswith("*.") else F.contains(path, F.lit(pattern))


def convention_check(rows: DataFrame, conventions: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """rows with the name of every convention (name, RE2 pattern) that their text breaks."""
    hits = [F.when(F.rlike(text, F.lit(java_pattern(p))), F.lit(name)) for name, p in conventions]
    return rows.withColumn("convention", F.explode(F.array_compact(F.array(*hits))))


# Signals that switch review concerns on.
SECURITY_SIGNALS = ["auth", "password", "token", "secret", "crypto", "hash", "session", "cookie", "cors", "csrf", "sql", "exec", "eval", "inject", "sanitize", "escape", "permission", "role", "admin"]
PERFORMANCE_SIGNALS = ["loop", "for ", "while", "range", "append", "map[", "query", "select ", "join", "cache", "pool", "buffer", "batch"]
TEST_SIGNALS = ["_test.go", "test_", ".test.", "spec."]
CONCERNS = ["security", "correctness", "performance", "maintainability", "style", "test_coverage"]


def route_concerns(diffs: DataFrame, enabled: list[str] = CONCERNS) -> DataFrame:
    """(diff_id, concern): the enabled concerns that a diff's text calls for.

    security, performance and test_coverage need their signals, the others always apply; if none
    does, correctness and maintainability do.
    """
    low = F.lower(F.coalesce("raw", F.lit("")))

    def any_of(words: list[str]) -> Column:
        return reduce(or_, (F.contains(low, F.lit(w)) for w in words))

    new_code = F.rlike(low, F.lit(r"(?dm)^\+.*(?:func |def |function )"))
    tests = {"security": any_of(SECURITY_SIGNALS), "performance": any_of(PERFORMANCE_SIGNALS), "test_coverage": new_code & ~any_of(TEST_SIGNALS)}
    on = F.array_compact(F.array(*(F.when(tests.get(c, F.lit(True)), F.lit(c)) for c in enabled)))
    fallback = F.array(*(F.lit(c) for c in enabled if c in ("correctness", "maintainability"))).cast("array<string>")
    return diffs.select("diff_id", F.explode(F.when(F.size(on) > 0, on).otherwise(fallback)).alias("concern"))
