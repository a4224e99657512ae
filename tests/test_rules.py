import random
import re

import pytest
from pyspark.sql import functions as F

from revspark.functions.regex import java_pattern
from revspark.operators import diff, rules, rulesets
from revspark.rules_catalog import RULES, Rule


def scan(spark, language, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line int, text string")
    return {(r["line"], r["rule_id"]) for r in rules.scan(rows, language).collect()}


POSITIVE = [
    ("go", "SEC-GO-001", 'q := fmt.Sprintf("SELECT * FROM t WHERE id=%s", id)'), ("go", "SEC-GO-002", "cmd := exec.Command(userInput)"), ("go", "SEC-GO-003", "os.Open(req.URL.Path)"),
    ("go", "SEC-GO-004", 'password := "hunter22"'), ("go", "SEC-GO-005", "InsecureSkipVerify: true"), ("go", "SEC-GO-006", "h := md5.New()"), ("go", "SEC-GO-007", "h := sha1.New()"),
    ("go", "SEC-GO-010", "\tdefer f.Close()"), ("go", "COR-GO-002", "go func() {"), ("python", "SEC-PY-002", "eval(x)"), ("python", "SEC-PY-004", "pickle.loads(b)"), ("python", "SEC-PY-005", "subprocess.run(c, shell=True)"),
    ("python", "SEC-PY-008", "yaml.load(f)"), ("typescript", "SEC-TS-001", "el.innerHTML = x"), ("javascript", "SEC-JS-002", "eval(x)"), ("rust", "SEC-RS-001", "unsafe {"), ("rust", "SEC-RS-002", "x.unwrap()"),
    ("c", "SEC-C-001", "strcpy(a, b);"), ("cpp", "SEC-CPP-003", "delete p;"), ("java", "SEC-JV-002", "new ObjectInputStream(s).readObject()"), ("ruby", "SEC-RB-005", "<%= x %>"), ("sql", "SEC-SQL-001", "drop table t"),
    ("sql", "SEC-SQL-003", "UNION ALL SELECT 1"), ("go", "SEC-ANY-001", "// TODO fix auth"), ("python", "SEC-ANY-002", "-----BEGIN RSA PRIVATE KEY-----"), ("go", "SEC-ANY-003", "http://evil.org/x"), ("go", "PERF-ANY-001", "time.Sleep(1)"),
]


def test_positives(spark):
    for language in {p[0] for p in POSITIVE}:
        mine = [(r, t) for lang, r, t in POSITIVE if lang == language]
        got = scan(spark, language, *(t for _, t in mine))
        assert {(k, r) for k, (r, _) in enumerate(mine)} <= got


def test_negatives(spark):
    got = scan(spark, "go", 'exec.Command("ls")', "os.Open(filepath.Clean(req.Path))", 'password := "example-only"', "http://localhost:80", "md5.New() // cache")
    assert not {r for _, r in got} & {"SEC-GO-002", "SEC-GO-003", "SEC-GO-004", "SEC-ANY-003", "SEC-GO-006"}
    assert not {r for _, r in scan(spark, "python", "yaml.load(f, Loader=SafeLoader)")} & {"SEC-PY-008"}
    assert scan(spark, "ruby", "eval(x)") == set()
    assert scan(spark, "go", "", None) == set()


def test_catalogue():
    assert len(RULES) == 68 and len({r.rule_id for r in RULES}) == 68
    by = {r.rule_id: rules.confidence(r) for r in RULES}
    assert by["SEC-GO-001"] == 0.7999999999999999 and by["COR-GO-001"] == 0.5999999999999999 and by["SEC-PY-003"] == 0.7 and by["SEC-GO-002"] == 0.8999999999999999


def test_added_line_numbers(spark):
    raw = 'diff --git a/q.go b/q.go\n--- a/q.go\n+++ b/q.go\n@@ -10,6 +10,8 @@\n ctx\n+q := fmt.Sprintf("SELECT %s", x)\n'
    lines = diff.added_lines(spark.createDataFrame([(1, raw)], "diff_id long, raw string"))
    assert [(r["file"], r["line"]) for r in rules.scan(lines, "go").where("rule_id = 'SEC-GO-001'").collect()] == [("q.go", 11)]


def test_row_language_and_order(spark):
    rows = spark.createDataFrame([(1, 0, "a.go", 2, "h := md5.New()", "go"), (1, 1, "a.go", 1, "defer x()", "go"), (1, 2, "b.py", 1, "eval(x)", "python")], "diff_id long, seq long, file string, line int, text string, language string")
    found = rules.findings_of(rules.scan(rows)).orderBy("seq").collect()
    assert [(f["file"], f["line"], f["cwe"]) for f in found] == [("a.go", 2, "CWE-328"), ("a.go", 1, ""), ("b.py", 1, "CWE-95")]
    back = rules.finding_rule(rules.findings_of(rules.scan(rows))).orderBy("seq").collect()
    assert [f["rule_id"] for f in back] == ["SEC-GO-006", "SEC-GO-010", "SEC-PY-002"]


@pytest.mark.parametrize("path, globs, want", [
    ("a/go.sum", rules.DEFAULT_EXCLUDE, True), ("a/x.min.js", rules.DEFAULT_EXCLUDE, True), ("a/x.js", rules.DEFAULT_EXCLUDE, False), ("a/b/c.go", ["a/*.go"], False), ("a/c.go", ["a/*.go"], True),
    ("x.go", ["[a"], False), ("x1.go", ["x?.go"], True), ("xa.go", ["x[^0-9].go"], True), ("x.go", [], False), ("a/x.generated.ts", rules.DEFAULT_EXCLUDE, True),
])
def test_excluded(spark, path, globs, want):
    assert spark.range(1).select(rules.excluded(F.lit(path), globs)).first()[0] is want


def test_languages(spark):
    names = {"A.GO": "go", "x.tsx": "typescript", "x.jsx": "javascript", "x.h": "c", "x.hpp": "cpp", "x.txt": "any", "": "any"}
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", rules.detect_language(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == names


def test_keyword_checks(spark):
    rows = spark.createDataFrame([("a.go", '  db.Query("x" + y)'), ("a.go", 'api_key = "secret1"'), ("a.py", "exec.Command(a + b)"), ("a.rb", 'f = Open("../x")'), ("a.go", "doSomething(x)"), ("a.go", "return f(xxxxxxx)")], "path string, text string")
    got = sorted((r["path"], r["check_id"], r["confidence"]) for r in rules.keyword_checks(rows).collect())
    assert got == [("a.go", "hardcoded-secret", 0.5), ("a.go", "hardcoded-secret", 0.5), ("a.go", "sql-injection", 0.6), ("a.go", "unchecked-error", 0.3), ("a.go", "unchecked-error", 0.3), ("a.rb", "path-traversal", 0.5)]


def test_conventions(spark):
    texts = ["Never use global state, please", "don't use panic.", "Avoid time.Sleep", "Use slog not log", "nothing here"]
    rows = spark.createDataFrame([(t,) for t in texts], "rule string")
    got = {r["rule"]: (r["name"], r["pattern"]) for r in rules.parse_conventions(rows).collect()}
    assert got[texts[0]] == ("no-global-state", r"(?i)\bglobal state\b")
    assert got[texts[1]] == ("avoid-panic", r"(?i)\bpanic\b")
    assert got[texts[2]][0] == "avoid-time" and got[texts[3]] == ("prefer-alternative", r"(?i)\blog\b") and got[texts[4]] == (None, None)


def test_routes(spark):
    d = spark.createDataFrame([(1, "+x"), (2, "+func f() { password }"), (3, None)], "diff_id long, raw string")
    got = {}
    for r in rules.route_concerns(d, ["security", "test_coverage"]).collect():
        got.setdefault(r["diff_id"], set()).add(r["concern"])
    assert got == {2: {"security", "test_coverage"}}
    got = [(r["diff_id"], r["concern"]) for r in rules.route_concerns(d, ["security", "correctness"]).where("diff_id = 1").collect()]
    assert got == [(1, "correctness")]


def test_translated_patterns_compile(spark):
    patterns = [p for r in RULES for p in (r.pattern, r.antipattern) if p]
    row = spark.range(1).select(*(F.rlike(F.lit("x = 'y' // test"), F.lit(java_pattern(p))).alias(f"c{k}") for k, p in enumerate(patterns))).first()
    assert len(row) == 117


def test_required_strings():
    """One of the strings stands in every match; patterns that need none, or only short ones, are always run."""
    assert rulesets.required(r"fmt\.Sprintf\s*\(") == ["fmt.sprintf"]
    assert rulesets.required(r"(?i)(?:SELECT|Insert)\s") == ["insert", "select"]
    assert rulesets.required(r"a*foo+bar?") == ["foo"] or rulesets.required(r"a*foo+bar?") is None
    for pattern in (r"\w+", r"(?:abc)?x", r"abc|\d", r"ab", r"\pL(", "[unclosed"):
        assert rulesets.required(pattern) is None
    for r in RULES:
        for word in rulesets.required(r.pattern) or ():
            assert word == word.casefold() and len(word) >= rulesets.SHORTEST


def test_rules_as_rows(spark):
    """Rules as rows hit what literal rules hit."""
    lines = [r.pattern.replace("\\", "") for r in RULES] + ['password = "abcdefgh12"', "exec.Command(x)", 'fmt.Sprintf("SELECT %s", x)', "eval(x)", "", None, "PAſſWORD := \"abcdefgh1\"", "h := md5.New()"]
    rows = spark.createDataFrame([(k, t, lang) for k, t in enumerate(lines) for lang in ("go", "python", "any")], "k int, text string, language string")
    table = rulesets.as_rows(spark, RULES)
    for how in ({}, {"language": "go"}):
        want = sorted((x["k"], x["language"], x["rule_id"], x["confidence"]) for x in rules.scan(rows, **how).collect())
        assert sorted((x["k"], x["language"], x["rule_id"], x["confidence"]) for x in rulesets.scan(rows, table, **how).collect()) == want and want
    assert rulesets.scan(rows, table.where("false")).count() == 0 and rulesets.scan(rows.where("false"), table).count() == 0


def test_five_thousand_rules(spark):
    """The hits of many rules are those of each alone; the expressions that run are few, whatever the number of rules."""
    r = random.Random(1)
    patterns = [[rf"\bname{k}\s*\(", rf"(?i)key_{k}|token_{k}x", rf"call{k}\.(?:open|read)\w+", rf'"lit{k}"\s*\+'][k % 4] for k in range(5000)]
    lines = [" ".join(r.choice([f"name{j} (", f"KEY_{j}", f"call{j}.opens", f'"lit{j}" +', "plain words", f"xname{j}("]) for j in r.sample(range(5000), 4)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, text string")
    made = [Rule(f"R{k}", "n", "any", "low", "c", "", p, rf"plain.*name{k}" if k % 8 == 0 else None, "d", "f") for k, p in enumerate(patterns)]
    compiled = [(x.rule_id, re.compile(x.pattern, re.ASCII), x.antipattern) for x in made]
    want = sorted((k, i) for k, t in enumerate(lines) for i, p, no in compiled if p.search(t) and not (no and re.search(no, t)))
    got = sorted((x["k"], x["rule_id"]) for x in rulesets.scan(rows, rulesets.as_rows(spark, made), "go").collect())
    assert got == want and len(want) > 300
    tried = rulesets.candidates(rows, dict(enumerate(patterns))).agg(F.sum(F.size("rule_nos"))).first()[0]
    assert len(want) <= tried < 30 * len(lines)
