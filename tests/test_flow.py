"""Data flow, symbols, budgets, answers, files and streams."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from revspark.functions import text as T
from revspark.operators import assist, budget, diff, flow, responses, symbols, taint
from revspark.plans import answers as answers_table
from revspark.plans import assistants
from revspark.plans.review import Review, ask, echo_provider
from revspark.plans.store import stored
from revspark.sources import files, git
from revspark.streaming import cursors, incremental


def track(spark, *rows, file="a.go"):
    raw = f"+++ b/{file}\n@@ -1 +1,99 @@\n" + "\n".join(rows)
    lines = diff.new_side(spark.createDataFrame([(1, raw)], "diff_id long, raw string"))
    return sorted((r["line"], r["variable"], r["source"], r["cwe"]) for r in taint.track(lines).collect())


def test_parameter_to_sink(spark):
    got = track(spark, "+func h(name string, n int) {", '+ q := "select " + name', "+ rows := db.Query(q)", "+}")
    assert (3, "q", "function-parameter", "CWE-89") in got


def test_sources(spark):
    assert (2, "x", "os.Getenv", "CWE-78") in track(spark, '+x := os.Getenv("A")', "+exec.Command(x)")
    assert (2, "v", "http-form-value", "CWE-22") in track(spark, '+v := r.FormValue("f")', "+os.Open(v)")
    assert (2, "a", "os.Args", "CWE-22") in track(spark, "+a := os.Args[1]", "+os.ReadFile(a)")


def test_sanitised_and_cleared(spark):
    assert track(spark, '+given := r.FormValue("f")', "+tidy := filepath.Clean(given)", "+os.Open(tidy)") == []
    assert track(spark, '+given := r.FormValue("f")', '+given = "const"', "+os.Open(given)") == []
    assert track(spark, '+given := r.FormValue("f")', "+os.Open(filepath.Clean(given))") == []
    # Names match as parts of a line.
    assert track(spark, '+p := r.FormValue("f")', "+os.Open(q)") == [(2, "p", "http-form-value", "CWE-22")]


def test_function_resets(spark):
    assert track(spark, '+p := r.FormValue("f")', "+func g(z int) {", "+os.Open(p)") == []


def test_context_lines_carry_but_do_not_report(spark):
    assert track(spark, ' p := r.FormValue("f")', " os.Open(p)", "+os.Open(p)") == [(3, "p", "http-form-value", "CWE-22")]
    assert track(spark, "+x := os.Args[1]", "+os.Open(x)", file="a.py") == [] and track(spark, "") == []


def plain_track(lines):
    """The tracker line by line, over (file, line, text, added) in order."""
    clean = re.compile("|".join(taint.SANITIZERS), re.ASCII)
    state, out, of_file = {}, [], None
    for file, line, text, added in lines:
        state = {} if file != of_file else state
        of_file, text = file, text.strip()
        if m := re.search(taint.SIGNATURE, text, re.ASCII):
            names = [w[0] for w in (p.split() for p in m[2].split(",")) if w and w[0] not in taint.BUILTIN_TYPES]
            state = dict.fromkeys(names, ([n for n, p in taint.SOURCES[1:] if re.search(p, text, re.ASCII)] or [taint.PARAMETER])[-1])
            continue
        if m := re.search(taint.ASSIGNMENT, text, re.ASCII):
            found = None if clean.search(m[2]) else next((n for n, p in taint.SOURCES if re.search(p, m[2], re.ASCII)), None) or next((state[v] for v in sorted(state) if v in m[2]), None)
            state.pop(m[1], None)
            if found:
                state[m[1]] = found
        if added and not clean.search(text):
            out += [(file, line, v, state[v], s[0]) for s in taint.SINKS if re.search(s[5], text, re.ASCII) for v in state if v in text]
    return sorted(out)


@pytest.mark.parametrize("chunk_lines, chunks", [(1, 2), (3, 2), (7, 3), (1024, 1024)])
def test_track_in_chunks(spark, chunk_lines, chunks):
    """Chunks of any size give what one pass over the lines gives: names that contain one another, long functions, resets, clears and copies."""
    r = random.Random(chunk_lines)
    names = ["a", "ab", "b", "c", "cd", "d"]
    kinds = [lambda: f"func f{r.randint(0, 9)}({r.choice(names)} string, r *http.Request) error {{", lambda: f'{r.choice(names)} := r.FormValue("x")', lambda: f"{r.choice(names)} = os.Args[1]", lambda: f"{r.choice(names)} := {r.choice(names)} + {r.choice(names)}",
        lambda: f"{r.choice(names)} := 1", lambda: f"{r.choice(names)} := filepath.Clean({r.choice(names)})", lambda: f"exec.Command({r.choice(names)})", lambda: f"db.Query({r.choice(names)}).Execute({r.choice(names)})", lambda: "}"]
    weights = [1, 2, 2, 12, 4, 2, 8, 6, 3]
    rows, want = [], {}
    for diff_id in range(3):
        mine = []
        for file in ("x.go", "y.go"):
            mine += [(file, k, r.choices(kinds, weights)[0](), r.random() < 0.8) for k in range(60)]
        rows += [(diff_id, seq, *x) for seq, x in enumerate(mine)]
        want[diff_id] = plain_track(mine)
    lines = spark.createDataFrame(rows, "diff_id long, seq long, file string, line int, text string, added boolean")
    got = taint.track(lines, chunk_lines, chunks).collect()
    for d in want:
        assert sorted((x["file"], x["line"], x["variable"], x["source"], x["sink"]) for x in got if x["diff_id"] == d) == want[d] and want[d]


def test_reachability(spark):
    r = random.Random(1)
    for _ in range(3):
        edges = [(r.randrange(40), r.randrange(40), r.choice(["passthrough", "store", "arg", "sanitizer", "sink"])) for _ in range(70)]
        df = spark.createDataFrame([(a, b, k, "SQL" if k == "sink" else None) for a, b, k in edges], "src long, dst long, kind string, sink_kind string")
        seeds = spark.createDataFrame([(0, "b"), (1, "a")], "node long, source string")
        best = {0: "b", 1: "a"}
        todo = [0, 1]
        while todo:
            x = todo.pop()
            for a, b, k in edges:
                if a == x and k not in ("sanitizer", "sink") and (b not in best or best[x] < best[b]):
                    best[b] = best[x]
                    todo.append(b)
        reached = taint.reach(seeds, df, lambda d: stored(d, "t"))
        assert {x["node"]: x["source"] for x in reached.collect()} == best
        values = spark.range(40).select(F.col("id").alias("value_id"), F.lit("f").alias("pos_file"), F.col("id").cast("int").alias("pos_line"))
        got = {(x["line"], x["source"]) for x in taint.sink_findings(reached, df, values).collect()}
        want = {}
        for a, b, k in edges:
            if k == "sink" and a in best:
                want[b] = min(want.get(b, "z"), best[a])
        assert got == set(want.items())


def matched(edges, seeds):
    """Values reached on paths whose returns match their calls, by closing the relation of balanced paths over all pairs of values."""
    nodes = {x for a, b, *_ in edges for x in (a, b)} | set(seeds)
    same = {(x, x) for x in nodes} | {(a, b) for a, b, k, _ in edges if k == "flow"}
    while True:
        more = {(a, d) for a, b in same for c, d in same if b == c}
        more |= {(a, x) for a, p, k, s in edges if k == "arg" for r, x, q, t in edges if q == "return" and s == t and (p, r) in same}
        if more <= same:
            break
        same |= more
    out, todo = {}, [(n, False, s) for n, s in seeds.items()]
    while todo:
        node, inside, source = todo.pop()
        if out.get((node, inside), "~") <= source:
            continue
        out[node, inside] = source
        todo += [(b, inside, source) for a, b in same if a == node]
        todo += [(b, True, source) for a, b, k, _ in edges if a == node and k == "arg"]
        todo += [(b, False, source) for a, b, k, _ in edges if a == node and k == "return" and not inside]
    best = {}
    for (node, _), source in out.items():
        best[node] = min(best.get(node, "~"), source)
    return best


def test_matched_calls(spark):
    """What enters a function at one call leaves at that call alone, also through recursion; sources inside functions go out to all callers."""
    keep = lambda d: stored(d, "t")
    one = [(1, 10, "arg", 1), (2, 10, "arg", 2), (10, 11, "flow", None), (11, 3, "return", 1), (11, 4, "return", 2)]
    schema = "src long, dst long, kind string, site long"
    for seeds, want in (({1: "s"}, {1, 10, 11, 3}), ({2: "s"}, {2, 10, 11, 4}), ({11: "s"}, {11, 3, 4})):
        got = flow.reach(spark.createDataFrame(list(seeds.items()), "node long, source string"), spark.createDataFrame(one, schema), keep).collect()
        assert {x["node"] for x in got} == want == set(matched(one, seeds))
    r = random.Random(7)
    for _ in range(2):
        edges = [(r.randrange(24), r.randrange(24), r.choice(["flow", "flow", "arg", "return"]), r.randrange(4)) for _ in range(34)]
        seeds = {0: "b", 1: "a", 2: "c"}
        got = flow.reach(spark.createDataFrame(list(seeds.items()), "node long, source string"), spark.createDataFrame(edges, schema), keep)
        assert {x["node"]: x["source"] for x in got.collect()} == matched(edges, seeds)


def test_calls_by_name(spark):
    """Sanitizers and sinks pass nothing on, helpers pass to their result, known functions are entered at the first place of a value, others end the flow."""
    calls = spark.createDataFrame(
        [(1, "fmt.Sprintf", 0, 1, 2), (2, "app.f", 0, 2, 5), (2, "app.f", 1, 2, 5), (2, "app.f", 2, 2, 5), (3, "net/url.QueryEscape", 0, 2, 6), (4, "other.g", 0, 2, 7), (5, "(*database/sql.DB).QueryRow", 1, 21, None), (6, "os.Getenv", 0, 9, 8), (7, "flag.Parse", 0, 9, 30), (8, "flag.String", 0, 9, 31), (9, "os/exec.Command", 0, 22, 32), (10, "os.Create", 0, 5, 33)],
        "site long, callee string, index int, arg long, result long",
    ).withColumns({"file": F.lit("a.go"), "line": F.col("site").cast("int")})
    params = spark.createDataFrame([("app.f", 0, 20, "*net/http.Request"), ("app.f", 1, 22, "string")], "callee string, index int, value long, type string")
    assert {tuple(x) for x in flow.seeds(calls, params).collect()} == {(20, "http.Request parameter"), (8, "os.Getenv"), (31, "command-line flag")}
    edges = flow.call_edges(calls, params, spark.createDataFrame([("app.f", 21)], "callee string, value long"))
    assert {tuple(x) for x in edges.collect()} == {(1, 2, "flow", 1), (2, 20, "arg", 2), (21, 5, "return", 2)}
    uses = spark.createDataFrame([("BinOp", 20, 21, None), ("If", 20, 22, None), ("Store", 20, 40, 41), ("Store", 20, 42, None)], "op string, src long, dst long, base long")
    every = edges.unionByName(flow.use_edges(uses))
    reached = flow.reach(spark.createDataFrame([(1, "s")], "node long, source string"), every, lambda d: stored(d, "t"))
    assert {x["node"] for x in reached.collect()} == {1, 2, 20, 21, 5, 40, 41, 42}
    assert [(x["line"], x["kind"], x["cwe"]) for x in flow.findings(reached, calls).collect()] == [(5, "SQL_INJECTION", "CWE-89"), (10, "PATH_TRAVERSAL", "CWE-22")]
    assert flow.findings(reached, calls, 1).count() == 1


def test_programs_are_not_broadcast(spark, tmp_path):
    """Parameters and returned values grow with the program: joins with calls leave them out of the driver, however small their files are."""
    rows = {"calls": ([(1, "app.f", 0, 1, 2)], "site long, callee string, index int, arg long, result long"), "params": ([("app.f", 0, 20)], "callee string, index int, value long"), "returns": ([("app.f", 21)], "callee string, value long")}
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}")
    edges = flow.call_edges(*(spark.read.parquet(f"{tmp_path}/{name}") for name in rows))
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in edges.collect()} == {(1, 20, "arg", 1), (21, 2, "return", 1)}


def test_rounds_leave_edges_in_place(spark):
    """Rounds of reachability neither shuffle nor sort the edges: what the last round found goes to their buckets."""
    plans = []

    def keep(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return stored(d, "t")

    edges = spark.createDataFrame([(1, 10, "arg", 1), (10, 11, "flow", None), (11, 3, "return", 1)], "src long, dst long, kind string, site long")
    got = flow.reach(spark.createDataFrame([(1, "s")], "node long, source string"), edges, keep)
    assert {x["node"] for x in got.collect()} == {1, 10, 11, 3}
    rounds = [p for p in plans if "outside" in p and "Join" in p]
    assert rounds and all("ShuffledHashJoin" in p and "SortMergeJoin" not in p and "Bucketed: true" in p for p in rounds)


def test_names_are_tested_as_literals(spark):
    """A pattern for all names of a kind, with their dots and brackets as they are; each test works the name out once."""
    rows = spark.createDataFrame([("x/strings.Join",), ("stringsxJoin",), ("strings.Joined",), ("strings.Join\n",), (None,)], "c string")
    assert [x[0] for x in rows.select(flow._ends(F.col("c"), flow.PASS_THROUGH)).collect()] == [True, False, False, False, None]
    rows = spark.createDataFrame([("(*database/sql.DB).QueryRow",), ("database/sql.Query",)], "c string")
    assert [x[0] for x in rows.select(flow.sink_callee(F.col("c"))).collect()] == [0, None]
    assert str(flow._ends(F.col("callee"), flow.FILE_CALLS)).count("callee") == 1


def test_taint_confidence(spark):
    row = spark.range(1).select(taint.confidence(F.lit("unknown")), taint.confidence(F.lit("os.Args")), taint.confidence(F.lit("x"), F.lit(9))).first()
    assert tuple(row) == (0.6000000000000001, 0.8, 0.0)
    parts = spark.range(1).select(taint.message_parts(F.lit("[T] a: src -> sink via variable x")).alias("m")).first()["m"]
    assert tuple(parts) == ("src", "sink")
    assert tuple(spark.range(1).select(taint.message_parts(F.lit("src → sink")).alias("m")).first()["m"]) == ("unknown", "unknown")


GO = "package p\n\nfunc (s *Srv) Run(x int) error {\n\tif x > 0 {\n\t\treturn nil\n\t}\n}\n\ntype Srv struct {\n\ta int\n}\nvar z = 1\nfunc one() {}\n"
PY = "class A:\n    def m(self):\n        return 1\n\n    async def n(self):\n        pass\n\ndef top(x):\n    return x\n"


def found(spark, text, ending, **kw):
    df = spark.createDataFrame([("f" + ending, text)], "path string, content string")
    return [(r["symbol"], r["kind"], r["start_line"], r["end_line"]) for r in symbols.search(df, ending, **kw).orderBy("start_line").collect()]


def test_symbols(spark):
    assert found(spark, GO, ".go") == [("Srv.Run", "method", 3, 7), ("Srv", "type", 9, 11), ("z", "var", 12, 13), ("one", "function", 13, 13)]
    assert found(spark, PY, ".py") == [("A", "class", 1, 7), ("m", "function", 2, 4), ("n", "function", 5, 7), ("top", "function", 8, 9)]
    assert found(spark, GO, ".go", name="srv", kind="TYPE") == [("Srv", "type", 9, 11)] and found(spark, "", ".go") == [] and found(spark, None, ".go") == []
    df = spark.createDataFrame([("a.go", GO)], "path string, content string")
    assert symbols.body(df, ".go", "run").first()["body"].startswith("func (s *Srv) Run") and symbols.body(df, ".go", "nope").count() == 0


@pytest.mark.parametrize("cell", [4, 4096])
def test_chunks(spark, monkeypatch, cell):
    """Next-fit of each diff, with files of no size and files over the budget, gaps in the numbers, and cells that split a diff."""
    monkeypatch.setattr(budget, "CELL", cell)
    r = random.Random(2)
    rows = [(d, 3 * k + d, r.choice([0, 0, r.randint(1, 60), r.randint(1, 60), 130])) for d in range(5) for k in range(1 if d == 4 else 40)]
    df = spark.createDataFrame(rows, "diff_id long, file_idx int, tokens long").repartition(3)
    got = {(x["diff_id"], x["file_idx"]): x["chunk"] for x in budget.chunk(df, 100).collect()}
    assert len(got) == len(rows)
    for d in range(5):
        n = used = held = 0
        for _, k, t in sorted(x for x in rows if x[0] == d):
            if used + t > 100 and held:
                n, used = n + 1, 0
            used, held = used + t, 1
            assert got[d, k] == n
    assert budget.chunk(df.where("false"), 100).count() == 0
    assert {x["chunk"] for x in budget.chunk(df, None).collect()} == {0}
    assert (budget.available(1000, 100), budget.available(250, 100), budget.available(0, 1)) == (700, 125, None)
    kept = budget.prefix_within(df, "diff_id", "file_idx", "tokens", -1)
    assert kept.count() == 5


def test_sections(spark):
    """Sections up to the first that doesn't fit what the joined text before it leaves."""
    r = random.Random(4)
    texts = [" ".join(r.choices(["word", "fooBar", "x_1", "é", "+", "\n"], k=r.randint(0, 40))) + "\n" for _ in range(60)] + [None]
    df = spark.createDataFrame([(k % 3, k, t) for k, t in enumerate(texts)], "diff_id long, file_idx long, text string")
    estimate = {x["t"]: x["n"] for x in spark.createDataFrame([(budget.DIFF_HEADER + "".join(texts[j] or "" for j in range(d, m, 3)),) for d in range(3) for m in range(62)] + [(t or "",) for t in texts], "t string").select("t", T.estimate_tokens(F.col("t")).alias("n")).collect()}
    for limit in (0, 30, 300, 9999):
        want = []
        for d in range(3):
            text = budget.DIFF_HEADER
            for k in range(d, len(texts), 3):
                if limit > 0 and estimate[text] + estimate[texts[k] or ""] > limit:
                    break
                text += texts[k] or ""
                want.append(k)
        assert sorted(x["file_idx"] for x in budget.sections_within(df, limit).collect()) == sorted(want)


def test_estimates(spark):
    """One pattern counts the words that look like code, as is_code_word judges each."""
    r = random.Random(8)
    texts = ["".join(r.choices("aAbB1_$é \tÄ+.", k=r.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = df.select("t", F.filter(F.regexp_extract_all("t", F.lit(T.WORD), F.lit(0)), T.is_code_word).alias("w"), T.token_counts(F.col("t")).alias("c")).collect()
    for x in plain:
        symbols = sum(not c.isspace() and not re.fullmatch(r"[\w$]", c) for c in x["t"])
        assert x["c"]["code"] == len(x["w"]) + symbols


RAW = [{"file": "a.go", "line": 3, "severity": "HIGH", "message": "m", "confidence": 0.9}, {"file": "", "message": "dropped"}, {"file": "b", "message": "n", "confidence": 7}]


def test_answers(spark):
    good = json.dumps(RAW)
    texts = {
        1: f"```json\n{good}\n```", 2: f"Sure:\n{good}\nBye", 3: "[\n// note\n" + '{"file": "a.go", "line": 3, "severity": "high", "message": "m", "confidence": 0.9,},\n]',
        4: 'broken {"file": "a.go", "line": 3, "severity": "high", "message": "m", "confidence": 0.9', 5: 'it is {"file": "a.go", "line": 3, "severity": "high", "message": "m"} ok', 6: "nothing", 7: None, 8: "[]", 9: '["x"',
    }
    df = spark.createDataFrame([(k, "sec", t) for k, t in texts.items()], "diff_id long, concern string, content string")
    got = {}
    for x in responses.findings(df).orderBy("pos").collect():
        got.setdefault(x["diff_id"], []).append((x["file"], x["line"], x["severity"], x["message"], x["confidence"]))
    first = ("a.go", 3, 3, "m", 0.9)
    assert got == {1: [first, ("b", 0, 0, "n", 0.6)], 2: [first, ("b", 0, 0, "n", 0.6)], 3: [first], 5: [("a.go", 3, 3, "m", 0.6)]}


def test_verdicts(spark):
    def verdict(t):
        return tuple(spark.range(1).select(responses.filter_verdict(F.lit(t)).alias("v")).first()["v"])

    assert verdict("CONFIRMED: yes\nCONFIDENCE: 0.8\nREASONING: sure \nmore") == (True, 0.8, "sure")
    assert verdict("confirmed: No") == (False, 0.7, "") and verdict("") == (True, 0.7, "")
    assert verdict("A false positive.\nconfidence: 3") == (False, 0.7, "")


def test_assist(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    text = "\n".join(str(k) for k in range(1, 21))
    assert one(assist.code_context(F.lit(text), F.lit(3))) == "1\n2\n3\n4\n5\n6\n7\n8"
    assert one(assist.code_context(F.lit(text), F.lit(19))) == "15\n16\n17\n18\n19\n20" and one(assist.code_context(F.lit(text), F.lit(99))) == ""
    assert one(assist.relevant_diff(F.lit(DIFF + "diff --git a/z b/z\n--- a/z\n+z"), F.lit("q.go"), F.lit(2))) == "\n".join(DIFF.rstrip("\n").split("\n")[3:])
    assert one(assist.relevant_diff(F.lit(DIFF), F.lit("nope"), F.lit(2))) == "" and one(assist.relevant_diff(F.lit(DIFF), F.lit("q.go"), F.lit(7))).startswith("+q :=") is False
    assert tuple(one(assist.parse_fix(F.lit("FIXED:\n x \nEXPLANATION: y ")))) == ("x", "y", 0.7) and one(assist.parse_fix(F.lit("EXPLANATION: y"))) is None and tuple(one(assist.parse_fix(F.lit("FIXED: z")))) == ("z", "", 0.7)
    assert len(one(assist.parse_improvements(F.lit('[{"file": "a", "description": "d", "after": "x"}, {"file": "a"}]')))) == 1
    assert tuple(one(assist.parse_description(F.lit("no json"), F.lit("p"), F.lit("s")))) == ("Update p", "s", "chore", "low")
    assert one(assist.fused_prompt(F.lit("a<diff_content>b"), F.lit("S"))) == "aS\n<diff_content>b" and one(assist.fused_prompt(F.lit("ab"), F.lit("S"))) == "S\nab" and one(assist.fused_prompt(F.lit("ab"), F.lit(""))) == "ab"


def test_validation(spark):
    f = spark.createDataFrame([(1, 0, "security", 3, "a.go", 2, "m", "", "x\ny")], "diff_id long, seq long, concern string, severity int, file string, line int, message string, fix string, content string")
    asked = f.withColumn("code_context", assist.code_context(F.col("content"), F.col("line"))).withColumn("prompt", assist.validation_prompt()).withColumn("system_prompt", F.lit(""))
    no = ask(asked.drop("content"), lambda s, p: "CONFIRMED: no" if "a.go:2" in p and "high" in p else "?")
    assert assist.verdicts(no).first()["confirmed"] is False

    def broken(s, p):
        raise OSError("x")

    assert tuple(assist.verdicts(ask(asked.drop("content"), broken)).first())[2:4] == (True, 0.5)


DIFF = 'diff --git a/q.go b/q.go\n--- a/q.go\n+++ b/q.go\n@@ -1,2 +10,4 @@\n ctx\n+q := fmt.Sprintf("SELECT * FROM t WHERE id=%s", x)\n+// TODO later\n+cmd := exec.Command(x)\n'


def test_review(spark):
    d = spark.createDataFrame([(1, DIFF), (2, DIFF.replace("q.go", "go.sum")), (3, ""), (4, None)], "diff_id long, raw string")
    review = Review(provider=echo_provider)
    rows = review.run(d).orderBy("diff_id", "rank").collect()
    assert {r["diff_id"] for r in rows} == {1} and rows[0]["severity"] == 4
    assert {r["cwe"] for r in rows} >= {"CWE-89", "CWE-78"} and any(r["message"].startswith("open task") for r in rows)
    assert review.stats(review.run(d)).first()["failed"] is True

    def broken(system, prompt):
        raise OSError("down")

    assert Review(provider=broken, static=True).run(d).count() == Review(provider=None).run(d).count()


def test_eval(spark):
    cases = spark.createDataFrame(
        [(1, DIFF, [("static:security", "high", "sql", "")], [("never", "")]), (2, DIFF, [("", "", "no such", "")], []), (3, DIFF, [], [("SQL", "")])],
        "case_id long, diff string, expect_findings array<struct<concern:string,min_severity:string,message_contains:string,file:string>>, deny_findings array<struct<message_contains:string,concern:string>>",
    )
    assert {r["case_id"]: r["passed"] for r in Review().evaluate(cases).collect()} == {1: True, 2: False, 3: False}


def test_ask(spark):
    df = spark.createDataFrame([(1, "c", "s", "p")], "diff_id long, concern string, system_prompt string, prompt string")
    assert ask(df, lambda s, p: s + p, parallel=2).first()["content"] == "sp"


def test_stream(spark, tmp_path):
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.diff").write_text(DIFF)
    review = Review()
    run = lambda: incremental.review(incremental.diffs(spark, source), review.run, out, point).awaitTermination()
    run()
    first = incremental.latest(spark, out).count()
    assert first > 0
    run()
    assert incremental.latest(spark, out).count() == first
    (tmp_path / "in" / "2.diff").write_text(DIFF.replace("q.go", "r.go"))
    run()
    assert incremental.latest(spark, out).count() == 2 * first

    def fails(batch):
        raise ValueError("no")

    (tmp_path / "in" / "3.diff").write_text(DIFF.replace("q.go", "s.go"))
    with pytest.raises(Exception):
        incremental.review(incremental.diffs(spark, source), fails, out, point).awaitTermination()
    run()  # the failed batch is seen again
    assert incremental.latest(spark, out).count() == 3 * first


def test_files(spark, tmp_path):
    (tmp_path / "revspark.toml").write_text('concerns = ["security"]\nfail_on = "high"\nextra = 1\n')
    (tmp_path / "a" / "b").mkdir(parents=True)
    c = files.load_config(str(tmp_path / "a" / "b"))
    assert c.concerns == ["security"] and c.fail_on == "high" and c.options == {"extra": 1}
    (tmp_path / "checks").mkdir()
    (tmp_path / "checks" / "one.md").write_text("---\nseverity: High\nlanguages: [go, python]\n---\nLook here\n")
    (tmp_path / "checks" / "two.md").write_text("---\nenabled: false\n---\nNot here\n")
    (tmp_path / "checks" / "three.md").write_text("Plain")
    rows = sorted((r["severity"], r["languages"], r["body"]) for r in files.checks(spark, str(tmp_path / "checks")).collect())
    assert rows == [("high", ["go", "python"], "Look here"), ("medium", [], "Plain")]
    assert files.project_rules(spark, [str(tmp_path / "checks" / "three.md")]) == "Plain"
    (tmp_path / "suite.json").write_text(json.dumps({"name": "s", "cases": [{"name": "n", "diff": "d", "expect_findings": [{"concern": "c"}], "deny_findings": []}]}))
    assert files.eval_suite(spark, str(tmp_path / "suite.json")).first()["name"] == "n"


@pytest.mark.parametrize("path, want", [("a//b/./c", "a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("/../a", "/a"), ("", "."), ("a/b/../..", "."), ("/", "/")])
def test_clean_path(spark, path, want):
    assert spark.range(1).select(files.clean_path(F.lit(path))).first()[0] == want


def test_guards(tmp_path):
    assert files.safe_url("https://example.org/x?q") and not files.safe_url("http://127.0.0.1/") and not files.safe_url("file:///x") and not files.safe_url("http://10.0.0.1")
    for bad in ("-x", "a..b", "a b", ""):
        with pytest.raises(ValueError):
            git.check_ref(bad)
    assert git.check_ref("HEAD~1") == "HEAD~1"


@pytest.fixture
def repository(tmp_path):
    """Two authors, three commits of f and one of g."""
    import subprocess

    def run(*a, who="x"):
        subprocess.run(["git", "-C", str(tmp_path), "-c", f"user.name={who}", "-c", f"user.email={who}@example.org", *a], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "f").write_text("1\nsame\n")
    run("add", "f")
    run("commit", "-qm", "one")
    for k, who in ((2, "y"), (3, "x")):
        (tmp_path / "f").write_text(f"{k}\nsame\n")
        (tmp_path / "g").write_text("é\n")
        run("add", "-A")
        run("commit", "-qam", f"change {k}", who=who)
    return str(tmp_path)


def test_git(repository):
    assert "+3" in git.diff_range(repository, "HEAD~1", "HEAD") and git.changed_files(repository, "HEAD~2", "HEAD") == ["f", "g"] and len(git.recent_commits(repository, "f")) == 3
    assert git.blame_authors(repository, "f", 1, 2) == [("x", 2)]
    for bad in ("../x", "", "a/../../x"):
        with pytest.raises(ValueError):
            git.check_path(repository, bad)


def requests(repo):
    blank = dict.fromkeys(["repo", "what", "base", "head", "path", "first", "last"])
    asked = [{"what": "diff", "base": "HEAD~1", "head": "HEAD"}, {"what": "files", "base": "HEAD~2", "head": "HEAD"}, {"what": "files", "base": "HEAD", "head": "HEAD"}, {"what": "commits", "path": "f"}, {"what": "commits", "path": "../f"},
        {"what": "blame", "path": "f", "first": 1, "last": 2}, {"what": "blame", "path": "f", "first": 50, "last": 99}, {"what": "diff", "base": "-x", "head": "HEAD"}, {"what": "diff", "base": "nowhere", "head": "HEAD"}, {"what": "diff"}, {"what": "?"}, {"what": "files", "base": "HEAD~1", "head": "HEAD", "repo": f"{repo}/none"}]
    return [blank | {"repo": repo} | r for r in asked]


def answers(rows):
    return sorted((r["what"], r["base"] or "", r["path"] or "", r["last"] or 0, r["place"], r["n"] or 0, (r["text"] or "")[-8:], r["error"] is not None) for r in rows)


def test_git_relation(spark, repository):
    """All kinds of requests, good and bad, in one table: failures are rows, repeats are answered once."""
    asked = requests(repository)
    df = spark.createDataFrame([tuple(r.values()) for r in asked + asked[:2]], git.REQUEST)
    rows = git.relation(df).collect()
    errors = [(r["what"], r["base"] or r["path"]) for r in rows if r["error"]]
    assert sorted(errors, key=str) == sorted([("?", None), ("blame", "f"), ("commits", "../f"), ("diff", None), ("diff", "-x"), ("diff", "nowhere"), ("files", "HEAD~1")], key=str)
    good = {(r["what"], r["place"]): r for r in rows if not r["error"]}
    assert set(good) == {("diff", 1), ("files", 1), ("files", 2), ("commits", 1), ("commits", 2), ("commits", 3), ("blame", 1)}
    assert good["diff", 1]["text"].startswith("diff --git") and good["commits", 1]["text"].endswith("change 3") and (good["blame", 1]["text"], good["blame", 1]["n"]) == ("x", 2)
    assert git.relation(df.select("repo", "what").where("false")).count() == 0
    text = git.context_text(git.relation(df).withColumn("key", F.lit(1)).where("what = 'commits'"), "key").first()["text"]
    assert text.startswith("\n## Git Context\n\n### f \u2014 Recent changes:\n  - ") and text.count("  - ") == 3 and text.endswith("one\n\n")


def test_git_source(spark, repository):
    """The data source gives the same rows, one partition a request; equalities on the request's fields leave the other requests alone."""
    asked = requests(repository)
    git.register(spark)
    df = spark.read.format("git").option("requests", json.dumps(asked)).load()
    assert answers(df.collect()) == answers(git.relation(spark.createDataFrame([tuple(r.values()) for r in asked], git.REQUEST)).collect())
    assert df.rdd.getNumPartitions() == len(asked)
    some = df.where(F.col("what").isin("commits", "blame") & (F.col("path") == "f") & (F.col("place") < 3))
    assert some.rdd.getNumPartitions() == 3 and sorted((r["what"], r["place"]) for r in some.collect()) == [("blame", 0), ("blame", 1), ("commits", 1), ("commits", 2)]
    assert spark.read.format("git").load().count() == 0


def test_cursors(spark, repository, tmp_path):
    """A cursor moves to the head of a review that was written and good, also of an empty range; it stays when a review fails, and a batch that fails is seen again."""
    heads = [git._git(repository, "rev-parse", r).strip() for r in ("HEAD~2", "HEAD~1", "HEAD")]
    inbox, out, point = (str(tmp_path / n) for n in ("inbox", "out", "point"))
    asked = []

    def judge(ok):
        return lambda changed: changed.select("key", "seq", F.lit(ok).alias("ok"), F.concat(F.lit("seen "), F.regexp_count("raw", F.lit("diff --git")).cast("string")).alias("report"))

    def run(reviewer, *requests):
        asked.extend(requests)
        spark.createDataFrame([(repository if k == "r" else k, len(asked), heads[0], h) for k, h in requests], cursors.REQUEST).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(cursors.REQUEST).parquet(inbox)
        cursors.follow(stream, cursors.ranges(reviewer), out, point).awaitTermination()
        rows = spark.read.parquet(f"{out}/reviews").where(F.col("seq") == len(asked)).orderBy("key").collect()
        return [(r["ok"], r["report"]) for r in rows]

    assert run(judge(True), ("r", heads[1])) == [(True, "seen 2")]
    assert run(judge(False), ("r", heads[2])) == [(False, "seen 1")]  # from heads[1]: only f changed
    assert [tuple(x)[1:] for x in cursors.known(spark, point).collect()] == [(1, heads[1])]
    with pytest.raises(Exception):
        run(lambda changed: changed.select(F.raise_error(F.lit("broken")).alias("key"), "seq", F.lit(True).alias("ok"), F.lit("").alias("report")), ("r", heads[2]))
    assert run(judge(True), ("/none", heads[2]))[0][0] is False  # the failed batch is seen again first, and is good now
    assert run(judge(True), ("r", heads[2])) == [(True, cursors.UNCHANGED)]
    assert run(judge(True), ("r", heads[2])) == [(True, cursors.UNCHANGED)]
    assert [tuple(x)[1:] for x in cursors.known(spark, point).collect()] == [(5, heads[2])]


def test_context_text(spark):
    """Numbered lines of the old file stand before each hunk of a known file; overlaps are shown once if asked for."""
    raw = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -3,2 +3,2 @@\n l3\n-l4\n+x\n@@ -8 +8 @@ f()\n-l8\n+y\n--- a/g\n+++ b/g\n@@ -2 +2 @@\n-z\n--- a/../h\n+++ b/../h\n@@ -2 +2 @@\n-z"
    diffs = spark.createDataFrame([(1, raw, "k"), (2, None, "k"), (3, "@@ -5 +5 @@\n+a", "k"), (4, "", "k")], "diff_id long, raw string, path string")
    contents = spark.createDataFrame([(1, "f", "".join(f"l{k}\n" for k in range(1, 10))), (1, "../h", "no\nno\n"), (1, "other", "x"), (2, "f", None)], "diff_id long, path string, content string")

    def block(first, last):
        return f"\n--- Context before (lines {first}-{last}) ---\n" + "".join(f"  {k} | l{k}\n" for k in range(first, last + 1))

    for merge, from_ in ((False, 1), (True, 5)):
        got = {r["diff_id"]: r["enriched"] for r in assist.with_context(diffs, contents, 10, merge).collect()}
        want = raw.replace("@@ -3,2", block(1, 2) + "@@ -3,2").replace("@@ -8", block(from_, 7) + "@@ -8")
        assert got == {1: want, 2: None, 3: "@@ -5 +5 @@\n+a", 4: ""}
    assert assist.with_context(diffs, contents.where("false")).where("diff_id = 1").first()["enriched"] == raw


def test_context_moves_files_not_lines(spark, monkeypatch):
    """A file is shuffled once as it is, with what is asked of it; blocks stand right when some files are unknown, short or given twice."""
    plans = []

    def kept(d, *a, **k):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return stored(d, *a, **k)

    monkeypatch.setattr(assist, "stored", kept)
    raw = "--- a/f\n+++ b/f\n@@ -3 +3 @@\n-x\n@@ -99999999999 +9 @@\n-x\n--- a/u\n+++ b/u\n@@ -2 +2 @@\n-x\n--- a/g\n+++ b/g\n@@ -1 +1 @@\n-x\n@@ -5000 +2 @@\n-x"
    contents = [(1, "f", "a\nb\nc"), (1, "g", "\n".join(map(str, range(1, 6001)))), (1, "g", "y\n" * 4998)]
    got = assist.with_context(spark.createDataFrame([(1, raw)], "diff_id long, raw string"), spark.createDataFrame(contents, "diff_id long, path string, content string"), 2).first()["enriched"]
    head = "\n--- Context before (lines {}) ---\n"
    want = raw.replace("@@ -3 ", head.format("1-2") + "  1 | a\n  2 | b\n@@ -3 ").replace("@@ -5000", head.format("4998-4999") + "  4998 | 4998\n  4998 | y\n  4999 | 4999\n@@ -5000")
    assert got == want
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1 and "Join" not in plans[0] and "posexplode" not in plans[0]


class Unsure:
    """Fails at random but repeatably, by a file that counts its calls for each prompt; prompts with `never` are refused."""

    def __init__(self, folder, share):
        self.folder, self.share = str(folder), share

    def __call__(self, system, prompt):
        import hashlib

        name = f"{self.folder}/{hashlib.md5(f'{system}|{prompt}'.encode()).hexdigest()}"
        with open(name, "a") as f:
            f.write("x")
        if "never" in prompt:
            raise ValueError("refused")
        with open(name) as f:
            n = len(f.read())
        if random.Random(f"{prompt}{n}").random() < self.share:
            raise TimeoutError("busy")
        with open(f"{name}.done", "a") as f:
            f.write("x")
        return f"{system}:{prompt}"


def test_answers_are_kept(spark, tmp_path):
    """A provider that fails at random ends with the same table as one that doesn't; each request is answered once, a refusal is final, and nothing known is asked again."""
    import os

    calls, folder = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    rows = [("s", f"p{k % 30}") for k in range(60)] + [("s", "never"), (None, "p1"), ("s", None)]
    asked = spark.createDataFrame(rows, "system_prompt string, prompt string").withColumn("place", F.monotonically_increasing_id())
    unsure = Unsure(calls, 0.7)
    for _ in range(12):
        got = answers_table.answered(asked, unsure, folder, tries=2, pause=0.0, wave=8).collect()
        if all(r["content"] is not None or r["prompt"] == "never" for r in got):
            break
    assert len(got) == len(rows) and len({r["place"] for r in got}) == len(rows)
    for r in got:
        want = None if r["prompt"] == "never" else f"{r['system_prompt'] or ''}:{r['prompt'] or ''}"
        assert r["content"] == want and (r["error"] == "ValueError: refused") == (want is None)
    done = [f for f in os.listdir(calls) if f.endswith(".done")]
    assert len(done) == 32 and all((calls / f).read_text() == "x" for f in done)
    before = {f: (calls / f).read_text() for f in os.listdir(calls)}
    assert before[next(f for f in before if f + ".done" not in before and not f.endswith(".done"))] == "x"
    answers_table.answered(asked, unsure, folder).collect()
    assert {f: (calls / f).read_text() for f in os.listdir(calls)} == before
    assert answers_table.answered(asked.where("false"), unsure, folder).count() == 0 and answers_table.known(spark, str(tmp_path / "none")).count() == 0


class Second:
    """Reports open tasks, and drops the first finding when asked again."""

    def __call__(self, system, prompt):
        return json.dumps([{"index": 0, "action": "drop", "score": 9}, {"index": 1, "action": "adjust", "severity": "critical", "score": 8, "message": "worse"}]) if "Check these findings" in prompt else echo_provider(system, prompt)


def test_second_opinion(spark, tmp_path):
    """With a second opinion the review asks about its findings and follows; without provider or answer it stays as it was."""
    diffs = spark.createDataFrame([(1, DIFF), (2, "")], "diff_id long, raw string")
    plain = Review(provider=Second()).run(diffs).orderBy("seq").collect()
    kept = Review(provider=Second(), second_opinion=True, answers=str(tmp_path / "a")).run(diffs).orderBy("seq").collect()
    assert [r["seq"] for r in kept] == [r["seq"] for r in plain][1:] and (kept[0]["message"], kept[0]["severity"]) == ("worse", 4)
    assert len(Review(provider=Second(), second_opinion=True, min_score=9).run(diffs).collect()) == len(plain) - 2
    assert len(Review(provider=echo_provider, second_opinion=True).run(diffs).collect()) == len(plain)


class Helper:
    """Answers each kind of request with what it was asked."""

    def __call__(self, system, prompt):
        if "describe changes" in system:
            return json.dumps({"title": f"{len(prompt)} characters", "summary": "s", "change_type": "bugfix", "risk": "low"}) if "n.py" in prompt else "nothing"
        if "working code" in system:
            return json.dumps([{"file": prompt.split("--- ")[1].split("\n")[0], "description": "d", "after": str(prompt.count("\n+"))}, {"file": "", "description": "d", "after": "x"}])
        return f"FIXED:\n{prompt.split('Issue: ')[1].splitlines()[0]}!\nEXPLANATION: it was {prompt.splitlines()[1]}" if "fix" not in prompt else "sorry"


MANY = DIFF + "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+a = 1\n+b = 2\ndiff --git a/old b/new\nrename from old\nrename to new\ndiff --git a/d b/d\ndeleted file mode 100644\n--- a/d\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"


def test_describe(spark, tmp_path):
    """A change is described from all its files and as much of its diff as fits; without answer from the diff itself."""
    diffs = spark.createDataFrame([(1, MANY), (2, ""), (3, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +0,0 @@\n-a\n")], "diff_id long, raw string")
    prompts = {r["diff_id"]: r["prompt"] for r in assistants.describe_prompt(diffs, 4096).collect()}
    assert set(prompts) == {1, 3} and assistants.CUT not in prompts[1]
    assert "- q.go\n- n.py (new)\n- new (renamed from old)\n- d (deleted)\n" in prompts[1] and "4 files changed, 5 insertions(+), 1 deletions(-)" in prompts[1]
    assert "--- n.py\n+a = 1\n+b = 2\n" in prompts[1] and "gone" not in prompts[1]
    short = {r["diff_id"]: r["prompt"] for r in assistants.describe_prompt(diffs, 95).collect()}[1]
    assert assistants.CUT in short and "- d (deleted)" in short and "--- n.py" not in short
    got = {r["diff_id"]: (r["title"], r["change_type"]) for r in assistants.Assistant(Helper(), str(tmp_path / "a")).describe(diffs).collect()}
    assert got == {1: (f"{len(prompts[1])} characters", "bugfix"), 2: ("No changes", ""), 3: ("Update x", "chore")}


def test_improve_and_fix(spark):
    diffs = spark.createDataFrame([(1, MANY), (2, "")], "diff_id long, raw string")
    helper = assistants.Assistant(Helper())
    assert [(r["diff_id"], r["pos"], r["file"], r["after"]) for r in helper.improve(diffs).collect()] == [(1, 0, "q.go", "8")]
    only = assistants.improve_prompt(diffs, 1).first()["prompt"]
    assert "--- q.go\n+++ q.go\n@@ -1,2 +10,4 @@\n ctx\n" in only and "n.py" not in only
    found = spark.createDataFrame([(1, 0, 4, "q.go", 2, "bad"), (1, 1, 0, "q.go", 2, "info"), (1, 2, 3, "q.go", 2, "fix me"), (2, 0, 3, "z", 1, "none")], "diff_id long, seq long, severity int, file string, line int, message string")
    got = {(r["diff_id"], r["seq"]): (r["fixed_code"], r["explanation"]) for r in helper.fix(found, diffs).collect()}
    assert got == {(1, 0): ("bad!", "it was Severity: critical"), (2, 0): ("none!", "it was Severity: high")}
