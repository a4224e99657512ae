import random

import pytest
from pyspark.sql import functions as F

from revspark.functions import text as T
from revspark.operators import findings as O
from revspark.operators import similar
from revspark.plans.store import stored
from revspark.schemas import FINDING

BASE = {"diff_id": 1, "seq": 0, "concern": "security", "severity": 2, "file": "a.go", "line": 1, "end_line": 0, "message": "m", "fix": "", "reasoning": "", "cwe": "", "confidence": 0.5, "sast_source": False}


def frame(spark, *rows):
    return spark.createDataFrame([tuple((BASE | {"seq": k} | r)[c.split()[0]] for c in FINDING.split(", ")) for k, r in enumerate(rows)], FINDING)


def test_exact_dedup(spark):
    f = frame(spark, {"message": "x"}, {"message": "x", "concern": "style"}, {"message": "x", "line": 2}, {"message": "x", "diff_id": 2})
    assert [(r["diff_id"], r["seq"]) for r in O.exact_dedup(f).orderBy("seq").collect()] == [(1, 0), (1, 2), (2, 3)]


def plain_near(rows, distance=5, threshold=0.8, same=False):
    def words(r):
        return {w for w in (x.strip(".,;:!?\"'()[]{}") for x in f"{r['concern']} {r['message']}".lower().split()) if w}

    group, sizes = {}, {}
    for i in range(len(rows)):
        if i in group:
            continue
        for j in range(i + 1, len(rows)):
            if j in group:
                continue
            a, b = words(rows[i]), words(rows[j])
            alike = (not a and not b) or (bool(a) and bool(b) and len(a & b) / len(a | b) >= threshold)
            near = rows[i]["file"] == rows[j]["file"] and abs(rows[i]["line"] - rows[j]["line"]) <= distance or (rows[i]["file"] != rows[j]["file"] and not same)
            if alike and near:
                group[j] = i
                sizes[i] = True
        if i in sizes:
            group[i] = i
    return group


@pytest.mark.parametrize("same", [False, True])
def test_near_dedup(spark, same):
    r = random.Random(3)
    rows = [{"diff_id": r.randint(1, 6), "concern": r.choice(["", "sec"]), "message": " ".join(r.choices(["a", "b", "c", "(a)"], k=r.randint(0, 4))), "file": r.choice(["x", "y"]), "line": r.randint(1, 15), "confidence": r.choice([0.1, 0.5, 0.9])} for _ in range(150)]
    got = {x["seq"]: (x["group_id"], x["is_rep"], x["is_unique"]) for x in similar.near_dedup(frame(spark, *rows), same_file_only=same).collect()}
    for d in range(1, 7):
        mine = [(k, x) for k, x in enumerate(rows) if x["diff_id"] == d]
        group = plain_near([x for _, x in mine], same=same)
        for p, (k, _) in enumerate(mine):
            want = mine[group[p]][0] if p in group else None
            assert got[k][0] == want
        for g in set(group.values()):
            members = [q for q in group if group[q] == g]
            best = max(members, key=lambda q: (mine[q][1]["confidence"], -q))
            assert [mine[q][0] for q in members if got[mine[q][0]][1]] == [mine[best][0]]


def groups_of(spark, rows, **how):
    return {x["seq"]: x["group_id"] for x in similar.near_dedup(frame(spark, *rows), **how).collect()}


@pytest.mark.parametrize("seed", [1])
def test_near_dedup_of_edited_messages(spark, seed):
    """Messages of 8 to 12 words with a word changed, dropped or added: similar ones are no classes, and order, files and lines mix."""
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 40)}" for _ in range(r.randint(8, 12))] for _ in range(4)]
    rows = []
    for _ in range(200):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(["", "x", "y", f"w{r.randint(0, 40)}"])
        rows.append({"concern": "c", "message": " ".join(words), "file": r.choice("abc"), "line": r.randint(1, 60), "confidence": r.random()})
    for how, plain in (({}, {}), ({"same_file_only": True}, {"same": True}), ({"distance": 0}, {"distance": 0})):
        assert {k: g for k, g in groups_of(spark, rows, **how).items() if g is not None} == plain_near(rows, **plain)


def test_near_dedup_long_chain(spark):
    """One message on every line of a file: each leader takes the five lines after it, in two rounds however long the file."""
    n = 3000
    got = groups_of(spark, [{"line": k} for k in range(n)])
    assert all(got[k] == k - k % 6 for k in range(n))


def test_near_dedup_edges(spark):
    assert similar.near_dedup(frame(spark)).count() == 0
    rows = [{"concern": "", "message": ""}, {"concern": "", "message": "."}, {"concern": "", "message": "x"}, {"file": None}, {"file": None}, {"diff_id": 2}]
    got = groups_of(spark, rows)
    assert [got[k] for k in range(6)] == [0, 0, None, 3, 3, None]
    assert [tuple(x)[1:3] for x in similar.similar_pairs(frame(spark, *rows)).orderBy("a").collect()] == [(0, 1), (3, 4)]


def test_similar_sets_finds_all_pairs(spark):
    r = random.Random(5)
    sets = [sorted(set(r.choices("abcdefghijklmnop", k=r.randint(1, 12)))) for _ in range(150)]
    df = spark.createDataFrame([(k % 2, k, s) for k, s in enumerate(sets)], "g int, k int, words array<string>")
    for t in (0.5, 0.8, 1.0):
        got = {(x["a"], x["b"]) for x in similar.similar_sets(df, "g", "k", t).collect()}
        assert got == {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and a % 2 == b % 2 and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}


def test_similar_sets_of_small_and_large_keys(spark):
    """Keys of few names are compared within their row, without the join on rare words; keys of many names beside them aren't lost."""
    r = random.Random(6)
    sizes = {0: 1, 1: 2, 2: similar.FEW, 3: similar.FEW + 1, 4: 3}
    rows = [(g, 100 * g + k, sorted(set(r.choices("abcdefgh", k=r.randint(0, 6))))) for g, n in sizes.items() for k in range(n)]
    of = {k: (g, set(w)) for g, k, w in rows}

    def check(rows):
        df = spark.createDataFrame(rows, "g int, k int, words array<string>")
        out = similar.similar_sets(df, "g", "k", 0.6)
        got = [(x["a"], x["b"]) for x in out.collect()]
        want = {(a, b) for _, a, _ in rows for _, b, _ in rows if a != b and of[a][0] == of[b][0] and of[a][1] and of[b][1] and len(of[a][1] & of[b][1]) / len(of[a][1] | of[b][1]) >= 0.6}
        assert len(got) == len(set(got)) and set(got) == want
        return out._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert check(rows) > 1
    assert check([x for x in rows if x[0] != 3]) == 1


def test_bands_and_rounding(spark):
    f = frame(spark, {"confidence": 0.7}, {"confidence": 0.5}, {"confidence": 0.49})
    assert [r[0] for r in f.orderBy("seq").select(O.band(F.col("confidence"))).collect()] == ["high", "medium", "low"]
    assert spark.range(1).select(O.round2(F.lit(0.285))).first()[0] == 0.28
    s = O.confidence_stats(f).first()
    assert (s["avg_confidence"], s["high"], s["low"]) == (0.56, 1, 1)


def test_failed(spark):
    got = O.failed(frame(spark, {"severity": 1}, {"severity": 4, "diff_id": 2}), 3).orderBy("diff_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, False), (2, 4, True)]


def test_comment_map(spark):
    hunks = spark.createDataFrame([(1, "a.go", 10, 3)], "diff_id long, path string, new_start int, new_count int")
    lines = spark.createDataFrame([(1, "a.go", 4, 2)], "diff_id long, path string, old_num int, new_num int")
    f = frame(spark, {"line": 10}, {"line": 13}, {"line": 4}, {"line": 10, "file": "b.go"})

    def kept(mode):
        return sorted(r["seq"] for r in O.comment_map(f, hunks, lines, mode).collect())

    assert kept("added") == [0] and kept("context") == [0, 2] and kept("file") == [0, 1, 2] and kept("none") == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        O.comment_map(f, hunks, None, "context")


def test_comments(spark):
    f = frame(spark, {"severity": 4, "reasoning": "r", "fix": "add it"}, {"severity": 9, "fix": "x := 1"})
    a, b = O.comments(f).orderBy("seq").collect()
    assert a["body"] == "**[CRITICAL]** m\n\n> r\n\n**Fix:** add it\n" and a["suggestion"] == ""
    assert b["body"] == "**[INFO]** m\n" and b["suggestion"] == "x := 1"


def test_gate(spark):
    f = frame(spark, {"severity": 1}, {"severity": 3}, {"severity": 3}, {"severity": 3})
    v = spark.createDataFrame([(1, 1, True, 0.6), (1, 2, True, 0.59)], "diff_id long, seq long, confirmed boolean, confidence double")
    assert [(r["seq"], r["place"]) for r in O.gate(f, v).orderBy("place").collect()] == [(0, 1), (1, 2)]


def test_reflect(spark):
    f = frame(spark, {}, {}, {}, {})
    v = spark.createDataFrame([(1, 0, 0, "drop", "", 0, ""), (1, 1, 0, "drop", "", 0, ""), (1, 1, 1, "adjust", "HIGH", 9, "new"), (1, 2, 0, "keep", "", 2, "")], "diff_id long, index int, pos int, action string, severity string, score int, message string")
    assert [(r["seq"], r["severity"], r["message"]) for r in O.reflect(f, v, 3).orderBy("seq").collect()] == [(1, 3, "new"), (3, 2, "m")]
    assert O.reflect(f, v.where("false")).count() == 4


def test_fusion(spark):
    sast = frame(spark, {"message": "sql injection risk in query"}, {"message": "weak hash", "line": 2})
    llm = frame(spark, {"message": "query allows SQL injection"}, {"message": "naming is unclear", "line": 2})
    c, d, u = O.fusion(sast, llm)
    assert [r["seq"] for r in c.collect()] == [0] and [r["seq"] for r in d.collect()] == [1] and [r["seq"] for r in u.collect()] == [1]


def test_fixes(spark):
    f = frame(spark, {"message": "hardcoded password in sql injection"}, {"cwe": "CWE-918", "line": 2}, {"message": "fine", "line": 3}, {"message": "unsanitized xss", "line": 4})
    got = {r["finding_id"]: (r["category"], r["priority"], r["confidence"]) for r in O.fixes(f).collect()}
    assert got == {"a.go:1:security": ("auth", 2, 0.9), "a.go:2:security": ("ssrf", 2, 0.8), "a.go:4:security": ("xss", 1, 0.85)}


def test_reports(spark):
    import json

    f = frame(spark, {"severity": 4, "concern": "", "line": 3, "end_line": 5, "fix": "f", "reasoning": "r"}, {"file": "", "severity": 0})
    log = json.loads(O.sarif(f).first()["report"])
    a, b = log["runs"][0]["results"]
    assert a["ruleId"] == "unknown" and a["level"] == "error" and a["message"]["text"] == "m\n\nFix: f\n\nReasoning: r"
    assert a["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "endLine": 5} and "locations" not in b and b["level"] == "none"
    assert [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["unknown", "security"]


def test_quality_graph(spark):
    import hashlib

    f = frame(spark, {"message": "private text", "file": "secret.go"}, {"message": "other"})
    nodes, edges = O.quality_graph(f, "src", limit=1)
    rows = nodes.collect()
    assert len(rows) == 2 and edges.count() == 1 and "private" not in str(rows) and "secret" not in str(rows)
    want = hashlib.sha256(b"12:private text").hexdigest()
    assert [r["message_digest"] for r in rows if r["kind"] == "finding"] == [want]
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in O.quality_graph(f, "src", limit=1)[0].collect())


def test_expectations(spark):
    f = frame(spark, {"message": "SQL Injection here", "severity": 3})
    e = spark.createDataFrame([(1, 0, "SECURITY", "high", "sql inj", "A.GO"), (1, 1, "style", "", "", ""), (1, 2, "", "critical", "", ""), (1, 3, "", "", "", "")], "case_id long, exp_id int, concern string, min_severity string, message_contains string, file string")
    assert [r["met"] for r in O.expectations_met(e, f).orderBy("exp_id").collect()] == [True, False, False, True]
    assert tuple(O.eval_summary(spark.createDataFrame([], "case_id long, passed boolean")).first()) == (0, 0, 0.0)


@pytest.mark.parametrize("text, want", [("", 0), (None, 0), ("   ", 1), ("hello brave new world", 5), ("x", 1), ("getUserName()", 6), ("a_b c_d", 4), ("!!!", 6), ("Hello there", 3)])
def test_estimate_tokens(spark, text, want):
    assert spark.range(1).select(T.estimate_tokens(F.lit(text).cast("string"))).first()[0] == want


@pytest.mark.parametrize("message, fix, want", [("An SQL injection!", "", "CWE-89"), ("mysql injections", "", ""), ("uses md5", "", "CWE-327"), ("x", "race condition", "CWE-362"), ("sha1 x", "", ""), ("sha1 ", "x", "CWE-327"), ("xss and sql injection", "", "CWE-89"), (None, None, "")])
def test_match_cwe(spark, message, fix, want):
    assert spark.range(1).select(T.match_cwe(F.lit(message).cast("string"), F.lit(fix).cast("string"))).first()[0] == want


def test_jaccard_of_nothing(spark):
    row = spark.range(1).select(T.jaccard(T.word_set(F.lit(" . ")), T.word_set(F.lit(""))), T.jaccard(T.word_set(F.lit("a")), T.word_set(F.lit("")))).first()
    assert tuple(row) == (1.0, 0.0)


def test_recall(spark):
    """The best entries by shared words, as counted for every pair; the words that most entries have are hardly joined."""
    r = random.Random(3)
    common, rare = [f"the{k}" for k in range(8)], [f"w{k}" for k in range(300)]
    families = [r.choices(rare, k=14) for _ in range(50)]
    texts = [" ".join(r.sample(common, 7) + r.sample(families[k % 50], 12)) for k in range(300)]
    asked = [" ".join(common + families[k] + ["new"]) for k in range(40)] + ["", None, "only new words", " ".join(common), "the1 the1 w3"]
    memory = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "entry long, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "question long, text string")
    joined = []

    def keep(df, what):
        df = stored(df, what)
        if what == "recall-scores":
            joined.append(df.agg(F.sum("score")).first()[0] or 0)
        return df

    got = {(x["question"], x["place"]): (x["entry"], x["score"]) for x in O.recall(questions, memory, "question", "entry", 5, keep).collect()}
    want, pairs = {}, 0
    for q, t in enumerate(asked):
        scores = [(-len(set((t or "").split()) & set(e.split())), k) for k, e in enumerate(texts)]
        pairs -= sum(s for s, _ in scores)
        want |= {(q, p): (k, -s) for p, (s, k) in enumerate(sorted(x for x in scores if x[0])[:5], 1)}
    assert got == want and sum(joined) < pairs / 3
    assert O.recall(questions.where("false"), memory, "question", "entry", 5).count() == 0 and O.recall(questions, memory.where("false"), "question", "entry", 5).count() == 0
