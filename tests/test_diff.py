"""Diff parsing against cases and, on random diffs, against a plain state machine."""

import random

import pytest
from pyspark.sql import functions as F

from revspark.operators import diff

BASIC = """diff --git a/pkg/a.go b/pkg/a.go
index 1..2 100644
--- a/pkg/a.go
+++ b/pkg/a.go
@@ -10,3 +10,4 @@ func A()
 one
-two
+three
+four
@@ -25 +27,0 @@
\\ No newline at end of file
 five
diff --git a/new.py b/new.py
--- /dev/null
+++ b/new.py
@@ -0,0 +1,1 @@
+print(1)
diff --git a/old.rb b/old.rb
--- a/old.rb
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p.txt b/q.txt
rename from p.txt
rename to q.txt
diff --git a/i.png b/i.png
Binary files a/i.png and b/i.png differ
diff --git a/j.bin b/j.bin
--- a/j.bin
+++ b/j.bin
Binary files differ"""


def frame(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "diff_id long, raw string")


def test_files(spark):
    rows = diff.files(frame(spark, BASIC)).orderBy("file_idx").collect()
    got = [(r["path"], r["old_path"], r["added"], r["deleted"], r["renamed"], r["binary"]) for r in rows]
    assert got == [
        ("pkg/a.go", "pkg/a.go", False, False, False, False),
        ("new.py", "", True, False, False, False),
        ("old.rb", "old.rb", False, True, False, False),
        ("q.txt", "p.txt", False, False, True, False),
        ("j.bin", "j.bin", False, False, False, True),
    ]


def test_hunks_and_lines(spark):
    hunks = diff.hunks(frame(spark, BASIC)).where("path = 'pkg/a.go'").orderBy("hunk_idx").collect()
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["header"]) for h in hunks] == [(10, 3, 10, 4, "func A()"), (25, 1, 27, 0, "")]
    lines = diff.lines(frame(spark, BASIC)).where("path = 'pkg/a.go'").orderBy("hunk_idx", "line_idx").collect()
    assert [(r["type"], r["content"], r["old_num"], r["new_num"], r["abs_new"]) for r in lines] == [
        (0, "one", 1, 1, 10), (2, "two", 2, 0, None), (1, "three", 0, 2, 11), (1, "four", 0, 3, 12), (0, "five", 1, 1, 27),
    ]


@pytest.mark.parametrize("header, want", [
    ("@@ -1,2 +3,4 @@ f", (1, 2, 3, 4, "f")), ("@@ +3,4 -1,2 @@", (1, 2, 3, 4, "")), ("@@+-1", (0, 0, 0, 1, "@@+-1")), ("@@ -x +y @@", (0, 1, 0, 1, "")),
    ("@@", (0, 0, 0, 0, "@@")), ("@@ -5 +6", (5, 1, 6, 1, "@@ -5 +6")), ("@@ -1,-2 +3 @@ a @@ b", (1, 0, 3, 1, "a @@ b")),
])
def test_hunk_header(spark, header, want):
    assert tuple(spark.range(1).select(diff.hunk_header(F.lit(header)).alias("h")).first()["h"]) == want


def test_summary_and_empty(spark):
    rows = diff.summary(frame(spark, BASIC, "", "no diff at all")).orderBy("diff_id").collect()
    assert [r["summary"] for r in rows] == ["5 files changed, 3 insertions(+), 2 deletions(-)", "0 files changed, 0 insertions(+), 0 deletions(-)", "0 files changed, 0 insertions(+), 0 deletions(-)"]
    none = frame(spark, "x").where("false")
    assert diff.lines(none).count() == 0 and diff.added_lines(none).count() == 0
    assert diff.added_lines(spark.createDataFrame([(1, None)], "diff_id long, raw string")).count() == 0


def test_body_lines_that_look_like_headers(spark):
    raw = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n--- a/y\n+++ b/z\n"
    rows = diff.files(frame(spark, raw)).collect()
    assert [(r["path"], r["old_path"]) for r in rows] == [("z", "y")]
    lines = diff.lines(frame(spark, raw)).orderBy("line_idx").collect()
    assert [(r["type"], r["content"]) for r in lines] == [(2, "-- a/y"), (1, "++ b/z"), (0, "")]


def random_diff(r):
    out = []
    for _ in range(r.randint(0, 12)):
        kind = r.choice(["git", "minus", "plus", "hunk", "hunk", "add", "add", "del", "ctx", "ctx", "none", "odd"])
        n = r.randint(0, 30)
        out.append({
            "git": f"diff --git a/f{n} b/f{n}", "minus": r.choice([f"--- a/f{n}", "--- /dev/null"]), "plus": r.choice([f"+++ b/f{n}", "+++ /dev/null", f"+++ f{n}", "+++x"]),
            "hunk": r.choice([f"@@ -{n},2 +{n + 1},3 @@ h", f"@@ -{n} +{n} @@", "@@ bad", "@@x"]), "add": f"+a{n}", "del": f"-d{n}", "ctx": f" c{n}", "none": diff.NO_NEWLINE, "odd": r.choice(["", "x", "\\", "rename from q", "rename to w"]),
        }[kind])
    return "\n".join(out)


def plain_new_side(raw):
    file, n, out = "", 0, []
    for row in raw.split("\n"):
        if row.startswith("+++ "):
            file, n = row[6:] if row.startswith("+++ b/") else row[4:], 0
        elif row.startswith("@@ "):
            digits = ""
            if "+" in row:
                for c in row[row.index("+") + 1 :]:
                    if not c.isdigit():
                        break
                    digits += c
            n = (int(digits or 0) or 1) - 1
        elif row.startswith("+") and not row.startswith("+++"):
            n += 1
            out.append((file, n, row[1:], True))
        elif not row.startswith("-"):
            n += 1
            out.append((file, n, row, False))
    return out


def plain_lines(raw):
    chunks, now = [], []
    for row in raw.split("\n"):
        if row.startswith("diff --git") and now:
            chunks.append(now)
            now = []
        now.append(row)
    chunks.append(now)
    out, idx = [], 0
    for chunk in chunks:
        path = old = ""
        hunks = []
        for k, row in enumerate(chunk):
            if row.startswith("--- a/"):
                old = row[6:]
            elif row.startswith("+++ b/"):
                path = row[6:]
            elif row.startswith("rename from "):
                old = row[12:]
            elif row.startswith("rename to "):
                path = row[10:]
            elif row.startswith("@@"):
                body = []
                for x in chunk[k + 1 :]:
                    if x.startswith("@@"):
                        break
                    if x != diff.NO_NEWLINE:
                        body.append(x)
                hunks.append(body)
        path = path or old
        if not path:
            continue
        for h, body in enumerate(hunks):
            a = b = 0
            for i, x in enumerate(body):
                kind = {"+": 1, "-": 2}.get(x[:1], 0)
                a, b = a + (kind != 1), b + (kind != 2)
                out.append((idx, path, h, i, kind, x[1:] if x[:1] in ("+", "-", " ") else x, 0 if kind == 1 else a, 0 if kind == 2 else b))
        idx += 1
    return out


def test_random_diffs(spark):
    r = random.Random(5)
    raws = [random_diff(r) for _ in range(400)]
    df = frame(spark, *raws)
    got = {}
    for x in diff.new_side(df).orderBy("diff_id", "seq").collect():
        got.setdefault(x["diff_id"], []).append((x["file"], x["line"], x["text"], x["added"]))
    assert got == {k: v for k, raw in enumerate(raws) if (v := plain_new_side(raw))}
    got = {}
    for x in diff.lines(df).orderBy("diff_id", "file_idx", "hunk_idx", "line_idx").collect():
        got.setdefault(x["diff_id"], []).append(tuple(x[c] for c in ("file_idx", "path", "hunk_idx", "line_idx", "type", "content", "old_num", "new_num")))
    assert got == {k: v for k, raw in enumerate(raws) if (v := plain_lines(raw))}


def test_long_hunk_numbers(spark):
    raw = "+++ b/a.go\n@@ -1 +1,9000 @@\n" + "\n".join(f"+x{k}" for k in range(9000))
    assert diff.added_lines(frame(spark, raw)).agg(F.max("line"), F.min("line"), F.countDistinct("line")).first() == (9000, 1, 9000)


def test_combine_and_ranges(spark):
    changes = spark.createDataFrame([(1, 2, "b"), (1, 1, "a\n"), (1, 3, None), (1, 4, "")], "diff_id long, seq int, diff string")
    assert diff.combine(changes).first()["raw"] == "a\nb\n"
    files = spark.createDataFrame([("a", "1\n2\n3"), ("../b", "1"), ("c", None)], "path string, content string")
    assert [(r["path"], r["line"], r["text"]) for r in diff.line_range(files, 0, 2).orderBy("path", "line").collect()] == [("a", 1, "1"), ("a", 2, "2"), ("c", 1, "")]
