"""Plans that read the diffs once, and steps that patterns run in once."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from revspark.operators import rules, symbols, taint
from revspark.plans import store
from revspark.plans.review import Review
from revspark.rules_catalog import RULES
from revspark.sources import synthetic as S

SF = "/root/testdata/sf0.001"


def plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain("simple")
    return said.getvalue()


@pytest.mark.parametrize("name", ["file_tokens", "build_prompt", "context_enrich", "static_scan"])
def test_diffs_are_made_once(spark, name):
    said = plan(entry.queries()[name](spark, SF))
    assert said.count("FileScan parquet") == 1 and "Window" not in said and "SortMergeJoin" not in said


def test_numbers_of_sides_have_no_sums(spark):
    """New-side lines are numbered by their places; that of a hunk after another goes on from it."""
    from revspark.operators import diff

    raw = "+++ b/a\n@@ -1 +5 @@\n-x\n+y\n z\n@@ -9 +20 @@\n-q\n+++ b/b\n@@ -0 +1 @@\n+w\n+++x"
    rows = diff.new_side(spark.createDataFrame([(1, raw)], "diff_id long, raw string")).orderBy("seq").collect()
    assert [(r["seq"], r["file"], r["line"], r["text"], r["added"]) for r in rows] == [(0, "a", 5, "y", True), (1, "a", 6, " z", False), (2, "b", 1, "w", True), (3, "b", 2, "+++x", False)]


def test_patterns_of_the_tracker_run_once(spark):
    rows = spark.createDataFrame([(1, k, "a.go", k, t, True) for k, t in enumerate(["func f(a string) {", "exec.Command(a)", "b := a", "c := b"])], "diff_id long, seq long, file string, line int, text string, added boolean")
    found = taint.track(rows)
    assert "taint-lines" in plan(found)
    assert [(r["line"], r["variable"]) for r in found.collect()] == [(1, "a")]


def test_review_stores_the_diffs(spark):
    before = set(store._made)
    Review(provider=None).run(S.diffs(spark, SF))
    assert any("review-diffs" in p for p in set(store._made) - before)


def test_context_reads_stored_pieces(spark):
    said = plan(entry.queries()["context_enrich_text"](spark, SF))
    assert "context-pieces" in said and "context-diffs" in said and "lineitem.parquet" not in said


def test_lines_are_trimmed_once():
    said = str(symbols.symbol_of(F.col("x"), ".go"))
    assert said.count("\\s+|") == 1


def test_needed_strings_hide_no_hit(spark):
    """Lines that match have what their rule needs, in any case and with letters that Java folds to ASCII ones."""
    texts = ['PassWord := "hunter22"', 'paſſword = "hunter22"', 'KEY TOKEN: "abcdefgh12"', "// tı TODO fix auth", "// tOdO fİx Auth", "DROP table t", "eval(x)", "el.innerHTML = x", "x"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in RULES:
        may = rules._may_match(F.col("text"), F.lower("text"), r.pattern)
        if may is not None:
            assert rows.where(F.rlike("text", F.lit(rules.java_pattern(r.pattern))) & ~may).isEmpty(), r.rule_id
    assert sum(rules._may_match(F.col("text"), F.lower("text"), r.pattern) is not None for r in RULES) > len(RULES) * 0.9
