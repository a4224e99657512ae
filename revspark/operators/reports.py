"""Reports of findings as text: for a terminal, for a pull request, as JSON. One row a diff; findings stand in the order of seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, severity_name

#: Colours of severities from info to critical, and other marks of a terminal.
COLOURS = ["\033[36m", "\033[34m", "\033[33m", "\033[31m", "\033[35m"]
BOLD, DIM, GREEN, RESET = "\033[1m", "\033[2m", "\033[32m", "\033[0m"
RULE = "=" * 51
#: The fields of a finding in JSON.
FIELDS = ["concern", "severity", "file", "line", "end_line", "message", "fix", "reasoning", "cwe", "confidence"]


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def place(ends: bool = True) -> Column:
    """file, file:line, or file:line-end_line of a finding."""
    line, end = F.coalesce("line", F.lit(0)), F.coalesce("end_line", F.lit(0))
    at = F.concat("file", F.lit(":"), line.cast("string"))
    if ends:
        at = F.when((end > 0) & (end != line), F.concat(at, F.lit("-"), end.cast("string"))).otherwise(at)
    return F.when(line > 0, at).otherwise(F.col("file"))


def _joined(rows: DataFrame, key: list[str], order: list, text: Column, name: str) -> DataFrame:
    """The texts of every key, one after the other, with their number as <name>_n."""
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))).alias("_rows"))
    return got.select(*key, F.array_join("_rows._text", "").alias(name), F.size("_rows").alias(f"{name}_n"))


def terminal(findings: DataFrame, reviewed: DataFrame, colours: bool = False) -> DataFrame:
    """(diff_id, report) of all reviewed diffs (diff_id, files, hunks): findings by severity from the worst, with counts and a summary.

    Findings of other diffs are left out. Null texts are left out of their finding.
    """

    def mark(code: str) -> Column:
        return F.lit(code if colours else "")

    colour = F.get(F.array(*map(mark, COLOURS)), F.col("severity"))
    entry = F.concat(
        F.lit("    "), colour, F.lit("* "), mark(RESET), "message", F.lit("\n      "), mark(DIM), place(), mark(RESET),
        F.when(_given(F.col("concern")), F.concat(F.lit("  ["), "concern", F.lit("]"))).otherwise(""), F.lit("\n"),
        F.when(_given(F.col("reasoning")), F.concat(F.lit("      > "), "reasoning", F.lit("\n"))).otherwise(""),
        F.when(_given(F.col("fix")), F.concat(F.lit("      "), mark(GREEN), F.lit("Fix: "), "fix", mark(RESET), F.lit("\n"))).otherwise(""), F.lit("\n"),
    )
    per = _joined(findings, ["diff_id", "severity"], ["seq"], entry, "entries")
    name = F.upper(severity_name(F.col("severity")))
    part = F.concat(F.lit("  "), mark(BOLD), colour, name, mark(RESET), F.lit(" ("), F.col("entries_n").cast("string"), F.lit(")\n\n"), "entries")
    count = F.concat(F.col("entries_n").cast("string"), F.lit(" "), name)
    parts = per.groupBy("diff_id").agg(F.sort_array(F.collect_list(F.struct("severity", part.alias("part"), count.alias("count"))), asc=False).alias("p"), F.sum("entries_n").alias("n"))
    head = F.concat(F.lit(f"{RULE}\n  "), mark(BOLD), F.lit("CODE REVIEW"), mark(RESET), F.format_string("\n  %d files, %d hunks analyzed\n", "files", "hunks"), F.lit(f"{RULE}\n\n"))
    some = F.concat(F.array_join("p.part", ""), F.lit(f"{RULE}\n  SUMMARY: "), F.col("n").cast("string"), F.lit(" findings ("), F.array_join("p.count", ", "), F.lit(f")\n{RULE}\n"))
    none = F.concat(F.lit("  "), mark(GREEN), F.lit("No issues found."), mark(RESET), F.lit("\n\n"))
    return reviewed.join(parts, "diff_id", "left").select("diff_id", F.concat(head, F.when(F.col("n") > 0, some).otherwise(none)).alias("report"))


def pull_request(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(diff_id, body) of all reviewed diffs: one comment with all findings."""
    fix = F.when(_given(F.col("fix")), F.concat(F.lit("  - Fix: "), "fix", F.lit("\n"))).otherwise("")
    entry = F.concat(F.lit("- **["), F.upper(severity_name(F.col("severity"))), F.lit("]** `"), place(ends=False), F.lit("` — "), "message", F.lit("\n"), fix)
    per = _joined(findings, ["diff_id"], ["seq"], entry, "entries")
    body = F.concat(F.lit("## Review — "), F.col("entries_n").cast("string"), F.lit(" findings\n\n"), "entries")
    return reviewed.select("diff_id").join(per, "diff_id", "left").select("diff_id", F.coalesce(body, F.lit("✅ No issues found.")).alias("body"))


def as_json(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(diff_id, report) of all reviewed diffs: their findings as a JSON array, severities by name; [] for none."""
    row = F.struct(*((severity_name(F.col(c)) if c == "severity" else F.col(c)).alias(c) for c in FIELDS))
    per = findings.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))).alias("rows"))
    text = F.to_json("rows.row", {"ignoreNullFields": "false"})
    return reviewed.select("diff_id").join(per, "diff_id", "left").select("diff_id", F.coalesce(text, F.lit("[]")).alias("report"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(diff_id, info, low, medium, high, critical): numbers of findings."""
    return findings.groupBy("diff_id").agg(*(F.count_if(F.col("severity") == k).alias(name) for k, name in enumerate(SEVERITIES)))
