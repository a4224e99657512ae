"""Prompts for a language model, assembled from diffs and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .diff import body_lines

CONCERNS = {
    "security": "Look for injection, leaked secrets, broken access checks and unsafe input handling.",
    "bugs": "Look for null values, boundary mistakes, leaked resources, swallowed errors and races.",
    "performance": "Look for needless work, repeated queries and unbounded memory.",
    "correctness": "Look for code that differs from its intent, unchecked results and broken contracts.",
    "style": "Look for departures from the conventions of the code around, duplication, unclear names and missing structure.",
}
# What a security review looks for.
SECURITY_CONCERNS = [
    "SQL injection vulnerabilities (unsanitized user input in queries)", "XSS vulnerabilities (unescaped output in HTML templates)", "Command injection (user input in exec/system calls)",
    "Path traversal (user input in file paths without sanitization)", "Hardcoded secrets (API keys, passwords, tokens in source)", "Insecure crypto (MD5, SHA1 for security, weak random)",
    "Missing authentication/authorization checks", "SSRF vulnerabilities (user-controlled URLs in server requests)", "Race conditions (shared state without synchronization)",
    "Resource leaks (unclosed connections, files, channels)",
]
ANSWER = 'Answer with a JSON array of objects with file, line, end_line, severity, message, fix, reasoning, cwe and confidence. Answer [] if there is nothing to report.'


def concerns(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(name, system_prompt) of the named concerns, all if none are named; unknown names are left out."""
    rows = [(k, f"You review code for {k}. {v}\n{ANSWER}") for k, v in CONCERNS.items() if not names or k in names]
    return spark.createDataFrame(rows, "name string, system_prompt string")


def build(hunks: DataFrame) -> DataFrame:
    """(diff_id, prompt): per file its hunks, new lines and old lines apart, as their bodies hold them."""

    def side(sign: str) -> F.Column:
        return F.array_join(F.filter(body_lines(F.col("body")), lambda x: F.startswith(x, F.lit(sign))), "\n")

    text = F.concat(F.lit("@@ new "), F.col("new_start").cast("string"), F.lit("\n"), side("+"), F.lit("\n@@ old\n"), side("-"))
    rows = hunks.select("diff_id", "file_idx", "path", "hunk_idx", text.alias("t"))
    per_file = rows.groupBy("diff_id", "file_idx", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hunk_idx", "t"))), lambda r: r["t"]), "\n").alias("t"))
    body = F.struct("file_idx", F.concat(F.lit("## "), "path", F.lit("\n"), "t").alias("t"))
    return per_file.groupBy("diff_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(body)), lambda r: r["t"]), "\n").alias("prompt"))


def sast_section(findings: DataFrame, limit: int = 50, evidence: int = 200) -> DataFrame:
    """(diff_id, section): the first `limit` findings of the scanner, for a model to confirm or dismiss."""
    from pyspark.sql import Window as W

    rows = findings.withColumn("_n", F.row_number().over(W.partitionBy("diff_id").orderBy("seq"))).where(F.col("_n") <= limit)
    line = F.concat(F.lit("- "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.substring("message", 1, evidence))
    return rows.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda r: r["t"]), "\n").alias("section"))


#: Characters of a diff that a reflection shows, and of its whole prompt; a longer one isn't asked.
REFLECT_DIFF, REFLECT_PROMPT = 8000, 100_000
REFLECT_SYSTEM = (
    "You check findings of a code review against the diff. For each finding answer whether it holds.\n"
    'Answer with a JSON array of objects with index, action (keep, drop or adjust), severity, score from 1 to 10, message and reason.'
)


def reflect_prompt(findings: DataFrame, diffs: DataFrame) -> DataFrame:
    """(diff_id, system_prompt, prompt): what is asked about all findings of a diff, numbered from 0 in order of seq, with the diff itself.

    Diffs without findings aren't asked about, nor those whose prompt would be too long.
    """
    from pyspark.sql import Window as W

    from ..schemas import severity_name

    index = F.row_number().over(W.partitionBy("diff_id").orderBy("seq")) - 1
    fix = F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("   Fix: "), "fix", F.lit("\n"))).otherwise("")
    line = F.concat(F.format_string("%d. [%s][%s] %s:%d \u2014 %s\n", "_i", severity_name(F.col("severity")), "concern", "file", "line", "message"), fix)
    rows = findings.withColumn("_i", index).select("diff_id", F.struct("_i", line.alias("t")).alias("r"))
    listed = rows.groupBy("diff_id").agg(F.array_join(F.array_sort(F.collect_list("r"))["t"], "").alias("_listed"))
    shown = F.when(F.length("raw") > REFLECT_DIFF, F.concat(F.substring("raw", 1, REFLECT_DIFF), F.lit("\n... (truncated)\n"))).otherwise(F.col("raw"))
    text = F.concat(F.lit("Check these findings against the diff below.\n\n## Findings\n\n"), "_listed", F.lit("\n## Diff\n\n```diff\n"), shown, F.lit("```\n"))
    prompts = listed.join(diffs.select("diff_id", F.coalesce("raw", F.lit("")).alias("raw")), "diff_id").select("diff_id", F.lit(REFLECT_SYSTEM).alias("system_prompt"), text.alias("prompt"))
    return prompts.where(F.length("prompt") <= REFLECT_PROMPT)
