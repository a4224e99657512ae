"""What a model is asked besides a review: descriptions of changes, improvements, fixes of findings. Each is one plan over a corpus of diffs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import assist, budget, diff
from ..schemas import severity_name
from .answers import Provider
from .review import Review
from .store import stored

DESCRIBE = "You describe changes. Answer with a JSON object with title, summary, changes, change_type, risk and test_plan."
IMPROVE = (
    "You suggest how working code could be better: names, simplicity, speed, idiom, repetition, error messages.\n"
    "Answer with a JSON array of objects with file, line, end_line, category, description, before, after and reasoning. Answer [] if there is nothing to suggest."
)
FIX = "You fix findings of a code review. Answer with\nFIXED:\n<code>\nEXPLANATION: <one sentence>"
CUT = "\n(the diff is cut to fit; the list of files above is whole)\n"


def _joined(rows: DataFrame, order: str, text: Column, name: str) -> DataFrame:
    """(diff_id, name): the texts of every diff in order, one after the other."""
    got = rows.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct(order, text.alias("_t")))).alias("_r"))
    return got.select("diff_id", F.array_join("_r._t", "").alias(name))


def sections(diffs: DataFrame, head: Column, headers: bool = False) -> DataFrame:
    """(diff_id, file_idx, path, text) of files that aren't deleted: head, then their hunks' lines with signs, with the hunks' headers if asked for."""
    sign = F.when(F.col("type") == diff.ADDED, "+").when(F.col("type") == diff.REMOVED, "-").otherwise(" ")
    rows = diff.lines(diffs).select("diff_id", "file_idx", "hunk_idx", "line_idx", F.concat(sign, "content", F.lit("\n")).alias("t"))
    if headers:
        range_ = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count")
        rows = rows.unionByName(diff.hunks(diffs).select("diff_id", "file_idx", "hunk_idx", F.lit(-1).alias("line_idx"), F.concat(range_, F.when(F.col("header") != "", F.concat(F.lit(" "), F.trim("header"))).otherwise(""), F.lit("\n")).alias("t")))
    body = rows.groupBy("diff_id", "file_idx").agg(F.array_sort(F.collect_list(F.struct("hunk_idx", "line_idx", "t"))).alias("r"))
    kept = diff.files(diffs).where("not deleted").select("diff_id", "file_idx", "path", head.alias("head"))
    return kept.join(body, ["diff_id", "file_idx"], "left").select("diff_id", "file_idx", "path", F.concat("head", F.coalesce(F.array_join("r.t", ""), F.lit(""))).alias("text"))


def describe_prompt(diffs: DataFrame, max_tokens: int) -> DataFrame:
    """(diff_id, system_prompt, prompt, first_path, summary) of diffs with files: statistics and all files, then as much of the diff as three times max_tokens leave."""
    files = diff.files(diffs)
    what = F.when(F.col("added"), " (new)").when(F.col("deleted"), " (deleted)").when(F.col("renamed"), F.concat(F.lit(" (renamed from "), "old_path", F.lit(")"))).otherwise("")
    listed = _joined(files, "file_idx", F.concat(F.lit("- "), "path", what, F.lit("\n")), "files")
    first = files.groupBy("diff_id").agg(F.min_by("path", "file_idx").alias("first_path"))
    heads = listed.join(diff.summary(diffs).select("diff_id", "summary"), "diff_id").join(first, "diff_id")
    head = F.concat(F.lit("Describe these changes.\n\n## Statistics\n"), "summary", F.lit("\n\n## Files\n\n"), "files")
    heads = heads.select("diff_id", "first_path", "summary", head.alias("head"))
    parts = sections(diffs, F.concat(F.lit("--- "), "path", F.lit("\n"))).join(heads.select("diff_id", (max_tokens * 3 - estimate_tokens(F.col("head")) - 100).alias("_left")), "diff_id")
    kept = budget.sections_within(parts, F.col("_left"))
    shown = _joined(kept, "file_idx", F.col("text"), "shown").join(kept.groupBy("diff_id").agg(F.count("*").alias("_kept")), "diff_id")
    every = parts.groupBy("diff_id").agg(F.count("*").alias("_all"))
    rows = heads.join(every, "diff_id", "left").join(shown, "diff_id", "left")
    cut = F.when(F.coalesce("_kept", F.lit(0)) < F.coalesce("_all", F.lit(0)), CUT).otherwise("")
    text = F.concat("head", F.lit(budget.DIFF_HEADER), F.coalesce("shown", F.lit("")), F.lit("```\n"), cut)
    return rows.select("diff_id", F.lit(DESCRIBE).alias("system_prompt"), text.alias("prompt"), "first_path", "summary")


def improve_prompt(diffs: DataFrame, max_tokens: int) -> DataFrame:
    """(diff_id, system_prompt, prompt): the first files that fit in three times max_tokens, one at least."""
    sized = budget.file_tokens(diff.files(diffs))
    asked = F.lit(IMPROVE)
    limit = diffs.sparkSession.range(1).select(estimate_tokens(asked)).first()[0]  # of a fixed text
    kept = budget.truncate_files(sized, max(1, max_tokens * 3 - limit - 200)).select("diff_id", "file_idx")
    parts = sections(diffs, F.concat(F.lit("--- "), "path", F.lit("\n+++ "), "path", F.lit("\n")), headers=True).join(kept, ["diff_id", "file_idx"])
    text = F.concat(F.lit("Suggest improvements to these changes.\n\n```diff\n"), "shown", F.lit("```\n"))
    return _joined(parts, "file_idx", F.col("text"), "shown").select("diff_id", asked.alias("system_prompt"), text.alias("prompt"))


def fix_prompt(findings: DataFrame, diffs: DataFrame) -> DataFrame:
    """(diff_id, seq, system_prompt, prompt) of findings above info, each with the lines of its file's diff around it."""
    rows = findings.where("severity > 0").join(diffs.select("diff_id", "raw"), "diff_id", "left")
    near = assist.relevant_diff(F.col("raw"), F.col("file"), F.col("line"))
    text = F.concat(F.format_string("File: %s (line %d)\nSeverity: %s\nIssue: %s\n\n", "file", "line", severity_name(F.col("severity")), "message"), near)
    return rows.select("diff_id", "seq", F.lit(FIX).alias("system_prompt"), text.alias("prompt"))


@dataclass
class Assistant:
    """Asks a provider; with a folder of answers, what was asked once isn't asked again."""

    provider: Provider
    answers: str | None = None
    max_tokens: int = 4096

    def _ask(self, requests: DataFrame) -> DataFrame:
        """Answers, stored, so that no later step calls the provider again."""
        return stored(Review(provider=self.provider, answers=self.answers).ask(requests), "assistant-answers")

    def describe(self, diffs: DataFrame) -> DataFrame:
        """(diff_id, title, summary, change_type, risk) of every diff; without a readable answer from the diff itself, "No changes" for one without files."""
        said = self._ask(describe_prompt(diffs, self.max_tokens)).select("diff_id", assist.parse_description(F.col("content"), F.col("first_path"), F.col("summary")).alias("d"))
        none = F.struct(F.lit("No changes").alias("title"), F.lit("Empty diff").alias("summary"), F.lit("").alias("change_type"), F.lit("").alias("risk"))
        return diffs.select("diff_id").join(said, "diff_id", "left").select("diff_id", F.coalesce("d", none).alias("d")).select("diff_id", "d.*")

    def improve(self, diffs: DataFrame) -> DataFrame:
        """(diff_id, pos, file, line, end_line, category, description, before, after, reasoning): what the provider suggests."""
        said = self._ask(improve_prompt(diffs, self.max_tokens))
        return said.select("diff_id", F.posexplode(assist.parse_improvements(F.col("content"))).alias("pos", "i")).select("diff_id", "pos", "i.*")

    def fix(self, findings: DataFrame, diffs: DataFrame) -> DataFrame:
        """(diff_id, seq, fixed_code, explanation, confidence) of findings that the provider has code for."""
        said = self._ask(fix_prompt(findings, diffs)).select("diff_id", "seq", assist.parse_fix(F.col("content")).alias("f"))
        return said.where("f is not null").select("diff_id", "seq", "f.*")
