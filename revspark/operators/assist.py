"""What surrounds a finding or a change when a model is asked about it, and what is read from its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from ..plans.store import stored
from ..schemas import severity_name
from ..sources.files import clean_path
from .diff import lines_of
from .responses import filter_verdict, json_array, json_object


def code_context(content: Column, line: Column) -> Column:
    """The lines from five before a line up to the fourth after it; empty beyond the file."""

    def window(rows: Column) -> Column:
        start = F.greatest(line - 5, F.lit(0))
        end = F.least(line + 5, F.size(rows))
        return F.when(end > start, F.array_join(F.slice(rows, start + 1, end - start), "\n")).otherwise("")

    return let(lines_of(F.coalesce(content, F.lit(""))), window)


def relevant_diff(raw: Column, file: Column, line: Column, limit: int = 500) -> Column:
    """Of a file's part of a diff the lines that stand at most five from place `line`, counted from 1 without headers."""

    def is_header(x: Column) -> Column:
        return F.startswith(x, F.lit("diff --git")) | F.startswith(x, F.lit("--- ")) | F.startswith(x, F.lit("+++ "))

    def part(rows: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(rows) - 1)
        mine = F.get(F.filter(places, lambda i: is_header(F.get(rows, i)) & F.contains(F.get(rows, i), file)), F.lit(0))
        other = F.get(F.filter(places, lambda i: (i > mine) & is_header(F.get(rows, i)) & ~F.contains(F.get(rows, i), file)), F.lit(0))
        body = F.filter(F.slice(rows, mine + 1, F.coalesce(other, F.size(rows)) - mine), lambda x: ~is_header(x))
        first = F.greatest(line - 5, F.lit(1))
        near = F.slice(body, first, F.greatest(line + 5 - first + 1, F.lit(0)))
        return F.when(mine.isNotNull(), F.substring(F.array_join(near, "\n"), 1, limit)).otherwise("")

    return let(lines_of(F.coalesce(raw, F.lit(""))), part)


def context_lines(hunks: DataFrame, n: int = 3) -> DataFrame:
    """(diff_id, file_idx, path, hunk_idx, line): the lines of the new file that stand up to n before each hunk."""
    before = F.sequence(F.greatest(F.lit(1), F.col("new_start") - n), F.col("new_start") - 1)
    return hunks.where("new_start > 1").select("diff_id", "file_idx", "path", "hunk_idx", F.explode(before).alias("line"))


_HUNK = r"@@ -([0-9]+),?[0-9]* \+([0-9]+),?[0-9]* @@"


def _pieces(raw: Column, n: int, merge: bool) -> Column:
    """What stands between the headers of a diff's files and hunks, in order: part, piece, path, text, and for hunks of a known place the lines first to start - 1 that are asked for."""

    def of_part(part: Column, i: Column) -> Column:
        path = F.when(F.startswith(part, F.lit("+++ b/")), F.regexp_extract(part, r"(?d)\A\+\+\+ b/(.*)", 1)).otherwise("")

        def start(text: Column, inside: Column) -> Column:
            return F.when(inside & F.rlike(text, F.lit(rf"(?d)\A{_HUNK}")), F.regexp_extract(text, rf"(?d)\A{_HUNK}", 1).cast("long"))

        def hunks(path: Column) -> Column:
            inside = (path != "") & ~F.contains(clean_path(path), F.lit(".."))
            texts = F.split(part, rf"(?dm)^(?={_HUNK})", -1)
            return let(inside, lambda inside: let(F.transform(texts, lambda t: F.struct(t.alias("text"), start(t, inside).alias("start"))), lambda found: rows(path, found)))

        def rows(path: Column, found: Column) -> Column:
            def row(x: Column, j: Column) -> Column:
                first = F.greatest(F.lit(1), x["start"] - n)
                if merge:
                    # What a hunk shows of the old file: as many lines as it has context and removed lines.
                    before = F.get(found, j - 1)
                    first = F.greatest(first, F.coalesce(before["start"] + F.regexp_count(before["text"], F.lit(r"(?dm)^[ -]")), F.lit(1)))
                return F.struct(i.alias("part"), j.alias("piece"), path.alias("path"), x["text"].alias("text"), first.alias("first"), x["start"].alias("start"))

            return F.transform(found, row)

        return let(path, hunks)

    return F.flatten(F.transform(F.split(raw, r"(?dm)^(?=\+\+\+ b/)", -1), of_part))


def _is_asked(piece: Column) -> Column:
    return F.coalesce(piece["first"] < piece["start"], F.lit(False))


def _block(files: Column, first: Column, start: Column) -> Column:
    """Lines first to start - 1 of a file, numbered and with a heading; empty without such lines. files: its lines, once for each content that it has."""
    place = F.least(first, F.lit((1 << 31) - 1)).cast("int")

    def part(lines: Column) -> Column:
        return F.transform(F.slice(lines, place, (start - first).cast("int")), lambda x, k: F.struct((first + k).alias("line"), F.concat(F.lit("  "), (first + k).cast("string"), F.lit(" | "), x, F.lit("\n")).alias("row")))

    def text(rows: Column) -> Column:
        head = F.format_string("\n--- Context before (lines %d-%d) ---\n", F.get(rows, F.lit(0))["line"], F.get(rows, F.size(rows) - 1)["line"])
        return F.when(F.size(rows) > 0, F.concat(head, F.array_join(F.transform(rows, lambda r: r["row"]), ""))).otherwise("")

    return let(F.sort_array(F.flatten(F.transform(files, part))), text)


def with_context(diffs: DataFrame, contents: DataFrame, n: int = 10, merge: bool = False) -> DataFrame:
    """diffs (diff_id, raw, ...) with enriched: the text with up to n lines of the old file before each hunk, numbered.

    contents: diff_id, path, content of the files; a file that is missing, too short or outside the repository adds nothing. Lines have their true numbers.
    merge: lines that the hunk before already shows, or its own context, aren't shown again. A null text stays null.

    A file meets what is asked of it in one row and is cut there, so that its lines are never rows: only the blocks go on, and are put in where
    the diff is parsed again. What is shuffled is each file once and each diff once.
    """
    asked = F.transform(F.filter(_pieces(F.col("raw"), n, merge), _is_asked), lambda p: F.struct(p["path"].alias("path"), F.struct(*(p[c].alias(c) for c in ("part", "piece", "first", "start"))).alias("ask")))
    asked = diffs.where("raw is not null").select("diff_id", F.explode(asked).alias("a")).select("diff_id", "a.path", "a.ask")
    both = asked.unionByName(contents.select("diff_id", "path", "content"), allowMissingColumns=True).repartition("diff_id", "path")
    met = both.groupBy("diff_id", "path").agg(F.collect_list("ask").alias("asks"), F.collect_list("content").alias("files")).where(F.size("asks") > 0)
    lines = F.transform("files", lambda c: lines_of(F.regexp_replace(c, r"\n\z", "")))
    blocks = let(lines, lambda files: F.transform("asks", lambda a: F.struct(a["part"].alias("part"), a["piece"].alias("piece"), _block(files, a["first"], a["start"]).alias("block"))))
    blocks = stored(met.select("diff_id", F.explode(blocks).alias("b")).select("diff_id", "b.*"), "context-pieces")  # the files' shuffle goes here
    texts = blocks.repartition("diff_id").groupBy("diff_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "block"))).alias("_blocks"))

    def put(pieces: Column) -> Column:
        """All pieces that ask have a block, in the same order."""
        places = running_sums(F.transform(pieces, lambda p: _is_asked(p).cast("long")))
        return let(places, lambda places: F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(_is_asked(p), F.get(F.col("_blocks"), (F.get(places, i) - 1).cast("int"))["block"]).otherwise(""), p["text"])), ""))

    return diffs.join(texts, "diff_id", "left").withColumn("enriched", let(_pieces(F.col("raw"), n, merge), put)).drop("_blocks")


def validation_prompt() -> Column:
    """What is asked about a finding (with its code_context) before it is kept."""
    return F.format_string(
        "Is this finding real or a false positive?\nconcern: %s\nseverity: %s\nplace: %s:%d\nmessage: %s\nfix: %s\n\n%s\n\nAnswer with\nCONFIRMED: yes/no\nCONFIDENCE: 0.0-1.0\nREASONING: one line",
        "concern", severity_name(F.col("severity")), "file", "line", "message", "fix", "code_context",
    )


def verdicts(answers: DataFrame) -> DataFrame:
    """(diff_id, seq, confirmed, confidence, reasoning) of answers (diff_id, seq, content); null and empty ones, as calls that failed leave them, confirm at 0.5."""
    v = filter_verdict(F.col("content"))
    failed = F.struct(F.lit(True).alias("confirmed"), F.lit(0.5).alias("confidence"), F.lit("validation failed, keeping finding").alias("reasoning"))
    return answers.select("diff_id", "seq", F.when(F.coalesce("content", F.lit("")) == "", failed).otherwise(v).alias("v")).select("diff_id", "seq", "v.*")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def parse_fix(answer: Column) -> Column:
    """fixed_code, explanation and confidence of an answer with FIXED: and EXPLANATION:; null without code."""
    fixed, explained = F.instr(answer, "FIXED:"), F.instr(answer, "EXPLANATION:")
    both = explained > fixed
    code = _strip(F.when(both, F.substring(answer, fixed + 6, explained - fixed - 6)).otherwise(F.substring(answer, fixed + 6, F.length(answer))))
    why = F.when(both, _strip(F.substring(answer, explained + 12, F.length(answer)))).otherwise("")
    return F.when((fixed > 0) & (code != ""), F.struct(code.alias("fixed_code"), why.alias("explanation"), F.lit(0.7).alias("confidence")))


def parse_improvements(answer: Column) -> Column:
    """Improvements of an answer that name a file, a description and new code."""
    kind = "array<struct<file:string,line:int,end_line:int,category:string,description:string,before:string,after:string,reasoning:string>>"
    return F.filter(F.from_json(json_array(answer), kind), lambda i: (F.coalesce(i["file"], F.lit("")) != "") & (F.coalesce(i["description"], F.lit("")) != "") & (F.coalesce(i["after"], F.lit("")) != ""))


def parse_description(answer: Column, first_path: Column, summary: Column) -> Column:
    """title, summary, change_type and risk of an answer; from the diff itself if it has no title."""
    got = F.from_json(json_object(answer), "struct<title:string,summary:string,change_type:string,risk:string,changes:array<string>>")
    plain = F.struct(F.concat(F.lit("Update "), first_path).alias("title"), summary.alias("summary"), F.lit("chore").alias("change_type"), F.lit("low").alias("risk"))
    return F.when(F.coalesce(got["title"], F.lit("")) != "", F.struct(got["title"].alias("title"), got["summary"].alias("summary"), got["change_type"].alias("change_type"), got["risk"].alias("risk"))).otherwise(plain)


def fused_prompt(prompt: Column, section: Column, marker: str = "<diff_content>") -> Column:
    """The prompt with a section put before the marker, or in front if there is no marker; as it is without a section."""
    at = F.instr(prompt, marker)
    merged = F.concat(F.substring(prompt, F.lit(1), F.greatest(at - 1, F.lit(0))), section, F.lit("\n"), F.substring(prompt, F.greatest(at, F.lit(1)), F.length(prompt)))
    return F.when(F.coalesce(section, F.lit("")) == "", prompt).otherwise(merged)
