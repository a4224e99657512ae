"""Unified diffs as relations.

A diff is one row (diff_id, raw). Files, hunks and lines are found by splitting the text at
line starts and by running sums inside the row, so that parsing never shuffles and a corpus of diffs
of any number is read at scan speed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import last_match, let, running_sums, total

ADDED, REMOVED, CONTEXT = 1, 2, 0
NO_NEWLINE = "\\ No newline at end of file"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _after(line: Column, prefix: str) -> Column:
    return F.substring(line, F.lit(len(prefix) + 1), F.length(line))


def _either(line: Column, *prefixes: str) -> Column:
    """The rest of the line after the first prefix that it has."""
    out = F.lit(None).cast("string")
    for p in reversed(prefixes):
        out = F.when(F.startswith(line, F.lit(p)), _after(line, p)).otherwise(out)
    return out


def _file(chunk: Column) -> Column:
    def begins(line: Column, *prefixes: str) -> Column:
        return reduce(or_, (F.startswith(line, F.lit(p)) for p in prefixes))

    def of(lines: Column) -> Column:
        """lines: those of the chunk that may say something of the file. What is used more than once is bound, as lambdas share no sub-expressions."""
        binary = F.exists(lines, lambda x: F.startswith(x, F.lit("Binary files")) & F.contains(x, F.lit("differ")))

        def last(*prefixes: str) -> Column:
            return F.coalesce(let(last_match(lines, lambda x: begins(x, *prefixes)), lambda x: _either(x, *prefixes)), F.lit(""))

        null_side = last_match(lines, lambda x: begins(x, "--- /dev/null", "+++ /dev/null"))
        renamed = F.exists(lines, lambda x: F.startswith(x, F.lit("rename from ")))

        def names(binary: Column) -> Column:
            path = F.when(binary, last("+++ b/")).otherwise(last("+++ b/", "rename to "))
            old = F.when(binary, last("--- a/")).otherwise(last("--- a/", "rename from "))
            return F.struct(path.alias("path"), old.alias("old"), F.coalesce(F.when(~binary, null_side), F.lit("")).alias("side"), binary.alias("binary"))

        def row(n: Column) -> Column:
            return F.struct(
                F.when(n["path"] != "", n["path"]).otherwise(n["old"]).alias("path"), n["old"].alias("old_path"),
                F.startswith(n["side"], F.lit("---")).alias("added"), F.startswith(n["side"], F.lit("+++")).alias("deleted"),
                (~n["binary"] & renamed).alias("renamed"), n["binary"].alias("binary"), chunk.alias("chunk"),
            )

        return let(let(binary, names), row)

    return let(F.filter(lines_of(chunk), lambda x: begins(x, "+++ ", "--- ", "rename ", "Binary files")), of)


def files(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_idx, path, old_path, added, deleted, renamed, binary, chunk): files with a path."""
    chunks = F.split(F.coalesce("raw", F.lit("")), r"(?dm)\n(?=diff --git)", -1)
    kept = F.filter(F.transform(chunks, _file), lambda f: f["path"] != "")
    return diffs.select("diff_id", F.posexplode(kept).alias("file_idx", "f")).select("diff_id", "file_idx", "f.*")


def _number(text: Column) -> Column:
    """A whole number, 0 if it isn't one or is negative."""
    value = F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]{1,9}\z")), text.try_cast("int"))
    return F.greatest(F.lit(0), F.coalesce(value, F.lit(0)))


def hunk_header(line: Column) -> Column:
    """old_start, old_count, new_start, new_count and the heading of a hunk's first line.

    Ranges may come in any order; counts default to 1, what can't be read is 0.
    """

    def parts(p: Column) -> Column:
        tokens = F.filter(F.split(F.trim(F.get(p, F.lit(1))), "[\t\n\u000b\f\r ]+"), lambda t: t != "")

        def side(tokens: Column, sign: str) -> Column:
            def counted(pair: Column) -> Column:
                start = F.when(pair.isNull(), 0).otherwise(_number(F.get(pair, F.lit(0))))
                count = F.when(pair.isNull(), 0).when(F.size(pair) < 2, 1).otherwise(_number(F.get(pair, F.lit(1))))
                return F.struct(start.alias("start"), count.alias("count"))

            token = last_match(tokens, lambda t: F.startswith(t, F.lit(sign)))
            return let(let(token, lambda t: F.split(_after(t, sign), ",", 2)), counted)

        def ranges(r: Column) -> Column:
            old, new = r["old"], r["new"]
            return F.struct(old["start"].alias("old_start"), old["count"].alias("old_count"), new["start"].alias("new_start"), new["count"].alias("new_count"), F.when(F.size(p) == 3, F.trim(F.get(p, F.lit(2)))).otherwise(line).alias("header"))

        return let(let(tokens, lambda t: F.struct(side(t, "-").alias("old"), side(t, "+").alias("new"))), ranges)

    return let(F.split(line, "@@", 3), parts)


def hunk_texts(chunk: Column) -> Column:
    """The texts of a file's hunks, each from its @@ on."""
    return F.filter(F.split(chunk, r"(?dm)(?:\n|\A)(?=@@)", -1), lambda p: F.startswith(p, F.lit("@@")))


def body_lines(body: Column) -> Column:
    """The lines of a hunk's body; none without a body."""
    return F.when(body.isNotNull(), F.filter(lines_of(body), lambda x: x != NO_NEWLINE)).otherwise(F.array().cast("array<string>"))


def content_of(line: Column) -> Column:
    """A hunk's line without the sign that it begins with."""
    return F.when(F.substring(line, 1, 1).isin("+", "-", " "), F.substring(line, F.lit(2), F.length(line))).otherwise(line)


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_idx, path, hunk_idx, old_start, old_count, new_start, new_count, header, body)."""
    rows = files(diffs).where("not binary").select("diff_id", "file_idx", "path", F.posexplode(hunk_texts(F.col("chunk"))).alias("hunk_idx", "piece"))
    head = hunk_header(F.substring_index("piece", "\n", 1))
    body = F.when(F.instr("piece", "\n") > 0, F.substring("piece", F.instr("piece", "\n") + 1, F.length("piece")))
    return rows.select("diff_id", "file_idx", "path", "hunk_idx", head.alias("h"), body.alias("body")).select("diff_id", "file_idx", "path", "hunk_idx", "h.*", "body")


def lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_idx, path, hunk_idx, line_idx, type, content, old_num, new_num, abs_new).

    old_num and new_num count within the hunk, 0 on the side that lacks the line; abs_new is the line's
    number in the new file, null for removed lines.
    """
    # One running sum counts both sides, the new one in the upper half. What else a line says is worked out beyond the row, where it is compiled.
    both = (1 << 32) + 1

    def numbered(rows: Column) -> Column:
        steps = F.transform(rows, lambda x: F.when(F.startswith(x, F.lit("+")), 1 << 32).when(F.startswith(x, F.lit("-")), 1).otherwise(both).cast("long"))
        return let(running_sums(steps), lambda sums: F.transform(rows, lambda x, i: F.struct(x.alias("x"), F.get(sums, i).alias("n"))))

    got = hunks(diffs).select("diff_id", "file_idx", "path", "hunk_idx", "new_start", F.posexplode(let(body_lines(F.col("body")), numbered)).alias("line_idx", "l"))
    x, n = F.col("l.x"), F.col("l.n")
    kind = F.when(F.startswith(x, F.lit("+")), ADDED).when(F.startswith(x, F.lit("-")), REMOVED).otherwise(CONTEXT)
    got = got.select(
        "diff_id", "file_idx", "path", "hunk_idx", "new_start", "line_idx", kind.alias("type"), content_of(x).alias("content"),
        F.when(kind == ADDED, 0).otherwise(n.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("old_num"),
        F.when(kind == REMOVED, 0).otherwise(F.shiftright(n, 32)).cast("int").alias("new_num"),
    )
    return got.select("diff_id", "file_idx", "path", "hunk_idx", "line_idx", "type", "content", "old_num", "new_num", F.when(F.col("new_num") > 0, F.col("new_start") - 1 + F.col("new_num")).alias("abs_new"))


def hunk_new_start(line: Column) -> Column:
    """Digits after the first + of a hunk's first line; 1 if there are none or they are 0."""
    digits = F.regexp_extract(line, r"(?s)\A[^+]*\+([0-9]{1,9})", 1)
    return F.greatest(F.lit(1), F.coalesce(F.when(digits != "", digits.cast("int")), F.lit(1)))


def new_side(diffs: DataFrame) -> DataFrame:
    """(diff_id, seq, file, line, text, added): added and context lines with numbers of the new file.

    A parser of its own: it knows headers by their first characters wherever they stand, and counts every line that
    isn't removed. Text of context lines keeps its first blank.
    """
    parts = F.split(F.coalesce("raw", F.lit("")), r"(?dm)(?:\n|\A)(?=\+\+\+ )", -1)

    def of_part(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        name = F.when(F.startswith(part, F.lit("+++ b/")), _after(head, "+++ b/")).when(F.startswith(part, F.lit("+++ ")), _after(head, "+++ ")).otherwise("")
        pieces = F.split(part, r"(?dm)(?:\n|\A)(?=@@ )", -1)

        def of_file(file: Column) -> Column:
            """The file's name is bound: within the pieces it would be worked out again for each."""

            def of_piece(piece: Column) -> Column:
                is_hunk, is_file = F.startswith(piece, F.lit("@@ ")), F.startswith(piece, F.lit("+++ "))
                rows = F.when(is_hunk | is_file, F.slice(lines_of(piece), F.lit(2), F.length(piece) + 1)).otherwise(lines_of(piece))
                base = F.when(is_hunk, hunk_new_start(F.substring_index(piece, "\n", 1)) - 1).otherwise(0)
                # Removed lines go first: the others' numbers are then their places.
                return F.struct(file.alias("file"), base.alias("base"), F.filter(rows, lambda x: ~F.startswith(x, F.lit("-"))).alias("rows"))

            return F.transform(pieces, of_piece)

        return let(name, of_file)

    def placed(pieces: Column) -> Column:
        """Pieces with the number of lines up to their end."""
        ends = running_sums(F.transform(pieces, lambda p: F.size(p["rows"]).cast("long")))
        return let(ends, lambda ends: F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.get(ends, i).alias("end"))))

    pieces = let(F.flatten(F.transform(parts, of_part)), placed)
    rows = diffs.select("diff_id", F.explode(pieces).alias("x")).select("diff_id", "x.p.file", "x.p.base", (F.col("x.end") - F.size("x.p.rows")).alias("before"), F.posexplode("x.p.rows").alias("at", "text"))
    added = F.startswith("text", F.lit("+")) & ~F.startswith("text", F.lit("+++"))
    line = (F.col("base") + F.col("at") + 1).cast("int")
    return rows.select("diff_id", (F.col("before") + F.col("at")).cast("long").alias("seq"), "file", line.alias("line"), F.when(added, _after(F.col("text"), "+")).otherwise(F.col("text")).alias("text"), added.alias("added"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, seq, file, line, text) of added lines, numbered in the new file."""
    return new_side(diffs).where("added").drop("added")


def raw_added(diffs: DataFrame) -> DataFrame:
    """(diff_id, pos, file, text): added lines at their place, from 0, in the raw text."""
    rows = lines_of(F.coalesce("raw", F.lit("")))
    numbered = diffs.select("diff_id", "raw", F.posexplode(rows).alias("pos", "x"))
    return numbered.where("startswith(x, '+') and not startswith(x, '+++')").select("diff_id", "pos", _after(F.col("x"), "+").alias("text"))


def source_lines(sources: DataFrame) -> DataFrame:
    """(path, line, text) of whole files (path, content), lines from 1."""
    return sources.select("path", F.posexplode(lines_of(F.coalesce("content", F.lit("")))).alias("_p", "text")).select("path", (F.col("_p") + 1).alias("line"), "text")


def line_range(sources: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last of every file, first clamped to 1; paths that climb out with .. give nothing."""
    rows = F.slice(lines_of(F.coalesce("content", F.lit(""))), max(first, 1), max(0, last - max(first, 1) + 1))
    inside = sources.where(~F.exists(F.split("path", "/"), lambda p: p == ".."))
    return inside.select("path", F.posexplode(rows).alias("_p", "text")).select("path", (F.col("_p") + max(first, 1)).alias("line"), "text")


def combine(changes: DataFrame) -> DataFrame:
    """(diff_id, raw): the non-empty diffs of a change's files (diff_id, seq, diff), in order, each ending in a newline."""
    part = F.concat("diff", F.when(F.endswith("diff", F.lit("\n")), F.lit("")).otherwise(F.lit("\n")))
    rows = changes.select("diff_id", "seq", F.when(F.coalesce("diff", F.lit("")) != "", part).otherwise(F.lit("")).alias("part"))
    return rows.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("raw"))


def summary(diffs: DataFrame) -> DataFrame:
    """(diff_id, files, insertions, deletions, summary) of every diff, counted inside its row."""
    chunks = F.split(F.coalesce("raw", F.lit("")), r"(?dm)\n(?=diff --git)", -1)
    kept = F.filter(F.transform(chunks, _file), lambda f: f["path"] != "")

    def changed(sign: str) -> Column:
        """Lines of all hunks that begin with a sign."""

        def of_file(f: Column) -> Column:
            hunks = F.filter(F.split(f["chunk"], r"(?dm)(?:\n|\A)(?=@@)", -1), lambda p: F.startswith(p, F.lit("@@")) & (F.instr(p, "\n") > 0))
            return F.when(f["binary"], 0).otherwise(total(F.transform(hunks, lambda p: F.regexp_count(F.substring(p, F.instr(p, "\n") + 1, F.length(p)), F.lit(rf"(?dm)^{sign}")).cast("long"))))

        return total(F.transform("_files", of_file))

    rows = diffs.select("diff_id", kept.alias("_files"))
    rows = rows.select("diff_id", F.size("_files").cast("long").alias("files"), changed(r"\+").alias("insertions"), changed("-").alias("deletions"))
    return rows.withColumn("summary", F.format_string("%d files changed, %d insertions(+), %d deletions(-)", "files", "insertions", "deletions"))


def language_histogram(found: DataFrame) -> DataFrame:
    """(diff_id, ext, n, rank) over files that aren't deleted: by count, then extension. Files without extension count by name."""
    base = F.regexp_extract("path", r"[^/]*\z", 0)
    ext = F.regexp_extract(base, r"\.[^.]*\z", 0)
    counts = found.where("not deleted").groupBy("diff_id", F.when(ext != "", ext).otherwise(base).alias("ext")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    return counts.withColumn("rank", F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("n"), "ext")))
