"""Operators that fit text into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, token_counts, tokens_of
from ..plans.store import release, stored
from .diff import body_lines, content_of, hunk_texts


def file_tokens(files: DataFrame) -> DataFrame:
    """(diff_id, file_idx, path, deleted, tokens) of parsed files: tokens of the path + 20, 10 a hunk, each line's + 1.

    Files split into their hunks and these into lines on the way to one sum per file; nothing is joined.
    """
    key = ["diff_id", "file_idx", "path", "deleted"]
    pieces = F.when(~F.col("binary"), hunk_texts(F.col("chunk")))
    hunks = files.select(*key, F.explode_outer(pieces).alias("_hunk"))
    body = F.when(F.instr("_hunk", "\n") > 0, F.substring("_hunk", F.instr("_hunk", "\n") + 1, F.length("_hunk")))
    lines = hunks.select(*key, F.col("_hunk").isNotNull().alias("_is_hunk"), F.posexplode_outer(body_lines(body)).alias("_at", "_line"))
    begins = F.col("_is_hunk") & (F.coalesce("_at", F.lit(0)) == 0)
    cost = F.when(begins, 10).otherwise(0) + F.when(F.col("_line").isNotNull(), estimate_tokens(content_of(F.col("_line"))) + 1).otherwise(0)
    return lines.groupBy(*key).agg(F.sum(cost).alias("_sum")).select(*key, (estimate_tokens(F.col("path")) + 20 + F.col("_sum")).alias("tokens"))


#: Rows in order that one task adds up; sums of such cells are added up in their turn.
CELL = 4096


def running(rows: DataFrame, key: list[str], order: str, **sizes: Column) -> DataFrame:
    """rows with running totals, up to and with each row, in the order of a whole number that is unique within the key.

    Cells of CELL numbers are added up side by side, so that a large key splits over tasks.
    """
    own = rows.withColumns({"_cell": F.floor(F.col(order) / CELL), **{f"_own_{name}": size for name, size in sizes.items()}})
    cells = own.groupBy(*key, "_cell").agg(*(F.sum(f"_own_{name}").alias(f"_cell_{name}") for name in sizes))
    before = W.partitionBy(*key).orderBy("_cell")
    cells = cells.select(*key, "_cell", *((F.sum(f"_cell_{name}").over(before) - F.col(f"_cell_{name}")).alias(f"_cell_{name}") for name in sizes))
    within = W.partitionBy(*key, "_cell").orderBy(order)
    out = own.join(cells, [*key, "_cell"])
    return out.select(*rows.columns, *((F.col(f"_cell_{name}") + F.sum(f"_own_{name}").over(within)).cast("long").alias(name) for name in sizes))


def available(max_tokens: int, system_tokens: int) -> int | None:
    """Tokens for the files of one prompt: what the system prompt and 200 for framing leave, or half of all; None: no limit."""
    if max_tokens <= 0:
        return None
    left = max_tokens - system_tokens - 200
    return left if left > 0 else max(1, max_tokens // 2)


def chunk(sized: DataFrame, available: int | None) -> DataFrame:
    """sized (diff_id, file_idx, tokens) with chunk: next-fit in order; a file over budget is a chunk of its own.

    Every file knows where the next chunk begins if one begins with it: after the last running total that its own start
    and the budget admit. Which files do begin one follows from the first by doubling these jumps, in as many rounds
    as the number of chunks has binary digits. Null tokens are 0; None as budget gives one chunk; no files give none.
    """
    if available is None:
        return sized.withColumn("chunk", F.lit(0))
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    rows = running(sized.select("diff_id", "file_idx", tokens.alias("tokens")), ["diff_id"], "file_idx", end=F.col("tokens"), n=F.lit(1))
    rows = stored(rows.select("diff_id", "file_idx", (F.col("n") - 1).alias("at"), (F.col("end") - F.col("tokens")).alias("start"), "end"), "chunk-sums")
    # Totals fall into cells as wide as the budget. The total before a file is in the cell before that of its limit, so two cells tell.
    ends = rows.select("diff_id", "at", F.col("end").alias("value"), F.lit(0).alias("asks"))
    limits = rows.select("diff_id", "at", (F.col("start") + available).alias("value"), F.lit(1).alias("asks"))
    both = ends.unionByName(limits).withColumn("cell", F.floor(F.col("value") / available))
    order = W.partitionBy("diff_id", "cell").orderBy("value", "asks", "at")
    placed = both.withColumn("_last", F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(order)).where("asks = 1")
    tops = ends.groupBy("diff_id", (F.floor(F.col("value") / available) + 1).alias("cell")).agg(F.max("at").alias("_top"))
    after = F.greatest(F.coalesce("_last", "_top", F.lit(-1)) + 1, F.col("at") + 1)
    jumps = placed.join(tops, ["diff_id", "cell"], "left").select("diff_id", "at", after.alias("to"))
    jumps = stored(jumps.join(rows.select("diff_id", F.col("at").alias("to")), ["diff_id", "to"], "left_semi").select("diff_id", "at", "to"), "chunk-jumps")
    begins = stored(rows.where("at = 0").select("diff_id", "at"), "chunk-begins")
    while True:
        fresh = stored(begins.join(jumps, ["diff_id", "at"]).select("diff_id", F.col("to").alias("at")), "chunk-fresh")
        if fresh.isEmpty():
            break
        was, begins = begins, stored(begins.unionByName(fresh), "chunk-begins")
        further = jumps.withColumnRenamed("to", "_mid").join(jumps.select("diff_id", F.col("at").alias("_mid"), "to"), ["diff_id", "_mid"])
        old, jumps = jumps, stored(further.select("diff_id", "at", "to"), "chunk-jumps")
        release(was, fresh, old)
    marked = rows.select("diff_id", "file_idx", "at").join(begins.withColumn("_begins", F.lit(1)), ["diff_id", "at"], "left")
    numbers = running(marked, ["diff_id"], "file_idx", number=F.coalesce("_begins", F.lit(0))).select("diff_id", "file_idx", (F.col("number") - 1).cast("int").alias("chunk"))
    return sized.join(numbers, ["diff_id", "file_idx"]).select(*sized.columns, "chunk")


def prefix_within(rows: DataFrame, key: str, order: str, size: str, budget: int, at_least_one: bool = True) -> DataFrame:
    """The rows of each key, in order, up to the first that overflows the budget; the first always if at_least_one."""
    w = W.partitionBy(key).orderBy(order)
    got = rows.withColumn("_sum", F.sum(size).over(w)).withColumn("_n", F.row_number().over(w))
    keep = F.col("_sum") <= budget
    return got.where(keep | (F.col("_n") == 1) if at_least_one else keep).drop("_sum", "_n")


def truncate_files(sized: DataFrame, budget: int) -> DataFrame:
    """Files that aren't deleted, in order, up to the first overflow, one at least."""
    return prefix_within(sized.where("not deleted"), "diff_id", "file_idx", "tokens", budget)


def truncate_memory(rows: DataFrame, tokens: int) -> DataFrame:
    """Non-empty memory rows (key, pos, content), in order, within 4 characters a token; stops at the first overflow."""
    kept = rows.where("content <> ''").withColumn("_size", F.octet_length("content"))
    return prefix_within(kept, "key", "pos", "_size", 4 * tokens, at_least_one=False).drop("_size")


#: What a description's prompt writes before the first section.
DIFF_HEADER = "\n## Diff\n\n```diff\n"


def sections_within(sections: DataFrame, budget: int | Column, header: str = DIFF_HEADER) -> DataFrame:
    """Sections (diff_id, file_idx, text), in order, before the first whose own estimate and that of all text before it overflow the budget.

    The estimate of joined sections is no sum of estimates, but follows from running totals of their words. budget: a number, or an
    expression over the sections' columns; 0 or less is none.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    counts = token_counts(F.coalesce("text", F.lit("")))
    sized = sections.select("diff_id", "file_idx", limit.alias("_limit"), estimate_tokens(F.col("text")).alias("_own"), counts.alias("_c")).select("diff_id", "file_idx", "_limit", "_own", "_c.n", "_c.code")
    totals = running(sized, ["diff_id"], "file_idx", words=F.col("n"), codes=F.col("code"))
    head = token_counts(F.lit(header))
    spent = tokens_of(F.col("words") - F.col("n") + head["n"], F.col("codes") - F.col("code") + head["code"])
    stops = totals.where((F.col("_limit") > 0) & (spent + F.col("_own") > F.col("_limit"))).groupBy("diff_id").agg(F.min("file_idx").alias("_stop"))
    return sections.join(stops, "diff_id", "left").where("_stop is null or file_idx < _stop").select(*sections.columns)
