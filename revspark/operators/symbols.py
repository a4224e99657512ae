"""Symbols of source files by line patterns, with their extent and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from ..functions.regex import java_pattern
from ..functions.text import leading_spaces

# Symbol patterns by file ending, first match first, as (pattern, kind).
PATTERNS = {
    ".go": [
        (r"^func\s+\(\s*\w+\s+\*?(\w+)\)\s+(\w+)\s*\(", "method"),
        (r"^func\s+(\w+)\s*\(", "function"),
        (r"^type\s+(\w+)\s+struct\b", "type"),
        (r"^type\s+(\w+)\s+interface\b", "type"),
        (r"^type\s+(\w+)\s+", "type"),
        (r"^var\s+(\w+)\s", "var"),
        (r"^const\s+(\w+)\s", "const"),
    ],
    ".py": [
        (r"^class\s+(\w+)", "class"),
        (r"^async\s+def\s+(\w+)", "function"),
        (r"^\s{4}async\s+def\s+(\w+)", "method"),
        (r"^def\s+(\w+)", "function"),
        (r"^\s{4}def\s+(\w+)", "method"),
    ],
    ".ts": [
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?interface\s+(\w+)", "type"),
        (r"^(?:export\s+)?type\s+(\w+)\s*=", "type"),
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(", "function"),
        (r"^(?:export\s+)?const\s+(\w+)", "const"),
    ],
    ".tsx": [
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?interface\s+(\w+)", "type"),
        (r"^(?:export\s+)?type\s+(\w+)\s*=", "type"),
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(", "function"),
        (r"^(?:export\s+)?const\s+(\w+)", "const"),
    ],
    ".js": [
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(", "function"),
        (r"^(?:export\s+)?const\s+(\w+)", "const"),
    ],
    ".jsx": [
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(", "function"),
        (r"^(?:export\s+)?const\s+(\w+)", "const"),
    ],
    ".rs": [
        (r"^(?:pub(?:\([^)]*\))?\s+)?fn\s+(\w+)", "function"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "type"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "type"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "type"),
        (r"^impl(?:<[^>]*>)?\s+(\w+)", "type"),
    ],
    ".java": [
        (r"^(?:public|private|protected)?\s*(?:static\s+)?class\s+(\w+)", "class"),
        (r"^(?:public|private|protected)?\s*interface\s+(\w+)", "type"),
        (r"^\s+(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\(", "method"),
    ],
}


def symbol_of(line: Column, ending: str) -> Column:
    """(symbol, kind) of a line by the first pattern that it matches, or null; methods are named Receiver.method."""
    out = F.lit(None).cast("struct<symbol:string,kind:string>")

    def of(trimmed: Column) -> Column:
        found = out
        for pattern, kind in reversed(PATTERNS[ending]):
            p = java_pattern(pattern)
            name = F.regexp_extract(trimmed, p, 1)
            if kind == "method" and ending == ".go":
                name = F.concat_ws(".", name, F.regexp_extract(trimmed, p, 2))
            found = F.when(F.rlike(trimmed, F.lit(p)), F.struct(name.alias("symbol"), F.lit(kind).alias("kind"))).otherwise(found)
        return found

    # Bound, as every pattern reads it and expressions inside a lambda are worked out anew for each use.
    return let(F.trim(F.regexp_replace(line, r"\A\s+|\s+\z", "")), of)


def _braces(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit("{"), F.lit("")))) - (F.length(line) - F.length(F.replace(line, F.lit("}"), F.lit(""))))


def _end(lines: Column, depth: Column, at: Column) -> Column:
    """Last line, from 1, of the symbol at place `at`, from 0. depth: running sums of opened less closed braces."""
    first = F.get(lines, at)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    before = F.coalesce(F.get(depth, at - 1), F.lit(0))
    indented = ~F.contains(first, F.lit("{")) & F.endswith(F.trim(F.regexp_replace(first, r"\s+\z", "")), F.lit(":"))

    def level(i: Column) -> Column:
        return F.get(depth, i) - before

    def first_of(found: Column) -> Column:
        return F.get(found, F.lit(0))

    dedent = first_of(F.filter(places, lambda i: (i > at) & (F.trim(F.get(lines, i)) != "") & (leading_spaces(F.get(lines, i)) <= leading_spaces(first))))
    opens = F.when(~F.contains(first, F.lit("{")) & (level(at) <= 0), F.coalesce(first_of(F.filter(places, lambda i: (i > at) & (i < at + 5) & (level(i) > 0))), at)).otherwise(at)
    # Without an opening brace the lines looked ahead at count twice, as the scan begins anew.
    closed = let(opens, lambda o: first_of(F.filter(places, lambda i: (i > o) & (level(i) + F.when((o == at) & ~F.contains(first, F.lit("{")) & (level(at) <= 0), F.get(depth, F.least(at + 4, F.size(lines) - 1)) - F.get(depth, at)).otherwise(0) <= 0))))
    return F.coalesce(F.when(indented, dedent).otherwise(closed + 1), F.size(lines)).cast("int")


def search(sources: DataFrame, ending: str, name: str = "", kind: str = "") -> DataFrame:
    """(path, symbol, kind, start_line, end_line, body) of symbols whose name holds `name`, of the given kind or any.

    sources: (path, content) of files with one ending. A line counts by its first matching pattern alone.
    """

    def rows(lines: Column) -> Column:
        def found(depth: Column) -> Column:
            def row(x: Column, i: Column) -> Column:
                return F.struct(symbol_of(x, ending).alias("s"), (i + 1).alias("start"), i.alias("at"))

            hits = F.filter(F.transform(lines, row), lambda r: r["s"].isNotNull() & F.contains(F.lower(r["s"]["symbol"]), F.lit(name.lower())) & (F.lit(kind.lower() or None).isNull() | (r["s"]["kind"] == F.lit(kind.lower()))))
            return F.transform(hits, lambda r: F.struct(r["s"]["symbol"].alias("symbol"), r["s"]["kind"].alias("kind"), r["start"].alias("start_line"), _end(lines, depth, r["at"]).alias("end_line")))

        return let(running_sums(F.transform(lines, lambda x: _braces(x).cast("long"))), found)

    lines = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\n\z", ""), "\n", -1)
    got = sources.select("path", lines.alias("_lines"), F.explode(let(lines, rows)).alias("s"))
    body = F.array_join(F.slice("_lines", F.col("s.start_line"), F.greatest(F.lit(0), F.col("s.end_line") - F.col("s.start_line") + 1)), "\n")
    return got.select("path", "s.*", body.alias("body"))


def body(sources: DataFrame, ending: str, name: str) -> DataFrame:
    """The first symbol of each file named `name`, in full or after a dot, else the first whose name holds it."""
    found = search(sources, ending, name)
    low = F.lower("symbol")
    rank = F.when((low == name.lower()) | F.endswith(low, F.lit("." + name.lower())), 0).otherwise(1)
    return found.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(rank, "start_line"))).where("_n = 1").drop("_n")
