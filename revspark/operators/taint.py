"""Data flow of user input: a line-by-line tracker, and reachability over call and use edges.

What the tracker does to its state in a line is a function from states to states, and so is what a chunk of lines does:
each name's source becomes that of the first of some names that has one, or a fixed one, or none. Such functions
compose. A file of more than one chunk is therefore tracked by a parallel prefix scan: chunks are summed up side by
side, the states at their starts follow from the summaries, and all chunks are then tracked side by side. Patterns run as
Spark expressions, once a line; what is folded is names only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.regex import java_pattern
from ..plans.fold import fold
from ..plans.store import stored
from ..schemas import SEVERITIES

# Sources, sinks (name, weakness, severity, type, fix, pattern) and sanitizers, in RE2 dialect.
PARAMETER = "function-parameter"
SOURCES = [
    (PARAMETER, r"func\s+\(?\s*\w+\s+\*?\w+\)?\s+\w+\(([^)]*)\)"),
    ("os.Args", r"os\.Args\["),
    ("os.Getenv", r"os\.Getenv\s*\("),
    ("request-body-read", r"(?:ioutil|io)\.ReadAll\s*\(\s*(?:r|req|request)\.Body"),
    ("http-form-value", r"(?:r|req|request)\.(?:FormValue|URL\.Query\(\)\.Get|PostFormValue|Header\.Get)\s*\("),
    ("stdin-read", r"(?:bufio\.NewScanner|fmt\.Scan|fmt\.Scanf|fmt\.Scanln|bufio\.NewReader\(os\.Stdin\))"),
    ("json-decode", r"json\.\w+Decoder.*\.Decode\s*\("),
    ("flag-arg", r"flag\.\w+\s*\("),
]
SINKS = [
    ("SQL query execution", "CWE-89", "critical", "SQL_INJECTION", "Use parameterized queries with db.Query(sql, args...) instead of string concatenation", r"(?:\.Query|\.QueryRow|\.Exec)\s*\("),
    ("command execution", "CWE-78", "critical", "COMMAND_INJECTION", "Validate and sanitize input before passing to exec.Command; use an allowlist of commands", r"exec\.Command\s*\("),
    ("file operation", "CWE-22", "high", "PATH_TRAVERSAL", "Use filepath.Clean() and validate the path is within the expected directory", r"os\.(?:Open|Create|ReadFile|WriteFile|Remove|MkdirAll)\s*\("),
    ("HTTP response write", "CWE-79", "high", "XSS", "Sanitize output before writing to HTTP response to prevent XSS", r"(?:w|rw|resp|response)\.(?:Write|WriteHeader)\s*\("),
    ("log output", "CWE-532", "medium", "LOG_LEAK", "Avoid logging sensitive user data; redact or mask before logging", r"(?:log\.|slog\.|logger\.|fmt\.Print)(?:Println|Printf|Info|Debug|Warn|Error|Fatal|Sprintf|Sprintln)"),
    ("template execution", "CWE-79", "high", "XSS", "Use html/template instead of text/template; sanitize user input before template rendering", r"\.Execute\s*\("),
]
SANITIZERS = [
    r"filepath\.Clean", r"url\.QueryEscape", r"html\.EscapeString", r"strconv\.Quote", r"regexp\.\w+\.ReplaceAll", r"strings\.Replace",
    r"template\.HTML", r"\.\s*Whitelist", r"\.\s*Sanitize", r"validate", r"int\s*\(",
]
SIGNATURE = r"func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)\s*\(([^)]*)\)"
ASSIGNMENT = r"^\s*(?:(?:var|const)\s+)?(\w+)\s*(?::=|=\s*)(.+)$"
# Types that stand alone in a parameter list.
BUILTIN_TYPES = [
    "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "complex64",
    "complex128", "bool", "string", "byte", "rune", "uintptr", "error", "any", "interface{}",
]
ONE_STEP = ["request-body-read", "http-form-value", "json-decode"]
DIRECT = [PARAMETER, "os.Args", "os.Getenv", "flag-arg", "stdin-read"]


def is_sanitized(text: Column) -> Column:
    return F.rlike(text, F.lit("|".join(java_pattern(p).removeprefix("(?d)") for p in SANITIZERS)))


def parameters(signature: Column) -> Column:
    """Parameter names of a function's first line; lone types don't count."""
    inside = F.regexp_extract(signature, java_pattern(SIGNATURE), 2)
    names = F.transform(F.split(inside, ","), lambda p: F.get(F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " "), F.lit(0)))
    return F.filter(names, lambda n: (n != "") & ~n.isin(BUILTIN_TYPES))


def sinks_of(text: Column) -> Column:
    """Names of the sinks that a line calls."""
    return F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(java_pattern(s[5]))), F.lit(s[0])) for s in SINKS)))


def source_of(text: Column) -> Column:
    """The first source that an expression reads, or null."""
    return F.coalesce(*(F.when(F.rlike(text, F.lit(java_pattern(p))), F.lit(name)) for name, p in SOURCES))


def confidence(source: Column, sanitizers: Column | None = None) -> Column:
    """0.8, less 0.1 for each sanitizer and 0.2 for sources that go through a step or aren't known; from 0 to 1."""
    steps = F.when(source.isin(DIRECT), 0).otherwise(1)
    value = F.lit(0.8).cast("double")
    if sanitizers is not None:
        value = value - F.lit(0.1).cast("double") * sanitizers
    return F.least(F.greatest(value - F.lit(0.2).cast("double") * steps, F.lit(0.0)), F.lit(1.0))


def message_parts(message: Column) -> Column:
    """source and sink named in a message `[X] type: source -> sink via variable`; unknown if they aren't."""
    rest = F.when(F.instr(message, "] ") > 0, F.substring(message, F.instr(message, "] ") + 2, F.length(message)))
    rest = F.when(F.instr(rest, ": ") > 0, F.substring(rest, F.instr(rest, ": ") + 2, F.length(rest))).otherwise(rest)
    source = F.when(F.instr(rest, " -> ") > 0, F.substring_index(rest, " -> ", 1))
    after = F.when(F.instr(message, " -> ") > 0, F.substring(message, F.instr(message, " -> ") + 4, F.length(message)))
    return F.struct(F.coalesce(source, F.lit("unknown")).alias("source"), F.coalesce(F.substring_index(after, " via variable", 1), F.lit("unknown")).alias("sink"))


#: Lines of a chunk, and chunks whose states one task works out from their summaries; beyond, groups of chunks are summed up first.
CHUNK_LINES, CHUNKS = 1024, 1024

State = dict[str, str]
#: What becomes of each name: the names whose first source it takes, and the source that it has if none of them has one.
Change = dict[str, tuple[tuple[str, ...], str | None]]

_CHANGE = "resets boolean, changes array<struct<name:string,of:array<string>,source:string>>"
_LINE = "diff_id bigint, file string, line int, variable string, source string, sink string, cwe string, severity int, sink_type string, message string, fix string"


def _judged(rows: DataFrame) -> DataFrame:
    """Lines that matter, with what the patterns say: params and entry of a signature; name, value, known and clean of an assignment; sinks that it may reach."""
    text = F.trim(F.regexp_replace(F.col("text"), r"\A\s+|\s+\z", ""))
    go = rows.where(F.endswith(F.lower("file"), F.lit(".go"))).select("diff_id", "file", "seq", "line", text.alias("text"), "added")
    starts = F.rlike("text", F.lit(java_pattern(SIGNATURE)))
    entry = F.coalesce(*(F.when(F.rlike("text", F.lit(java_pattern(p))), F.lit(name)) for name, p in reversed(SOURCES[1:])), F.lit(PARAMETER))
    assigns = ~starts & F.rlike("text", F.lit(java_pattern(ASSIGNMENT)))
    sinks = F.when(~starts & F.col("added") & ~is_sanitized(F.col("text")), sinks_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    go = go.withColumn("params", F.when(starts, parameters(F.col("text")))).withColumn("name", F.when(assigns, F.regexp_extract("text", java_pattern(ASSIGNMENT), 1)))
    go = go.withColumn("value", F.when(assigns, F.regexp_extract("text", java_pattern(ASSIGNMENT), 2))).withColumn("sinks", sinks)
    go = go.where(F.col("params").isNotNull() | F.col("name").isNotNull() | (F.size("sinks") > 0))
    return go.select("diff_id", "file", "seq", "line", "text", "params", F.when(F.col("params").isNotNull(), entry).alias("entry"), "name", "value", source_of(F.col("value")).alias("known"), is_sanitized(F.col("value")).alias("clean"), "sinks")


def _first(names: Iterable[str], of: Change, known: str | None = None) -> tuple[tuple[str, ...], str | None]:
    """The names and source that a choice among `names`, then `known`, comes to before the change `of`."""
    out: dict[str, None] = {}
    for n in names:
        inner, source = of.get(n, ((), None))
        out.update(dict.fromkeys(inner))
        if source is not None:
            return tuple(out), source
    return tuple(out), known


def _change(lines: Iterable[tuple], names: Iterable[str]) -> tuple[bool, Change]:
    """What lines (params, entry, name, value, known, clean) do to the sources of `names`, and whether they begin a function."""
    now: Change = {n: ((n,), None) for n in names}
    resets = False
    for params, entry, name, value, known, clean in lines:
        if params is not None:
            now, resets = {n: ((), entry) for n in params}, True
        elif name is not None:
            new = ((), None) if clean else ((), known) if known else _first([v for v in sorted(now) if v in value], now)
            now[name] = new
    return resets, now


def _then(first: tuple[bool, Change], second: tuple[bool, Change]) -> tuple[bool, Change]:
    """The second change after the first."""
    if second[0]:
        return second
    resets, before = first
    names = {v for of, _ in second[1].values() for v in of}
    known = before if resets else {n: ((n,), None) for n in names} | before
    return resets, before | {n: _first(of, known, source) for n, (of, source) in second[1].items()}


def _applied(change: tuple[bool, Change], state: State) -> State:
    resets, changes = change
    out = {} if resets else {n: s for n, s in state.items() if n not in changes}
    for n, (of, source) in changes.items():
        found = next((state[v] for v in of if v in state), source)
        if found is not None:
            out[n] = found
    return out


def _row(change: tuple[bool, Change]) -> tuple:
    resets, changes = change
    kept = {n: x for n, x in changes.items() if (x[1] is not None if resets else x != ((n,), None))}
    return resets, [{"name": n, "of": list(of), "source": source} for n, (of, source) in kept.items()]


def _read(resets: bool, changes: list[dict]) -> tuple[bool, Change]:
    return resets, {c["name"]: (tuple(c["of"]), c["source"]) for c in changes}


def _starts(changes: DataFrame, chunks: int) -> DataFrame:
    """(diff_id, file, chunk, state): the sources at the start of every chunk. changes: diff_id, file, chunk and the change of each.

    Files of more than `chunks` chunks are summed up by groups first, whose starts come from the same function.
    """
    state = "diff_id bigint, file string, chunk bigint, state map<string,string>"

    def follow(rows: Iterator[tuple]) -> Iterator[tuple]:
        now: State | None = None
        for diff, file, chunk, resets, change, given in rows:
            now = dict(given or []) if now is None else now
            yield diff, file, chunk, list(now.items())
            now = _applied(_read(resets, change), now)

    fields = ["diff_id", "file", "chunk", "resets", "changes"]
    group = F.floor(F.col("chunk") / chunks)
    if (changes.agg(F.max("chunk")).first()[0] or 0) < chunks:
        return fold(changes.select(*fields, F.lit(None).cast("map<string,string>").alias("state")), ["diff_id", "file"], ["chunk"], follow, state)

    def summed(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for diff, file, group, _, resets, change in rows:
            total = _read(resets, change) if total is None else _then(total, _read(resets, change))
        yield diff, file, group, *_row(total)

    grouped = changes.select("diff_id", "file", group.alias("group"), *fields[2:])
    whole = fold(grouped, ["diff_id", "file", "group"], ["chunk"], summed, f"diff_id bigint, file string, chunk bigint, {_CHANGE}")
    given = _starts(stored(whole, "taint-groups"), chunks).withColumnRenamed("chunk", "group")
    rows = grouped.join(given, ["diff_id", "file", "group"], "left")

    def inside(rows: Iterator[tuple]) -> Iterator[tuple]:
        return follow((diff, file, chunk, resets, change, given) for diff, file, _, chunk, resets, change, given in rows)

    return fold(rows.select("diff_id", "file", "group", *fields[2:], "state"), ["diff_id", "file", "group"], ["chunk"], inside, state)


def _states(rows: DataFrame, chunks: int) -> DataFrame:
    """(diff_id, file, chunk, state) for the chunks of files that have several."""
    keys = ["diff_id", "file"]
    names = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("params").isNotNull(), F.col("params")).otherwise(F.array_compact(F.array("name"))))))
    per = rows.groupBy(*keys, "chunk").agg(names.alias("names"), F.bool_or(F.col("params").isNotNull()).alias("begins"))
    # A name can only have a source at a chunk's start if it occurs since the last chunk that begins a function.
    order = W.partitionBy(*keys).orderBy("chunk")
    spans = per.withColumn("_after", F.sum(F.col("begins").cast("int")).over(order)).withColumn("_before", F.col("_after") - F.col("begins").cast("int"))
    spans = stored(spans.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n > 1"), "taint-chunks")
    alive = spans.groupBy(*keys, F.col("_after").alias("_before")).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("alive"))
    heads = spans.join(alive, [*keys, "_before"], "left").select(*keys, "chunk", F.lit(-1).cast("long").alias("seq"), "alive")

    def summed(lines: Iterator[tuple]) -> Iterator[tuple]:
        head = next(lines)
        yield *head[:3], *_row(_change((x[5:] for x in lines), head[4] or []))

    fields = ["params", "entry", "name", "value", "known", "clean"]
    lines = rows.join(spans.select(*keys, "chunk"), [*keys, "chunk"], "left_semi").select(*keys, "chunk", "seq", F.lit(None).cast("array<string>").alias("alive"), *fields)
    both = heads.unionByName(lines, allowMissingColumns=True).select(*keys, "chunk", "seq", "alive", *fields)
    changes = fold(both, [*keys, "chunk"], ["seq"], summed, f"diff_id bigint, file string, chunk bigint, {_CHANGE}")
    return _starts(stored(changes, "taint-changes"), chunks)


def track(rows: DataFrame, chunk_lines: int = CHUNK_LINES, chunks: int = CHUNKS) -> DataFrame:
    """(diff_id, file, line, variable, source, sink, cwe, severity, sink_type, message, fix) of input that reaches a sink.

    rows: new-side lines (diff_id, seq, file, line, text, added), seq from 0 or 1 in order within a diff; only Go files are read. Names match as parts of
    a line. The state begins anew at every function signature. Every tainted name in an added line with a sink and without sanitizer gives a
    finding for each sink. Where several tainted names could explain an assignment the least counts. The result doesn't depend on
    chunk_lines and chunks, which bound what one task follows in order.
    """
    # Stored, as it is read once for whether files have several chunks and once to be followed: the patterns run once.
    judged = stored(_judged(rows).withColumn("chunk", F.floor(F.col("seq") / chunk_lines)), "taint-lines")
    about = {s[0]: s for s in SINKS}

    def follow(lines: Iterator[tuple]) -> Iterator[tuple]:
        tainted: State = {}
        for diff, file, _, _, line, text, params, entry, name, value, known, clean, sinks, state in lines:
            if state is not None:
                tainted = dict(state)
            elif params is not None:
                tainted = dict.fromkeys(params, entry)
            elif name is not None:
                found = None if clean else known or next((tainted[v] for v in sorted(tainted) if v in value), None)
                if found:
                    tainted[name] = found
                else:
                    tainted.pop(name, None)
            for sink in sinks or ():
                s = about[sink]
                for v in sorted(tainted):
                    if v in text:
                        yield diff, file, line, v, tainted[v], s[0], s[1], SEVERITIES.index(s[2]), s[3], f"Tainted data from {tainted[v]} flows to {s[0]} without sanitization", s[4]

    fields = ["diff_id", "file", "chunk", "seq", "line", "text", "params", "entry", "name", "value", "known", "clean", "sinks"]
    # Only what stands before a chunk's last sink can matter to a finding in it.
    last = F.max(F.when(F.size("sinks") > 0, F.col("seq"))).over(W.partitionBy("diff_id", "file", "chunk"))
    lines = judged.withColumn("_last", last).where("seq <= _last").select(*fields, F.lit(None).cast("map<string,string>").alias("state"))
    if not judged.where("chunk > 0").isEmpty():
        sinks = judged.where(F.size("sinks") > 0).select("diff_id", "file", "chunk").distinct()
        starts = _states(judged, chunks).join(sinks, ["diff_id", "file", "chunk"], "left_semi").withColumn("seq", F.lit(-1).cast("long"))
        lines = lines.unionByName(starts, allowMissingColumns=True)
    return fold(lines, ["diff_id", "file", "chunk"], ["seq"], follow, _LINE)


def reach(seeds: DataFrame, edges: DataFrame, keep, max_rounds: int = 100) -> DataFrame:
    """(node, source) of all nodes reachable from seeds (node, source) over edges (src, dst, kind); sanitizer edges stop.

    Each round follows only what the last one found. Of several sources the least is kept. `keep` stores an
    intermediate table and returns it, which cuts the lineage.
    """
    open_edges = edges.where("kind not in ('sanitizer', 'sink')").select("src", "dst")
    reached = keep(seeds.groupBy("node").agg(F.min("source").alias("source")))
    fresh = reached
    for _ in range(max_rounds):
        step = fresh.join(open_edges, fresh["node"] == open_edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("source").alias("source"))
        old = reached.select("node", F.col("source").alias("_old"))
        fresh = keep(step.join(old, "node", "left").where("_old is null or source < _old").select("node", "source"))
        if fresh.isEmpty():
            return reached
        reached = keep(reached.unionByName(fresh).groupBy("node").agg(F.min("source").alias("source")))
    raise RuntimeError("reachability did not settle; raise max_rounds")


def sink_findings(reached: DataFrame, edges: DataFrame, values: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, line, kind, source): one per place and sink kind that tainted values reach, in order, at most `limit`.

    edges into sinks carry sink_kind; values: (value_id, pos_file, pos_line) places the sinks.
    """
    hits = edges.where("kind = 'sink'").join(reached, F.col("src") == F.col("node")).join(values, F.col("dst") == F.col("value_id"))
    found = hits.groupBy(F.col("pos_file").alias("file"), F.col("pos_line").alias("line"), F.col("sink_kind").alias("kind")).agg(F.min("source").alias("source"))
    found = found.orderBy("file", "line", "kind")
    return found.limit(limit) if limit else found


def any_sink(text: Column) -> Column:
    return reduce(or_, (F.rlike(text, F.lit(java_pattern(s[5]))) for s in SINKS))


def flows(names: Column, text: Column) -> Column:
    """(variable, sink) for every name that a line holds and every sink it calls, none if it is sanitized."""
    pairs = let(sinks_of(text), lambda s: F.flatten(F.transform(F.filter(names, lambda n: F.contains(text, n)), lambda n: F.transform(s, lambda k: F.struct(n.alias("variable"), k.alias("sink"))))))
    return F.when(is_sanitized(text), F.array().cast("array<struct<variable:string,sink:string>>")).otherwise(pairs)
