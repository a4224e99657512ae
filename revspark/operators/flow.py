"""Data flow across functions, over relations of calls, parameters, returned values and uses.

A call passes its arguments into the callee's parameters and the callee's returned values out to its own result, and to
no other call's: what enters at one call site must not leave at another. Summary edges make that a plain reachability:
for every parameter the values of its function that it reaches are found, and where one of them is returned, each call's argument is
joined with that call's result. Path edges and summaries are found together, each round from what the last one added.
From sources, flow then follows uses and summaries, goes out of functions as long as it hasn't entered one, and into callees.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import release, stored
from ..schemas import SEVERITIES

# Names of callees by what they do with a tainted argument, and of sources.
SANITIZERS = ["path/filepath.Clean", "net/url.QueryEscape", "net/url.PathEscape", "html.EscapeString", "html/template.HTMLEscapeString", "strconv.Quote", "strconv.Atoi", "strconv.ParseInt"]
PASS_THROUGH = ["fmt.Sprintf", "fmt.Sprint", "fmt.Sprintln", "strings.Join", "strings.TrimSpace", "strings.ToLower", "strings.ToUpper", "strings.ReplaceAll", "strings.TrimPrefix", "strings.TrimSuffix"]
SQL_METHODS = [").Query", ").QueryRow", ").QueryContext", ").QueryRowContext", ").Exec", ").ExecContext"]
FILE_CALLS = ["os.Open", "os.Create", "os.ReadFile", "os.WriteFile", "os.OpenFile", "os.Remove", "os.MkdirAll"]
REQUEST_CALLS = ["net/http.Request).FormValue", "net/http.Request).PostFormValue", "net/http.Request).Query", "net/http.Header).Get"]
REQUEST_TYPE = "net/http.Request"
#: kind, name, weakness, severity, fix
SINKS = [
    ("SQL_INJECTION", "SQL query execution", "CWE-89", "critical", "Use parameterized queries (db.Query(sql, args...)) instead of string concatenation"),
    ("COMMAND_INJECTION", "command execution", "CWE-78", "critical", "Avoid passing untrusted input to exec.Command; use an allowlist"),
    ("PATH_TRAVERSAL", "file operation", "CWE-22", "high", "Use filepath.Clean and confirm the path stays within an allowed root"),
    ("XSS", "template execution", "CWE-79", "high", "Use html/template for HTML output to auto-escape untrusted data"),
    ("XSS", "HTTP response write", "CWE-79", "high", "Escape untrusted data before writing it to an HTTP response"),
]
# Instructions that pass what flows into them on to their result.
PASSING = ["BinOp", "Phi", "UnOp", "Convert", "ChangeType", "ChangeInterface", "MakeInterface", "Slice", "Field", "FieldAddr", "Index", "IndexAddr", "Extract", "TypeAssert"]

#: Edges for which one more bucket is made, up to the number of shuffle partitions, and those that a bucket holds at most.
_FEW, _MANY = 500_000, 2_000_000

Keep = Callable[[DataFrame], DataFrame]


def _ends(name: Column, endings: list[str]) -> Column:
    # One pattern: a condition for each ending would work the name out anew, in a method too large to be compiled.
    return F.rlike(name, F.lit(f"(?:{'|'.join(map(re.escape, endings))})\\z"))


def _holds(name: Column, parts: list[str]) -> Column:
    return F.rlike(name, F.lit("|".join(map(re.escape, parts))))


def source_callee(name: Column) -> Column:
    """The description of a source that a call of this name reads, or null."""
    flag = F.startswith(name, F.lit("flag.")) & (name != "flag.Parse")
    out = F.when(F.endswith(name, F.lit("os.Getenv")), "os.Getenv").when(_holds(name, REQUEST_CALLS), "HTTP request input")
    return out.when(F.contains(name, F.lit("net/url.Values).Get")), "URL query value").when(flag, "command-line flag")


def sink_callee(name: Column) -> Column:
    """The place in SINKS of what a call of this name does, or null."""
    response = F.contains(name, F.lit("net/http.ResponseWriter")) & F.contains(name, F.lit("Write"))
    out = F.when(F.contains(name, F.lit("database/sql")) & _holds(name, SQL_METHODS), 0).when(F.contains(name, F.lit("os/exec.Command")), 1)
    return out.when(_ends(name, FILE_CALLS), 2).when(F.contains(name, F.lit("text/template.Template).Execute")), 3).when(response, 4)


def seeds(calls: DataFrame, params: DataFrame) -> DataFrame:
    """(node, source): parameters that carry a request, and results of calls that read a source."""
    asked = params.where(F.contains("type", F.lit(REQUEST_TYPE))).select(F.col("value").alias("node"), F.lit("http.Request parameter").alias("source"))
    read = calls.select(F.col("result").alias("node"), source_callee(F.col("callee")).alias("source")).where("node is not null and source is not null")
    return asked.unionByName(read).groupBy("node").agg(F.min("source").alias("source"))


def use_edges(uses: DataFrame) -> DataFrame:
    """Edges of uses (op, src, dst, base): passing instructions go to their result, a Store to its address (dst) and the aggregate around it (base)."""
    passing = uses.where(F.col("op").isin(PASSING)).select("src", "dst")
    stores = uses.where("op = 'Store'").select("src", F.explode(F.array("dst", "base")).alias("dst")).where("dst is not null")
    return passing.unionByName(stores).select("src", "dst", F.lit("flow").alias("kind"), F.lit(None).cast("long").alias("site"))


def call_edges(calls: DataFrame, params: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, site) of calls: arg into a known callee's parameter, return out to the result, flow through string helpers.

    calls: site, callee, index, arg, result (null where there is none); params: callee, index, value; returns: callee, value. Sanitizers
    and sinks pass nothing on; a value that is passed twice enters at its first place. Without `returns` flow only descends.
    """
    # Parameters and returned values grow with the program: they are never broadcast, at any size.
    name = F.col("callee")
    live = calls.where(~_ends(name, SANITIZERS) & sink_callee(name).isNull())
    through = _ends(name, PASS_THROUGH) & F.col("result").isNotNull()
    flow = live.where(through).select(F.col("arg").alias("src"), F.col("result").alias("dst"), F.lit("flow").alias("kind"), "site")
    first = live.where(~through).groupBy("site", "callee", "arg", "result").agg(F.min("index").alias("index"))
    entered = first.join(params.select("callee", "index", F.col("value").alias("dst")).hint("merge"), ["callee", "index"])
    out = flow.unionByName(entered.select(F.col("arg").alias("src"), "dst", F.lit("arg").alias("kind"), "site"))
    if returns is not None:
        known = live.where(~through & F.col("result").isNotNull()).select("callee", "site", "result").distinct().join(returns.select("callee", F.col("value").alias("src")).hint("merge"), "callee")
        out = out.unionByName(known.select("src", F.col("result").alias("dst"), F.lit("return").alias("kind"), "site"))
    return out


def _buckets(edges: DataFrame) -> int:
    """Buckets for tables of edges and values: as many as shuffles have partitions, fewer for few edges, more where a bucket would be large."""
    rows = edges.count()
    return max(rows // _MANY, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // _FEW)) + 1


def _dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The rows, each once, in n buckets by columns: joins on these leave them where they are, whatever joins them."""
    return stored(rows.repartition(n, *by).distinct(), "flow-buckets", bucket=(n, *by))


class _Grown:
    """A table that every round adds rows to: a large part in buckets by `by`, and a recent one that is merged into it when it has a quarter of its rows.

    So a round neither moves nor writes what rounds before it found. Rows of equal `keys` are one, with the least of their other columns.
    """

    def __init__(self, rows: DataFrame, n: int, keep: Keep, keys: list[str], by: list[str]):
        self.n, self.keep, self.keys, self.by = n, keep, keys, by
        self.others = [c for c in rows.columns if c not in keys]
        self.base, self.recent = self._deal(rows), None
        self.rows = self.base.count()

    def _merge(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.min(c).alias(c) for c in self.others)) if self.others else rows.distinct()

    def _deal(self, rows: DataFrame) -> DataFrame:
        return stored(self._merge(rows.repartition(self.n, *self.by)), "flow-buckets", bucket=(self.n, *self.by))

    def parts(self) -> list[DataFrame]:
        return [self.base] if self.recent is None else [self.base, self.recent]

    def all(self) -> DataFrame:
        return self.base if self.recent is None else self._merge(self.base.unionByName(self.recent))

    def add(self, rows: DataFrame) -> None:
        """Adds rows of a stored table."""
        before = self.parts()
        recent = rows if self.recent is None else self.keep(self._merge(self.recent.unionByName(rows)))
        if recent.count() * 4 > self.rows:
            self.base, self.recent = self._deal(self.base.unionByName(recent)), None
            self.rows = self.base.count()
            release(*before)
        else:
            self.recent = recent
            release(*before[1:])

    def beside(self, rows: DataFrame) -> DataFrame:
        """Rows with the other columns that the table has for their keys, as _0_<column> and _1_<column> of the two parts, and _0 and _1, which are null without such a row."""
        for k, part in enumerate(self.parts()):
            old = part.select(*self.keys, *(F.col(c).alias(f"_{k}_{c}") for c in self.others), F.lit(True).alias(f"_{k}"))
            rows = rows.hint("shuffle_hash").join(old, self.keys, "left")
        return rows


def _along(rows: DataFrame, at: str, edges: DataFrame) -> DataFrame:
    """Rows with `dst` (and all else) of the edges that begin at their value `at`. The edges stay in their buckets; the rows are what is moved and hashed."""
    return rows.hint("shuffle_hash").join(edges.withColumnRenamed("src", at), at)


def _summaries(flow: DataFrame, entries: DataFrame, exits: DataFrame, n: int, keep: Keep) -> _Grown:
    """(src, dst): arguments and results of calls whose callee passes the one on to the other, from edges in buckets."""
    entered = entries.select("site", F.col("dst").alias("entry"), F.col("src").alias("_in"))

    def across(paths: DataFrame) -> DataFrame:
        """Arguments and results that paths from parameters to returned values connect at one site."""
        left = _along(paths, "at", exits).withColumnRenamed("dst", "_out")
        return left.hint("shuffle_hash").join(entered, ["site", "entry"]).select(F.col("_in").alias("src"), F.col("_out").alias("dst")).distinct()

    paths = _Grown(entries.select(F.col("dst").alias("entry"), F.col("dst").alias("at")), n, keep, ["entry", "at"], ["entry", "at"])
    fresh, added = paths.base, keep(across(paths.base))
    found = _Grown(added, n, keep, ["src", "dst"], ["src"])
    while True:
        steps = [_along(fresh, "at", e).select("entry", F.col("dst").alias("at")) for e in (flow, *found.parts())]
        if not added.isEmpty():
            steps += [p.join(added, F.col("at") == F.col("src")).select("entry", F.col("dst").alias("at")) for p in paths.parts()]
        step = reduce(DataFrame.unionByName, steps).repartition(n, "entry", "at").distinct()
        fresh = keep(reduce(lambda d, k: d.where(f"_{k} is null"), range(len(paths.parts())), paths.beside(step)).select("entry", "at"))
        if fresh.isEmpty():
            return found
        paths.add(fresh)
        added = keep(across(fresh))
        if not added.isEmpty():
            found.add(added)


def reach(seeds: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """(node, source) of all values that seeds (node, source) reach on paths whose returns match their calls; of several sources the least.

    edges: src, dst, kind (flow, arg, return), site. Every round follows what the last one found; `keep` stores a table and returns it, which
    cuts the lineage. Edges and what has been reached lie in buckets, so that a round moves only what the last one found.
    """
    n = _buckets(edges)
    flow = _dealt(edges.where("kind = 'flow'").select("src", "dst"), n, "src")
    entries = _dealt(edges.where("kind = 'arg'").select("site", "dst", "src"), n, "site", "dst")
    exits = _dealt(edges.where("kind = 'return'").select("src", "site", "dst"), n, "src")
    through = _summaries(flow, entries, exits, n, keep)
    into = _dealt(entries.select("src", "dst"), n, "src")
    # Of a value, `outside` is the least source on a path that has entered no function, `least` that on any path. The former may be followed
    # wherever the latter may, so that one row of a value says all.
    reached = _Grown(seeds.select("node", F.col("source").alias("outside"), F.col("source").alias("least")), n, keep, ["node"], ["node"])
    fresh = reached.base
    while not fresh.isEmpty():
        steps = [_along(fresh, "node", e).select("dst", "outside", "least") for e in (flow, *through.parts())]
        steps.append(_along(fresh.where("least is not null"), "node", into).select("dst", F.lit(None).cast("string").alias("outside"), "least"))
        steps.append(_along(fresh.where("outside is not null"), "node", exits).select("dst", "outside", F.col("outside").alias("least")))
        step = reduce(DataFrame.unionByName, steps).withColumnRenamed("dst", "node").repartition(n, "node").groupBy("node").agg(F.min("outside").alias("outside"), F.min("least").alias("least"))
        parts = range(len(reached.parts()))

        def better(c: str) -> Column:
            """The source if none as little is known of the value."""
            return F.when(reduce(lambda x, k: x & (F.col(f"_{k}_{c}").isNull() | (F.col(c) < F.col(f"_{k}_{c}"))), parts, F.col(c).isNotNull()), F.col(c)).alias(c)

        fresh = keep(reached.beside(step).select("node", better("outside"), better("least")).where("outside is not null or least is not null"))
        reached.add(fresh)
    return reached.all().select("node", F.least("outside", "least").alias("source"))


def findings(reached: DataFrame, calls: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, line, kind, source, severity, cwe, message, fix): one for each place and kind of sink that a reached value is passed to; at most `limit`, in order."""
    sinks = calls.withColumn("_sink", sink_callee(F.col("callee"))).where(F.col("_sink").isNotNull() & ~_ends(F.col("callee"), SANITIZERS))
    known = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(c).alias("cwe"), F.lit(SEVERITIES.index(s)).alias("severity"), F.lit(f).alias("fix")) for k, n, c, s, f in SINKS))
    hits = sinks.join(reached, F.col("arg") == F.col("node")).select("file", "line", F.get(known, F.col("_sink")).alias("s"), "source")
    best = hits.groupBy("file", "line", F.col("s.kind").alias("kind")).agg(F.min(F.struct("source", "s")).alias("b"))
    message = F.concat(F.lit("[SSA-TAINT-"), "kind", F.lit("] untrusted data from "), "b.source", F.lit(" reaches "), "b.s.name", F.lit(" across function boundaries without sanitization"))
    out = best.select("file", "line", "kind", "b.source", "b.s.severity", "b.s.cwe", message.alias("message"), "b.s.fix").orderBy("file", "line", "kind")
    return out.limit(limit) if limit else out
