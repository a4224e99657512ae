"""Relations from git's output.

A request names a repository and what is asked of it: the diff of a range, its changed files, recent commits of a path, or the
authors of lines. `relation` answers a table of requests, each in some task; `GitSource` is the same as a data source with one
partition for each request, where filters on a request's fields keep other repositories untouched. A request that fails
gives a row with its error, so that one broken repository doesn't end a job. Repositories lie where all workers can read them.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..shipping import ship

#: A request; base and head for diff and files, path for commits and blame, first and last line for blame.
REQUEST = "repo string, what string, base string, head string, path string, first int, last int"
#: Its answer: place counts a request's rows from 1; text is the diff, a file, a commit or an author, n the lines of an author.
ANSWER = f"{REQUEST}, place int, text string, n bigint, error string"
_FIELDS = [f.split()[0] for f in REQUEST.split(", ")]

_REF = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_./~^@{}-]*")


def check_ref(ref: str) -> str:
    """A revision name that can't be taken for an option and doesn't climb."""
    if not _REF.fullmatch(ref) or ".." in ref:
        raise ValueError(f"not a revision: {ref!r}")
    return ref


def check_path(repo: str, path: str) -> str:
    """A path that stays inside the repository."""
    if not path or os.path.relpath(os.path.join(repo, path), repo).split(os.sep)[0] == "..":
        raise ValueError(f"not a path inside the repository: {path!r}")
    return path


def _git(repo: str, *args: str, timeout: int = 30) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=timeout, check=True, env={**os.environ, "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"})
    return done.stdout.decode(errors="replace")


def diff_range(repo: str, base: str, head: str) -> str:
    """The diff from the common ancestor of base and head to head, or between them where there is none."""
    base, head = check_ref(base), check_ref(head)
    try:
        return _git(repo, "diff", f"{base}...{head}")
    except subprocess.CalledProcessError:
        return _git(repo, "diff", base, head)


def changed_files(repo: str, base: str, head: str) -> list[str]:
    return [x for x in _git(repo, "diff", "--name-only", f"{check_ref(base)}...{check_ref(head)}").split("\n") if x]


def recent_commits(repo: str, path: str, n: int = 5) -> list[str]:
    return [x for x in _git(repo, "log", "--oneline", "-n", str(n), "--", check_path(repo, path)).split("\n") if x]


def blame_authors(repo: str, path: str, first: int, last: int) -> list[tuple[str, int]]:
    """Authors of a range of lines with their numbers of lines, most first."""
    counts: dict[str, int] = {}
    for line in _git(repo, "blame", "--line-porcelain", "-L", f"{first},{last}", "--", check_path(repo, path)).split("\n"):
        if line.startswith("author "):
            counts[line[7:]] = counts.get(line[7:], 0) + 1
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def _answer(request: tuple) -> Iterator[tuple]:
    """The rows of one request."""
    repo, what, base, head, path, first, last = request
    try:
        if what == "diff":
            rows = [(diff_range(repo, base, head), None)]
        elif what == "files":
            rows = [(x, None) for x in changed_files(repo, base, head)]
        elif what == "commits":
            rows = [(x, None) for x in recent_commits(repo, path)]
        elif what == "blame":
            rows = blame_authors(repo, path, first, last)
        else:
            raise ValueError(f"unknown request: {what!r}")
    except (OSError, TypeError, ValueError, subprocess.SubprocessError) as e:
        said = getattr(e, "stderr", None)
        yield *request, 0, None, None, said.decode(errors="replace").strip() if said else f"{type(e).__name__}: {e}"
        return
    yield from ((*request, k, text, n, None) for k, (text, n) in enumerate(rows, 1))


def relation(requests: DataFrame) -> DataFrame:
    """The answers (ANSWER) to a table of requests; columns that it lacks are null. Requests that repeat are answered once.

    An answer without rows, such as an empty range, gives none; a failure gives one row of place 0 with its error.
    """
    ship(requests.sparkSession)
    kind = _parse_datatype_string(ANSWER)
    types = dict(f.split() for f in REQUEST.split(", "))
    wanted = [(F.col(f) if f in requests.columns else F.lit(None)).cast(types[f]).alias(f) for f in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        for b in batches:
            for request in zip(*(c.to_pylist() for c in b.columns)):
                if rows := list(_answer(request)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return requests.select(*wanted).distinct().mapInArrow(run, kind)


class _Requested(InputPartition):
    def __init__(self, request: tuple):
        super().__init__(request)


class _Reader(DataSourceReader):
    def __init__(self, requests: list[tuple]):
        self.requests = requests

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on a request's fields choose the partitions; all else is left to Spark."""
        for f in filters:
            at = _FIELDS.index(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _FIELDS else None
            if at is None:
                yield f
            else:
                allowed = f.value if isinstance(f, In) else (f.value,)
                self.requests = [r for r in self.requests if r[at] is not None and r[at] in allowed]

    def partitions(self) -> list[InputPartition]:
        return [_Requested(r) for r in self.requests]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _answer(tuple(partition.value)) if partition is not None and partition.value else ()


class GitSource(DataSource):
    """spark.read.format("git").option("requests", json): requests as a JSON list of objects with the fields of REQUEST. Register it with `register`."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        asked = json.loads(self.options.get("requests", "[]"))
        return _Reader([tuple(r.get(f) for f in _FIELDS) for r in asked])


def register(spark) -> None:
    """Makes the format "git" known to a session, and lets its filters choose partitions."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)


def recent(commits: DataFrame, key: list[str], order: list[Column], n: int = 5) -> DataFrame:
    """The first n commits of each key, with their place from 1."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return commits.withColumn("place", place).where(F.col("place") <= n)


def context_text(commits: DataFrame, key: str) -> DataFrame:
    """(key, text): what a prompt says of recent commits (key, path, place, text), file by file in the order of their paths; keys without any are absent."""
    line = F.concat(F.lit("  - "), "text", F.lit("\n"))
    of_file = commits.where("text is not null").groupBy(key, "path").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    part = F.concat(F.lit("### "), "path", F.lit(" \u2014 Recent changes:\n"), F.array_join("lines.line", ""), F.lit("\n"))
    parts = of_file.select(key, F.struct("path", part.alias("part")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("parts"))
    return parts.select(key, F.concat(F.lit("\n## Git Context\n\n"), F.array_join("parts.part", "")).alias("text"))


def author_counts(lines: DataFrame) -> DataFrame:
    """(author, n) of the lines (line) of a blame in porcelain form."""
    authors = lines.where(F.startswith("line", F.lit("author "))).select(F.substring("line", F.lit(8), F.length("line")).alias("author"))
    return authors.groupBy("author").agg(F.count("*").alias("n"))
