"""Queries over the tables, one per operator, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.synthetic import FINDINGS, LINES, NEW_START, OLD_START, PATH

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Views that oracles may name: lines of the diffs with numbers, findings, and lines of the documents.
_VIEWS = {
    "l": f"""SELECT *, {PATH} AS path, {OLD_START} AS old_start, {NEW_START} AS new_start,
      count(*) FILTER (WHERE mark <> '-') OVER (PARTITION BY diff_id, hunk ORDER BY n) AS rel_new,
      count(*) FILTER (WHERE mark <> '+') OVER (PARTITION BY diff_id, hunk ORDER BY n) AS rel_old FROM ({LINES}) x""",
    "f": FINDINGS,
    "dl": """SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents""",
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query. Views that its SQL names as {l}, {f} or {dl} become sub-queries."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            text = sql
            for k, view in _VIEWS.items():
                text = text.replace("{" + k + "}", f"({view})")
            SQL[name] = text
        return fn

    return register


def tokens_sql(n: str, code: str) -> str:
    """Tokens of n > 0 words of which `code` look like code."""
    return f"CAST(greatest(1, floor(({n}) * CASE WHEN CAST(({code}) AS DOUBLE) / ({n}) > CAST(0.3 AS DOUBLE) THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.3 AS DOUBLE) END + CAST(0.5 AS DOUBLE))) AS BIGINT)"


def estimated(rows: str) -> str:
    """A query that adds n, code and tokens, the estimate of its column text, to another one."""
    upper, lower, digit = (f"regexp_matches(x, '\\p{{{k}}}')" for k in ("Lu", "Ll", "Nd"))
    return f"""SELECT * EXCLUDE (w, sym), CASE WHEN n = 0 THEN (strlen(text) + 3) // 4 ELSE {tokens_sql('n', 'code')} END AS tokens FROM (
      SELECT *, len(w) + sym AS n, len(list_filter(w, lambda x : ({upper} AND {lower} AND regexp_matches(x, '^(?s:.)(?s:.*)\\p{{Lu}}')) OR contains(x, '_') OR ({digit} AND ({upper} OR {lower})))) + sym AS code
      FROM (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}_$]+') AS w, length(regexp_replace(text, '[\\p{{L}}\\p{{Nd}}_$\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', '', 'g')) AS sym FROM ({rows}) r0) r1) r2"""


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


from . import diffs, findings, llm_answers, scans, texts  # noqa: E402,F401
