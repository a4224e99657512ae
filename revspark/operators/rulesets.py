"""Line scans by rules that are rows of a table, thousands of them.

Most patterns can only match where one of a few literal strings stands. These strings, taken from all patterns, make one Aho-Corasick
automaton, which finds in one pass over a line the rules that could match it; only those run as regular expressions, joined as rows. So the cost of a
line depends on its length and on what it holds, not on the number of rules; patterns without such a string run on every line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.regex import java_pattern
from ..rules_catalog import Rule
from ..schemas import SEVERITIES
from ..shipping import ship
from .rules import confidence

#: Characters that a string must have to be worth looking for, and rules that a table may have: it is read whole by every task.
SHORTEST, MOST_RULES = 3, 200_000

RULE = "rule_no int, rule_id string, rule_language string, severity int, category string, cwe string, message string, fix string, confidence double, pattern string, antipattern string"


def _needed(parts) -> set[str] | None:
    """Strings one of which every match of a parsed pattern holds, as long as can be; None: no such strings."""
    options: list[set[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            options.append({run})
        run = ""

    for op, arg in parts:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        end()
        inner = None
        if op is K.SUBPATTERN:
            inner = _needed(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _needed(arg[2])
        elif op is K.BRANCH:
            each = [_needed(b) for b in arg[1]]
            inner = set().union(*each) if all(each) else None
        if inner:
            options.append(inner)
    end()
    return max(options, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def needed(pattern: str) -> set[str] | None:
    """Strings one of which every match of a pattern holds; None if there are none or the pattern can't be read."""
    try:
        return _needed(_parser.parse(pattern))
    except (re.error, OverflowError):
        return None


def required(pattern: str) -> list[str] | None:
    """Case-folded strings one of which stands, case-folded, in every text that a pattern matches; None if there are none of SHORTEST characters or the pattern can't be read."""
    found = needed(pattern)
    folded = {s.casefold() for s in found or ()}
    return sorted(folded) if folded and min(map(len, folded)) >= SHORTEST else None


def as_rows(spark, rules: list[Rule]) -> DataFrame:
    """Rules as a table (RULE)."""
    rows = [(k, r.rule_id, r.language, SEVERITIES.index(r.severity), r.category, r.cwe, r.message, r.fix, confidence(r), r.pattern, r.antipattern) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


_automata: dict[tuple, object] = {}


def _automaton(words: tuple[tuple[str, tuple[int, ...]], ...]):
    """One automaton for each process and set of words."""
    import ahocorasick

    if words not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for word, rules in words:
            a.add_word(word, rules)
        a.make_automaton()
        _automata[words] = a
    return _automata[words]


def candidates(rows: DataFrame, patterns: dict[int, str], text: str = "text") -> DataFrame:
    """rows with rule_nos, those of the patterns (by number) that could match their text; none for null texts."""
    of: dict[str, list[int]] = {}
    always: list[int] = []
    for no, pattern in patterns.items():
        for word in (found := required(pattern)) or ():
            of.setdefault(word, []).append(no)
        if found is None:
            always.append(no)
    words = tuple((w, tuple(n)) for w, n in sorted(of.items()))
    ship(rows.sparkSession)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(words).iter if words else lambda _: ()
        for b in batches:
            nos = [None if t is None else sorted({n for _, found in find(t.casefold()) for n in found}.union(always)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nos, pa.list_(pa.int32()))], [*b.schema.names, "rule_nos"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("rule_nos", ArrayType(IntegerType())))


def scan(rows: DataFrame, rules: DataFrame, language: str | None = None, text: str = "text") -> DataFrame:
    """rows joined with the rules (RULE) that their text matches, one row each.

    language: only rules of it and of any language; None: each row's `language` column decides. The table of rules is
    bounded by MOST_RULES, so that it is read whole and broadcast. No rows or no rules give none.
    """
    wanted = rules if language is None else rules.where(F.lower("rule_language").isin(language.lower(), "any"))
    known = wanted.limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    # The pattern in Java's dialect, an antipattern that is missing as one that matches nothing.
    java = [(*r, java_pattern(r["pattern"]), "(?!)" if r["antipattern"] is None else java_pattern(r["antipattern"])) for r in known]
    table = rows.sparkSession.createDataFrame(java, StructType(list(wanted.schema.fields)).add("_java", "string").add("_not", "string"))
    found = candidates(rows, {r["rule_no"]: r["pattern"] for r in known}, text)
    hits = found.withColumn("rule_no", F.explode("rule_nos")).drop("rule_nos").join(F.broadcast(table), "rule_no")
    if language is None:
        hits = hits.where((F.col("rule_language") == "any") | (F.col("rule_language") == F.col("language")))
    return hits.where(F.rlike(text, F.col("_java")) & ~F.rlike(text, F.col("_not"))).drop("_java", "_not")
