"""Answers of a language model as relations: JSON where it parses, patterns where it doesn't."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import parse_severity

MAX_FIELD = 2000
ITEM = "struct<file:string,line:int,end_line:int,severity:string,message:string,fix:string,reasoning:string,cwe:string,confidence:double>"


def strip_fences(text: Column) -> Column:
    """What stands between the first code fence and the next, if there is one."""
    t = F.trim(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
    tagged = F.regexp_extract(t, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(t, r"(?s)```(?:[^\n]*\n)?(.*?)(?:```|\z)", 1)
    inner = F.when(F.contains(t, F.lit("```json")), tagged).when(F.contains(t, F.lit("```")), plain).otherwise(t)
    return F.regexp_replace(inner, r"\A\s+|\s+\z", "")


def json_array(text: Column) -> Column:
    """From the first [ to the last ], fences removed; empty without them."""
    return F.regexp_extract(strip_fences(text), r"(?s)\[.*\]", 0)


def json_object(text: Column) -> Column:
    return F.regexp_extract(strip_fences(text), r"(?s)\{.*\}", 0)


def _repair(text: str) -> str:
    """Drops comment lines and trailing commas, escapes line ends inside strings."""
    rows = [r for r in text.split("\n") if not r.strip().startswith("//")]
    out, inside, escaped = [], False, False
    for c in "\n".join(rows):
        if inside and not escaped and c == "\n":
            out.append("\\n")
            continue
        if c == '"' and not escaped:
            inside = not inside
        escaped = inside and c == "\\" and not escaped
        out.append(c)
    return re.sub(r",(\s*[\]}])", r"\1", "".join(out))


def lenient_json(text: Column) -> Column:
    """Repaired JSON; a Pandas UDF, as strings must be followed character by character."""

    @F.pandas_udf("string")
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else _repair(t))

    return repaired(text)


def _strict(text: Column) -> Column:
    """Items of a JSON array, null if it isn't one."""
    return F.from_json(text, f"array<{ITEM}>", {"mode": "PERMISSIVE"})


def regex_items(text: Column) -> Column:
    """Items read by patterns from every pair of braces that names file and message."""

    def one(block: Column) -> Column:
        def field(name: str) -> Column:
            return F.regexp_extract(block, rf'"{name}"\s*:\s*"([^"]*)"', 1)

        def number(name: str, digits: str) -> Column:
            return F.regexp_extract(block, rf'"{name}"\s*:\s*({digits})', 1)

        text = number("confidence", r"[0-9]+(?:\.[0-9]+)?")
        value = F.when(text != "", text.cast("double"))
        return F.struct(
            F.left(field("file"), F.lit(MAX_FIELD)).alias("file"), F.coalesce(F.when(number("line", r"\d{1,9}") != "", number("line", r"\d{1,9}").cast("int")), F.lit(0)).alias("line"),
            F.lit(0).alias("end_line"), field("severity").alias("severity"), F.left(field("message"), F.lit(MAX_FIELD)).alias("message"), F.left(field("fix"), F.lit(MAX_FIELD)).alias("fix"),
            F.left(field("reasoning"), F.lit(MAX_FIELD)).alias("reasoning"), field("cwe").alias("cwe"), value.alias("confidence"),
        )

    blocks = F.regexp_extract_all(text, F.lit(r"\{[^{}]+\}"), F.lit(0))
    return F.transform(F.filter(blocks, lambda b: F.rlike(b, F.lit(r'"file"\s*:\s*"[^"]*"')) & F.rlike(b, F.lit(r'"message"\s*:\s*"[^"]*"'))), one)


def findings(responses: DataFrame, repair: bool = True) -> DataFrame:
    """(diff_id, concern, pos, file, line, ..., confidence) of responses (diff_id, concern, content).

    A response is read as strict JSON, then as repaired JSON, then by patterns. Items without file or message are
    dropped; confidences outside (0, 1] become 0.6.
    """
    rows = responses.withColumn("_a", json_array(F.col("content"))).withColumn("_strict", F.when(F.col("_a") != "", _strict(F.col("_a"))))
    second = _strict(lenient_json(F.when(F.col("_strict").isNull(), F.col("_a")))) if repair else F.lit(None).cast(f"array<{ITEM}>")
    rows = rows.withColumn("_second", second)
    items = F.coalesce("_strict", "_second", regex_items(F.col("content")).cast(f"array<{ITEM}>"))
    got = rows.select("diff_id", "concern", F.posexplode(items).alias("pos", "i"))
    got = got.where("coalesce(i.message, '') <> '' and coalesce(i.file, '') <> ''")
    conf = F.when((F.col("i.confidence") > 0) & (F.col("i.confidence") <= 1), F.col("i.confidence")).otherwise(F.lit(0.6).cast("double"))
    text = [F.coalesce(f"i.{c}", F.lit("")).alias(c) for c in ("fix", "reasoning", "cwe")]
    return got.select(
        "diff_id", "concern", "pos", "i.file", F.coalesce("i.line", F.lit(0)).alias("line"), F.coalesce("i.end_line", F.lit(0)).alias("end_line"),
        parse_severity(F.coalesce("i.severity", F.lit(""))).alias("severity"), "i.message", *text, conf.alias("confidence"),
    )


def filter_verdict(content: Column) -> Column:
    """confirmed, confidence and reasoning of an answer with CONFIRMED:, CONFIDENCE:, REASONING:.

    A finding is confirmed unless the answer says `confirmed: no` or `false positive`; confidence is 0.7 unless a
    number from 0 to 1 is given.
    """
    low = F.lower(content)
    value = F.regexp_extract(low, r"(?s)\A.*?confidence:\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)", 1)
    number = F.when(value != "", value.cast("double"))
    reason = F.regexp_extract(content, r"(?is)\A.*?reasoning:\s*([^\n]*)", 1)
    return F.struct(
        (~(F.contains(low, F.lit("confirmed: no")) | F.contains(low, F.lit("false positive")))).alias("confirmed"),
        F.when(number <= 1, number).otherwise(F.lit(0.7)).alias("confidence"),
        F.regexp_replace(reason, r"\s+\z", "").alias("reasoning"),
    )


def reflections(content: Column) -> Column:
    """Second opinions (index, action, severity, score, message, reason) of an answer; null if it isn't a JSON array."""
    return F.from_json(json_array(content), "array<struct<index:int,action:string,severity:string,score:int,message:string,reason:string>>")


def eval_suite(text: Column) -> Column:
    """Cases (name, diff, expect_findings, deny_findings) of a suite's JSON."""
    expectation = "struct<concern:string,min_severity:string,message_contains:string,file:string>"
    return F.from_json(text, f"struct<name:string,cases:array<struct<name:string,diff:string,expect_findings:array<{expectation}>,deny_findings:array<struct<message_contains:string,concern:string>>>>>")["cases"]


def to_items(values: list[dict]) -> str:
    """A response as a model would give it; for tests and fakes."""
    return "```json\n" + json.dumps(values) + "\n```"
