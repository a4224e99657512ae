"""Configuration, checks, rules and suites from files."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_NAMES = [".revspark.toml", "revspark.toml", ".revspark.json"]
MAX_CONFIG_BYTES = 1 << 20


@dataclass
class Config:
    concerns: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    fail_on: str = ""
    max_tokens: int = 0
    options: dict = field(default_factory=dict)


def load_config(start: str) -> Config:
    """The first configuration file in `start` or a folder above it; defaults without one. Files over 1 MiB are refused."""
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        for name in CONFIG_NAMES:
            p = folder / name
            if p.is_file():
                if p.stat().st_size > MAX_CONFIG_BYTES:
                    raise ValueError(f"{p} is too large")
                found = tomllib.loads(p.read_text())
                known = {k: found.pop(k) for k in ("concerns", "exclude", "fail_on", "max_tokens") if k in found}
                return Config(**known, options=found)
    return Config()


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, severity, languages, enabled, body) of Markdown checks with front matter; those switched off are left out."""
    rows = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)

    def key(name: str) -> Column:
        return F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))

    languages = F.filter(F.transform(F.split(F.regexp_replace(key("languages"), r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    got = rows.select("path", F.when(key("severity") == "", "medium").otherwise(F.lower(key("severity"))).alias("severity"), languages.alias("languages"), (F.lower(key("enabled")) != "false").alias("enabled"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?|\A\s+|\s+\z", "").alias("body"))
    return got.where("enabled")


def project_rules(spark: SparkSession, globs: list[str]) -> str:
    """The texts of all files that the globs match, in the order of globs, then names."""
    parts = []
    for g in globs:
        rows = spark.read.text(g, wholetext=True).select(F.input_file_name().alias("p"), "value").orderBy("p").collect()  # a project's own rule files
        parts += [r["value"].strip() for r in rows]
    return "\n\n".join(parts)


def eval_suite(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, name, diff, expect_findings, deny_findings) of a suite file."""
    from ..operators.responses import eval_suite as cases

    rows = spark.read.text(path, wholetext=True).select(F.posexplode(cases(F.col("value"))).alias("case_id", "c"))
    return rows.select(F.col("case_id").cast("long").alias("case_id"), "c.*")


def clean_path(path: Column) -> Column:
    """The shortest path with the same meaning: no doubled slashes, no . and no .. that can be resolved."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(out: Column, p: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        drop = (p == "..") & (F.size(out) > 0) & (last != "..")
        return F.when(drop, F.slice(out, F.lit(1), F.size(out) - 1)).when((p == "..") & rooted & (F.size(out) == 0), out).otherwise(F.concat(out, F.array(p)))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), kept)).when(kept == "", F.lit(".")).otherwise(kept)


def safe_url(url: str) -> bool:
    """Whether a URL is plain http or https and doesn't name this machine or a private network."""
    m = re.fullmatch(r"https?://(\[[0-9a-fA-F:]+\]|[^/:?#@]+)(?::\d+)?(?:[/?#].*)?", url)
    if not m:
        return False
    host = m[1].lower()
    return not (host in ("localhost", "0.0.0.0", "[::1]") or re.match(r"127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.", host))
