"""The review of a corpus of diffs as one plan."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, findings, prompts, responses, rules, taint
from .answers import Provider, answered
from .store import stored



def echo_provider(system: str, prompt: str) -> str:
    """A deterministic stand-in: reports every new line that holds TODO."""
    out, file, line = [], "", 0
    for row in prompt.split("\n"):
        if row.startswith("## "):
            file = row[3:]
        elif row.startswith("@@ new "):
            line = int(row[7:])
        elif row.startswith("+") and "TODO" in row:
            out.append({"file": file, "line": line, "severity": "low", "message": "open task: " + row[1:], "confidence": 0.9})
    return json.dumps(out)


def ask(requests: DataFrame, provider: Provider, parallel: int | None = None) -> DataFrame:
    """requests (system_prompt, prompt, ...) with the answer of the provider, which must be picklable, as content; a failure is an empty answer.

    parallel bounds concurrent calls by the number of partitions.
    """

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for systems, texts in batches:
            out = []
            for s, t in zip(systems, texts):
                try:
                    out.append(provider(s, t))
                except Exception:  # one failing call must not fail the corpus
                    out.append("")
            yield pd.Series(out)

    rows = requests.repartition(parallel) if parallel else requests
    return rows.withColumn("content", call("system_prompt", "prompt"))


@dataclass
class Review:
    """Parse, exclude, scan, ask, merge, rank. Every step is keyed by diff_id."""

    provider: Provider | None = None
    concerns: list[str] = field(default_factory=lambda: ["security"])
    exclude: list[str] = field(default_factory=lambda: list(rules.DEFAULT_EXCLUDE))
    static: bool = True
    data_flow: bool = True
    #: Folder of the table of answers; with it, what was asked once isn't asked again.
    answers: str | None = None
    #: Whether the provider is asked a second time about all findings, and the score that they need then.
    second_opinion: bool = False
    min_score: int = 0

    def ask(self, requests: DataFrame) -> DataFrame:
        """requests (system_prompt, prompt, ...) with content; empty where the provider failed."""
        if self.answers is None:
            return ask(requests, self.provider)
        return answered(requests, self.provider, self.answers).withColumn("content", F.coalesce("content", F.lit(""))).drop("error")

    def reflect(self, found: DataFrame, diffs: DataFrame) -> DataFrame:
        """Findings after the provider's second opinion; those of diffs without a readable one stay as they are."""
        said = self.ask(prompts.reflect_prompt(found, diffs)).select("diff_id", F.posexplode(responses.reflections(F.col("content"))).alias("pos", "r"))
        return findings.reflect(found, said.select("diff_id", "pos", "r.index", "r.action", "r.severity", "r.score", "r.message"), self.min_score)

    def run(self, diffs: DataFrame) -> DataFrame:
        """Findings of all diffs with rank, exact repeats removed; with second_opinion, those that it leaves."""
        spark = diffs.sparkSession
        diffs = stored(diffs.select("diff_id", "raw"), "review-diffs")  # read by each of the parts
        new = stored(diff.new_side(diffs).where(~rules.excluded(F.col("file"), self.exclude)), "review-lines")
        parts = []
        if self.static:
            lines = new.where("added").withColumn("language", rules.detect_language(F.col("file")))
            parts.append(rules.findings_of(rules.scan(lines)))
        if self.data_flow:
            t = taint.track(new)
            names = F.concat(F.lit("[TAINT] "), "sink_type", F.lit(": "), "source", F.lit(" -> "), "sink", F.lit(" via variable "), "variable")
            seq = F.xxhash64("file", "line", "variable", "sink")
            parts.append(t.select("diff_id", seq.alias("seq"), F.lit("security").alias("concern"), "severity", "file", "line", F.lit(0).alias("end_line"), names.alias("message"), "fix", F.lit("").alias("reasoning"), "cwe", taint.confidence(F.col("source")).alias("confidence"), F.lit(True).alias("sast_source")))
        if self.provider:
            hunks = diff.hunks(diffs).where(~rules.excluded(F.col("path"), self.exclude))
            asked = prompts.build(hunks)
            topics = prompts.concerns(spark, self.concerns).select(F.col("name").alias("concern"), "system_prompt")
            topics = [(r["concern"], r["system_prompt"]) for r in topics.collect()]  # a handful by definition
            requests = asked.withColumn("t", F.explode(F.array(*(F.struct(F.lit(c).alias("concern"), F.lit(s).alias("system_prompt")) for c, s in topics)))).select("diff_id", "t.concern", "t.system_prompt", "prompt")
            got = responses.findings(self.ask(requests))
            parts.append(got.select("diff_id", F.col("pos").cast("long").alias("seq"), "concern", "severity", "file", "line", "end_line", "message", "fix", "reasoning", "cwe", "confidence", F.lit(False).alias("sast_source")))
        found = findings.exact_dedup(findings.union(*parts))
        if self.provider and self.second_opinion:
            found = self.reflect(stored(found, "review-findings"), diffs)
        return findings.ranked(found)

    def stats(self, found: DataFrame) -> DataFrame:
        """(diff_id, total, max_severity, failed, avg_confidence, high, low) of diffs with findings."""
        total = found.groupBy("diff_id").agg(F.count("*").alias("total"))
        return total.join(findings.failed(found, 4), "diff_id").join(findings.confidence_stats(found), "diff_id")

    def evaluate(self, cases: DataFrame) -> DataFrame:
        """(case_id, passed) of cases (case_id, diff, expect_findings, deny_findings)."""
        found = stored(self.run(cases.select(F.col("case_id").alias("diff_id"), F.col("diff").alias("raw"))), "eval-findings")
        expected = cases.select("case_id", F.posexplode("expect_findings").alias("exp_id", "e"))
        expected = expected.select("case_id", "exp_id", *(F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("concern", "min_severity", "message_contains", "file")))
        denied = cases.select("case_id", F.posexplode("deny_findings").alias("exp_id", "e"))
        denied = denied.select("case_id", "exp_id", *(F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("concern", "message_contains")), F.lit("").alias("min_severity"), F.lit("").alias("file"))
        missed = findings.expectations_met(expected, found).where("not met").select("case_id")
        hit = findings.expectations_met(denied, found).where("met").select("case_id")
        bad = missed.union(hit).distinct().withColumn("_bad", F.lit(True))
        return cases.select("case_id").join(bad, "case_id", "left").select("case_id", F.col("_bad").isNull().alias("passed"))
