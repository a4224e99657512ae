"""Answers of a model as a durable table, keyed by what was asked.

A request is known by the digest of its prompts. Only requests without an answer are sent, each once however many rows ask the
same; what comes back is appended to the table before it is used, wave by wave, so that a run that was stopped or lost its
executors goes on from the last wave, and a second run asks nothing again. Failures are told apart: those that may pass are
tried again, in the task and in later runs; a refusal is final and kept as such. A call whose task is lost before its wave was written
is the only one that can be made twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import digest
from ..shipping import ship
from .store import release, stored

#: error: what was said last; final: whether it is of no use to ask again. Both null and false for an answer.
ANSWERS = "digest string, content string, error string, final boolean, attempts int, at timestamp"
#: Requests of a wave.
WAVE = 10_000
#: Errors that may pass; all others are final.
PASSING = (TimeoutError, ConnectionError, InterruptedError)

Provider = Callable[[str, str], str]


def known(spark: SparkSession, folder: str) -> DataFrame:
    """The table so far, one row a digest: its answer, else its last error."""
    try:
        rows = spark.read.schema(ANSWERS).parquet(folder)
    except AnalysisException:  # nothing has been asked yet
        return spark.createDataFrame([], ANSWERS)
    best = F.row_number().over(W.partitionBy("digest").orderBy(F.isnull("content"), F.desc("final"), F.desc("at")))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def _send(requests: DataFrame, provider: Provider, tries: int, pause: float, passing: tuple[type[BaseException], ...]) -> DataFrame:
    """ANSWERS of requests (digest, system_prompt, prompt); a passing error is tried again after a pause that doubles."""
    ship(requests.sparkSession)

    def one(system: str, prompt: str) -> tuple:
        for k in range(tries):
            try:
                return provider(system, prompt), None, False, k + 1
            except passing as e:
                error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
            except Exception as e:  # one failing call must not fail the corpus
                return None, f"{type(e).__name__}: {e}", True, k + 1
        return None, error, False, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, system, prompt in zip(*(c.to_pylist() for c in b.columns)):
                content, error, final, attempts = one(system or "", prompt or "")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.string()), pa.array([error], pa.string()), pa.array([final]), pa.array([attempts], pa.int32())], ["digest", "content", "error", "final", "attempts"])

    return requests.mapInArrow(run, "digest string, content string, error string, final boolean, attempts int").withColumn("at", F.current_timestamp())


def answered(requests: DataFrame, provider: Provider, folder: str, tries: int = 3, pause: float = 0.5, wave: int = WAVE, parallel: int | None = None, passing: tuple[type[BaseException], ...] = PASSING) -> DataFrame:
    """requests (system_prompt, prompt, ...) with content and error, from the table in `folder`, after asking what it lacks.

    Null prompts count as empty. parallel bounds concurrent calls. A request without an answer has its last error; no requests give no calls.
    """
    spark = requests.sparkSession
    key = digest(F.coalesce("system_prompt", F.lit("")), F.coalesce("prompt", F.lit("")))
    asked = requests.withColumn("_digest", key)
    have = known(spark, folder).where("content is not null or final").select(F.col("digest").alias("_digest"))
    first = asked.select("_digest", "system_prompt", "prompt").dropDuplicates(["_digest"]).join(have, "_digest", "left_anti")
    todo = stored(first.withColumnRenamed("_digest", "digest"), "answers-asked")
    total = todo.count()
    waves = -(-total // wave)
    for k in range(waves):
        part = todo.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == k)
        part = part.repartition(parallel) if parallel else part
        _send(part, provider, tries, pause, passing).write.mode("append").parquet(folder)
    release(todo)
    now = known(spark, folder).select(F.col("digest").alias("_digest"), "content", "error")
    return asked.join(now, "_digest", "left").drop("_digest")
