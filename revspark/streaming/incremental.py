"""Incremental review: a stream of diffs with the checkpoint as cursor.

A batch is committed only after its findings are written; a failing batch is seen again. The
written table is keyed by batch, so that a repeated batch replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Reviewer = Callable[[DataFrame], DataFrame]


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    """(diff_id, raw) of files that appear in a folder, one diff each; the id is a hash of the path."""
    rows = spark.readStream.format("text").option("wholetext", True).load(folder)
    return rows.select(F.xxhash64("_metadata.file_path").alias("diff_id"), F.col("value").alias("raw"))


def review(stream: DataFrame, reviewer: Reviewer, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the review of a stream into Parquet folders out/batch=<n>. once: what is there, then stop."""

    def write(batch: DataFrame, n: int) -> None:
        reviewer(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """All findings so far, of each diff those of the last batch that saw it."""
    from pyspark.sql import Window as W

    rows = spark.read.parquet(out)
    return rows.withColumn("_last", F.max("batch").over(W.partitionBy("diff_id"))).where("batch = _last").drop("_last", "batch")


def cursors(spark: SparkSession, out: str, key: str) -> DataFrame:
    """(key, cursor, seen) over all batches so far: the last time and the number of rows of each key."""
    return spark.read.parquet(out).groupBy(key).agg(F.max("cursor").alias("cursor"), F.sum("seen").alias("seen"))
