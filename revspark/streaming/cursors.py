"""Cursors of an incremental review as keyed state of the stream.

A request asks for a review of a key (a repository, a branch) up to `head`. It starts from the key's cursor, or from its own
base where there is none yet. The review is written first, then its outcome; outcomes come back as a second stream, and a good one moves
the cursor to its head. So a cursor never stands beyond what has been written, stays where it is when a review fails, and
a batch that is seen again starts from the same cursors. A request that comes before the outcome of the one
before it starts further back than it might, never too far ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..plans.store import release, stored
from ..shipping import ship
from ..sources import git

REQUEST = "key string, seq bigint, base string, head string"
OUTCOME = "key string, seq bigint, head string, ok boolean"
UNCHANGED = "No new changes since last review."

Reviewer = Callable[[DataFrame], DataFrame]


class Cursor(StatefulProcessor):
    """The number and head of a key's last good review."""

    def init(self, handle) -> None:
        self.cursor = handle.getValueState("cursor", "seq bigint, head string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, now = [], self.cursor.get() if self.cursor.exists() else None
        was = now
        for r in rows:
            if r["ok"] is None:
                asked.append(r)
            elif r["ok"] and (now is None or r["seq"] >= now[0]):
                now = (r["seq"], r["head"])
        if now is not None and now != was:
            self.cursor.update(now)
        for r in sorted(asked, key=lambda r: r["seq"]):
            yield Row(key=key[0], seq=r["seq"], base=now[1] if now else r["base"], head=r["head"])

    def close(self) -> None:
        pass


def resolved(requests: DataFrame | None, outcomes: DataFrame | None) -> DataFrame:
    """The requests (REQUEST) with the base that their key's cursor gives; outcomes (OUTCOME) of a batch count before its requests."""
    rows = []
    if requests is not None:
        rows.append(requests.select("key", "seq", "base", "head", F.lit(None).cast("boolean").alias("ok")))
    if outcomes is not None:
        rows.append(outcomes.where("ok is not null").select("key", "seq", F.lit(None).cast("string").alias("base"), "head", "ok"))
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    spark = both.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return both.groupBy("key").transformWithState(Cursor(), REQUEST, "append", "none")


def follow(requests: DataFrame, reviewer: Reviewer, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the review of a stream of requests into out/reviews/batch=<n>.

    reviewer: requests with their bases to rows (key, seq, ok, ...). A request is good if it has rows and all are ok; one without rows failed. once: what is there, then stop.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], OUTCOME).write.mode("ignore").parquet(f"{out}/outcomes/batch=-1")
    outcomes = spark.readStream.schema(OUTCOME).option("recursiveFileLookup", True).parquet(f"{out}/outcomes")

    def write(batch: DataFrame, n: int) -> None:
        asked = stored(batch, "cursor-requests")
        if not asked.isEmpty():
            reviewer(asked).write.mode("overwrite").parquet(f"{out}/reviews/batch={n}")
            done = spark.read.parquet(f"{out}/reviews/batch={n}").groupBy("key", "seq").agg(F.bool_and("ok").alias("ok"))
            good = asked.join(done, ["key", "seq"], "left").select("key", "seq", "head", F.coalesce("ok", F.lit(False)).alias("ok"))
            good.write.mode("overwrite").parquet(f"{out}/outcomes/batch={n}")
        release(asked)

    query = resolved(requests, outcomes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def known(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, seq, head): the cursors of a stream, read from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "cursor").load()
    return state.select("key.key", "value.seq", "value.head")


def ranges(judge: Reviewer) -> Reviewer:
    """A reviewer of git ranges: keys are repositories. judge: (key, seq, diff_id, raw) of diffs to (key, seq, ok, report).

    A range without changes is good as it is; one that git can't give has failed with git's words as report.
    """

    def review(asked: DataFrame) -> DataFrame:
        wanted = asked.select(F.col("key").alias("repo"), F.lit("diff").alias("what"), "base", "head").distinct()
        answers = git.relation(wanted).select(F.col("repo").alias("key"), "base", "head", F.col("text").alias("raw"), "error")
        same = (F.col("a.key") == F.col("d.key")) & F.col("a.base").eqNullSafe(F.col("d.base")) & F.col("a.head").eqNullSafe(F.col("d.head"))
        got = stored(asked.alias("a").join(answers.alias("d"), same, "left").select("a.key", "a.seq", "a.head", "raw", "error"), "cursor-diffs")
        blank = F.trim(F.regexp_replace("raw", r"\s+", " ")) == ""
        failed = got.where("raw is null").select("key", "seq", F.lit(False).alias("ok"), F.col("error").alias("report"))
        unchanged = got.where(blank).select("key", "seq", F.lit(True).alias("ok"), F.lit(UNCHANGED).alias("report"))
        changed = got.where(~blank).select("key", "seq", F.xxhash64("key", "seq", "head").alias("diff_id"), "raw")
        return judge(changed).select("key", "seq", "ok", "report").unionByName(unchanged).unionByName(failed)

    return review
