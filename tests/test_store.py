"""Durable intermediates."""

from pyspark.sql import functions as F

from revspark.plans.store import BROADCAST_BYTES, release, stored


def joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_large_tables_are_not_broadcast(spark):
    """Files of a stored table may be a small part of its rows: by their size alone these would go through the driver."""
    left = spark.range(10).select("id", F.lit(1).alias("x"))
    large = stored(spark.range(400_000).select("id", F.xxhash64("id").alias("h"), F.repeat(F.lit("w"), 400).alias("text")), "test-large")
    small = stored(spark.range(100), "test-small")
    for got in (large, large.where("h is not null").groupBy("id").agg(F.max("text").alias("text"))):
        other = got.withColumn("y", F.length("text"))
        assert "SortMergeJoin" in joins(large.join(other, "id")) and "Broadcast" not in joins(large.join(other, "id"))
    assert "BroadcastHashJoin" in joins(large.groupBy("id").count().join(F.broadcast(left), "id"))
    assert "BroadcastHashJoin" in joins(spark.range(10**9).join(small, "id"))
    assert large.select("_metadata.row_index").count() == 400_000
    assert large.join(left, "id").count() == 10 and BROADCAST_BYTES < 10 << 20
    release(large, small)
