"""What several operators share: table access, durable intermediates, connected components."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import release, release_part, stored
from ..shipping import ship

__all__ = ["components", "fold", "mapped", "merged", "release", "release_part", "ship", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; `sf_dir` may be any URI that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def fold(doc_id: int, n: int) -> int:
    """crc32 of the id as text, modulo n; equals SQL crc32(cast(doc_id as string)) % n."""
    return zlib.crc32(str(doc_id).encode()) % n


def components(edges: DataFrame, what: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star.

    edges: columns u, v (long). Returns (node, root): root is the smallest node of the
    component; nodes without any edge are absent. Every round is two aggregations joined
    back to the edges; the neighbours of a node are never gathered in one task, and the
    aggregated side of each join has one row per key and is written first, so that a hub's rows may be split.
    Rounds end as soon as the edges are stars: those that are from the start need none.
    """
    used: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        used.append(stored(df, f"{what}-least"))
        return used[-1]

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
        least = kept(down.groupBy("u").agg(F.min("v").alias("m")))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def stars(e: DataFrame) -> bool:
        """Whether every node has one smaller neighbour, which has none itself, or none."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("hub")).union(e.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("hub").alias("hub")).where("n > 1 or (n = 1 and hub = 1)")
        return open_.agg(F.count("*")).first()[0] == 0

    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), what)
    for _ in range(max_rounds):
        if stars(now):
            break
        last, now = now, stored(small(large(now)), what)
        release(last, *used)
        used.clear()
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(comp: DataFrame | None, edges: DataFrame, what: str = "cc") -> DataFrame:
    """Components (node, root), stored, of what `comp` joins, as `components` returns it, and of further edges (u, v).

    Only groups that a new edge joins are worked on; without any, comp itself is returned.
    """
    if comp is None:
        return stored(components(edges, what), f"{what}-roots")
    u, v = (comp.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")) for side in "uv")
    roots = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v")
    roots = stored(roots, f"{what}-joined")
    if roots.isEmpty():
        release(roots)
        return comp
    top = stored(components(roots, what), f"{what}-top")
    over = top.select(F.col("node").alias("root"), F.col("root").alias("_over"))
    moved = comp.join(over, "root", "left").select("node", F.coalesce("_over", "root").alias("root"))
    return stored(moved.unionByName(top.join(comp.select("node"), "node", "left_anti")), f"{what}-roots")
