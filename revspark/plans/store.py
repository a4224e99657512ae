"""Durable intermediates of iterative plans."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_made: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of files up to which a stored table may be broadcast. Spark takes the size of compressed files for that of their rows, which may be
#: a hundred times larger and go through the driver's memory; a table beyond is joined by shuffles.
BROADCAST_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session has none (tests, a laptop) a folder under its warehouse is used; on a cluster
    that might be the driver's own disk, so that the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return found.rstrip("/")


def stored(df: DataFrame, what: str, by: str | None = None, bucket: tuple | None = None, group_rows: int | None = None) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it again.

    by: a column whose values make parts that can be deleted one by one. bucket: number of buckets and the columns whose
    hash deals rows to them, so that a join on those columns leaves them where they are. group_rows: rows that a reader holds at once, for rows of
    megabytes. This cuts lineage, survives lost executors, and unlike an RDD checkpoint computes the
    rows once and stays columnar and compressed. Shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        writer = writer.partitionBy(by) if by else writer
        writer = writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer
        if bucket:
            _tables[path] = f"stored_{path.rsplit('-', 1)[1]}"
            writer.bucketBy(*bucket).saveAsTable(_tables[path], format="parquet", path=path)
        else:
            writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.table(_tables[path]) if bucket else spark.read.schema(df.schema).parquet(path)
    if not bucket and _bytes(spark, path) > BROADCAST_BYTES:
        out = out.hint("merge")
    out._stored_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of `stored` that nothing will read again; others and None are passed over."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path in _made:
            _delete(_made.pop(path), path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder that a query made for itself."""
    _delete(spark, path)


def release_part(table: DataFrame, part: str) -> None:
    """Deletes one part, `column=value`, of a table stored in parts; what is still read of it must leave that part out."""
    path = getattr(table, "_stored_at", None)
    if path in _made:
        _delete(_made[path], f"{path}/{part}")
        if path in _tables:
            _made[path].catalog.refreshTable(_tables[path])


def _place(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system and path of a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _bytes(spark: SparkSession, path: str) -> int:
    files, where = _place(spark, path)
    return files.getContentSummary(where).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    files, where = _place(spark, path)
    files.delete(where, True)


@atexit.register
def _remove() -> None:
    """Deletes this application's intermediates while its session is still alive."""
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone; the folder is the cluster's scratch space
            return
