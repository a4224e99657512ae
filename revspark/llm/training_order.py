"""Training order: every sequence gets a global slot; slots are written as fixed-stride shards.

Sequences are numbered in the order of (doc_id, text, piece), which the content alone decides, so that a key gives the
same order however the table is laid out. A keyed Feistel network over the least even number of bits that
holds all N numbers, walked on until it lands below N, is a bijection of 0..N-1 that needs no
state. A shard is a range of slots, and a file a range of shards: records have equal length, so that slot s of any run
is found by arithmetic and reading can resume anywhere.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, release, ship, stored
from .textvec import mix
from .tokens import encoder, vocabulary_path

LENGTH, SHARD_SLOTS, END, PAD = 512, 4096, 2, 0
#: Shards of one file, about 128 MB.
FILE_SHARDS = 32
#: Shards that a task writes or reads at once, about 16 MB.
GROUP_SHARDS = 4
#: Of each record: doc_id int64, piece int32, number of ids int32; then `length` ids of 16 bits (32 if the vocabulary is larger), padded.
HEADER = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n", "<i4")])


class Permutation:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: int, rounds: int = 8):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (right << half) | left  # the halves swap once more, so that the reversed keys invert

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), keys)
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = self._network(out[outside], keys)
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def _kind(id_bytes: int) -> str:
    return f"<u{id_bytes}"


def token_sequences(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, n, ids): each document's ids and `end`, cut into pieces of up to `length` ids of 16 bits, or 32 if the vocabulary needs them.

    Rows come in the order of docs.
    """
    path = path or vocabulary_path()
    size, tried = encoder(path).id_bytes, encoder(path).fast is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, tried).ids
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = np.append(ids_of(text.as_py() or ""), np.uint32(end)).astype(_kind(size)).tobytes()
                    for k, s in enumerate(range(0, len(raw), size * length)):
                        piece = raw[s : s + size * length]
                        for c, v in zip(out, (doc, k, len(piece) // size, piece)):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "n", "ids"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, piece int, n int, ids binary")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of (doc_id, hash of the text), sorted within.

    The row's own number takes part in the ranges, so that rows that repeat one document are dealt to several; being equal
    in all that counts, they may stand in any order. Null ids come first.
    """
    keys = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    rows = docs.select("doc_id", "text", keys[1].alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    return rows.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")


def numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """Adds `number`, dense from 0, to a stored Parquet table: rows of earlier files plus the row's place in its file.

    Only one row per file is gathered, and no row moves.
    """
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    part = F.regexp_extract("_file", "part-([0-9]+)", 1).cast("long")  # beyond 99,999 files names no longer sort as numbers
    before = files.select("_file", (F.sum("_n").over(W.orderBy(part, "_file")) - F.col("_n")).alias("_before"), "_n")
    before = stored(before, "training-files")
    total = before.agg(F.sum("_n")).first()[0] or 0
    # A row per file: broadcast, or the hint of a large stored table would have all its rows shuffled.
    return rows.join(F.broadcast(before.drop("_n")), "_file").withColumn("number", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before"), total


def shards(docs: DataFrame, key: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, path: str | None = None, file_shards: int = FILE_SHARDS) -> DataFrame:
    """(shard, first_slot, slots, stride, id_bytes, payload): the whole corpus in training order.

    Shard k holds slots k * shard_slots and on; only the last may hold fewer. Partitions are ranges of shards, in order.
    Null doc_ids are written as -1, null texts as their end id alone, repeated rows as often as they occur. An empty table
    gives no shards. The same rows and key give the same shards on any layout of the table.
    """
    path = path or vocabulary_path()
    ship(docs.sparkSession)
    tokens = stored(token_sequences(in_order(docs), length, path=path), "training-tokens")
    rows, total = numbered(tokens)
    order = Permutation(total, key)
    size = encoder(path).id_bytes
    stride = HEADER.itemsize + size * length
    count = max(1, -(-total // shard_slots))
    parts = min(count, max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-count // file_shards)))
    per = -(-count // parts)  # shards of a partition

    @F.pandas_udf("bigint")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(order.slot(number.to_numpy()))

    def shard(t: pa.Table) -> pa.RecordBatch:
        head = np.zeros(t.num_rows, HEADER)
        head["doc_id"] = t["doc_id"].fill_null(-1).to_numpy()
        head["piece"], head["n"] = t["piece"].to_numpy(), t["n"].to_numpy()
        body = np.full((t.num_rows, length), PAD, _kind(size))
        for k, ids in enumerate(t["ids"]):
            got = np.frombuffer(ids.as_buffer(), _kind(size))
            body[k, : len(got)] = got
        out = np.concatenate([head.view(np.uint8).reshape(t.num_rows, -1), body.view(np.uint8)], axis=1).tobytes()
        first = t["slot"][0].as_py()
        values = [[first // shard_slots], [first], pa.array([t.num_rows], pa.int32()), pa.array([stride], pa.int32()), pa.array([size], pa.int32()), pa.array([out], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["shard", "first_slot", "slots", "stride", "id_bytes", "payload"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots come in order; a shard is written when its last slot has come."""
        held: list[pa.RecordBatch] = []
        for b in filter(len, batches):
            held.append(b)
            if (held[0].column(0)[0].as_py()) // shard_slots == b.column(0)[-1].as_py() // shard_slots:
                continue
            t = pa.Table.from_batches(held)
            of = t["slot"].to_numpy() // shard_slots
            edges = np.flatnonzero(np.diff(of)) + 1
            for s, e in zip([0, *edges[:-1]], edges):
                yield shard(t.slice(s, e - s))
            held = t.slice(edges[-1]).combine_chunks().to_batches()
        if held:
            yield shard(pa.Table.from_batches(held))

    placed = rows.withColumn("slot", slot("number")).select("slot", "doc_id", "piece", "n", "ids")
    placed = placed.repartitionById(-(-count // per), F.floor(F.col("slot") / (shard_slots * per)).cast("int")).sortWithinPartitions("slot")
    out = mapped(placed, write, "shard bigint, first_slot bigint, slots int, stride int, id_bytes int, payload binary")
    out._training_tokens = tokens
    return out


def written(docs: DataFrame, key: int, **how: int) -> DataFrame:
    """`shards`, stored, one file for each range of shards; what it was made from is deleted."""
    made = shards(docs, key, **how)
    out = stored(made, "training-shards", group_rows=GROUP_SHARDS)
    release(made._training_tokens)
    return out


def read(shard_table: DataFrame, start: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, piece, length, ids, ids_crc32) of the slots from `start` on.

    Whole shards before `start` are pruned at the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, n, stride, size, payload in zip(*(b.column(k) for k in range(6))):
                first, n, stride, size = first.as_py(), n.as_py(), stride.as_py(), size.as_py()
                raw = np.frombuffer(payload.as_buffer(), np.uint8).reshape(n, stride)
                head = raw[:, : HEADER.itemsize].copy().view(HEADER)[:, 0]
                at = np.arange(max(0, start - first), n)
                ids = [raw[k, HEADER.itemsize : HEADER.itemsize + size * int(head["n"][k])].tobytes() for k in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + at), pa.array(np.full(len(at), shard.as_py())), pa.array(at * stride), pa.array(head["doc_id"][at]), pa.array(head["piece"][at]), pa.array(head["n"][at].astype(np.int64)), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    ["slot", "shard", "byte_offset", "doc_id", "piece", "length", "ids", "ids_crc32"],
                )

    left = shard_table.where(F.col("shard") >= start // shard_slots).select("shard", "first_slot", "slots", "stride", "id_bytes", "payload")
    return mapped(left, run, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece int, length bigint, ids binary, ids_crc32 bigint")


def export(shard_table: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as folder/shard-<number>.bin on a file system that all nodes mount, never a disk of one machine; returns (shard, file).

    Files appear whole by renaming, so that a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names = []
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1)):
                name = f"{folder}/shard-{shard:08d}.bin"
                own = f"{name}.{os.getpid()}"
                with open(own, "wb") as f:
                    f.write(payload.as_buffer())
                os.replace(own, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names)], ["shard", "file"])

    return mapped(shard_table.select("shard", "payload"), run, "shard bigint, file string")
