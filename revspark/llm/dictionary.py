"""Distinct strings of a corpus, each worked on once, with the results joined back by position.

Documents are cut into strings: words, runs of words, chunks. A block of documents keeps each of its distinct
strings once, and its documents as codes into them. The distinct strings are dealt to shards by a hash, so that all
blocks ask the same task about the same string; answers go back to their block and meet the codes there. What is
shuffled is a string per block, not per occurrence, packed into one row for each block and shard; a string that is in
every document weighs no more than any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, release_part, stored
from .textvec import slices

#: Bytes of text of a block; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Distinct strings that a shard remembers; beyond, it starts anew, and works some of them out again.
REMEMBERED = 1 << 20

SCHEMA = "block bigint, shard int, payload binary"
_NAMES = ["block", "shard", "payload"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed value, byte by byte in planes, which compress better."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        out.append(np.array([len(a), a.dtype.itemsize], "<i8").tobytes())
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(payload: bytes, *kinds: type | str) -> list[np.ndarray]:
    """The arrays of `pack`, of the given types."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    at, out = 8, []
    for kind in kinds:
        n, width = np.frombuffer(raw[at : at + 16].tobytes(), "<i8")
        at += 16
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def strings_of(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive byte strings of the given sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings and their sizes."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = strings.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], np.diff(offsets)


def _shard_of(strings: pa.Array, shards: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(s) % shards for s in strings.to_pylist()), np.uint32, len(strings))


Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def blocks(docs: DataFrame, cut: Cut, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """Documents as codes into their block's distinct strings: (block, shard, payload), stored.

    docs: doc_id, text. cut: texts to (all their strings in order, number of strings of each text). The row of shard -1
    has doc_ids, which of them are null, the number of strings of each document, codes, and the shard of each code;
    codes go by falling frequency. The rows of other shards have the shard's strings in the order of their codes:
    sizes, bytes, and how often each occurs. There are as many shards as shuffle partitions.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block(name: int, ids: list, counts: list[np.ndarray], strings: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.chunked_array(strings, pa.large_binary()).dictionary_encode()
        at = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)])
        words = coded.chunk(coded.num_chunks - 1).dictionary if len(at) else pa.array([], pa.large_binary())
        often = np.bincount(at, minlength=len(words))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        often, words = often[order], words.take(pa.array(order))
        of = _shard_of(words, shards)
        null = np.array([i is None for i in ids], np.uint8)
        rows = [(-1, pack(np.array([i or 0 for i in ids], np.int64), null, np.concatenate(counts).astype(np.int64), rank[at], of))]
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            mine = by[edges[s] : edges[s + 1]]
            data, sizes = bytes_of(words.take(pa.array(mine)))
            rows.append((int(s), pack(sizes.astype(np.uint32), data, often[mine].astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32  # the written table fixes the names
        ids: list = []
        counts: list[np.ndarray] = []
        strings: list[pa.Array] = []
        held = 0
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                size = b.column(1).nbytes
                if held and held + size > block_bytes:
                    yield block(name, ids, counts, strings)
                    name, ids, counts, strings, held = name + 1, [], [], [], 0
                found, of = cut(b.column(1))
                ids += b.column(0).to_pylist()
                counts.append(of)
                strings.append(found)
                held += size
        if ids:
            yield block(name, ids, counts, strings)

    rows = mapped(docs.select(F.col("doc_id").cast("bigint"), "text"), run, SCHEMA)
    return stored(rows.withColumn("of_docs", F.col("shard") < 0), "dictionary-blocks", by="of_docs", bucket=(shards, "block"))


def asked(coded: DataFrame) -> DataFrame:
    """The strings that blocks ask about, each shard in a task of its own."""
    rows = coded.where("not of_docs").select("block", "shard", "payload")
    return rows.repartitionById(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


class Remembered:
    """Values of strings, each worked out once for as long as it is remembered."""

    def __init__(self, work: Callable[[list[bytes]], list], limit: int = REMEMBERED):
        self.work, self.limit, self.known = work, limit, {}

    def __call__(self, strings: list[bytes]) -> list:
        new = [s for s in strings if s not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, strings
        self.known.update(zip(new, self.work(new)))
        return [self.known[s] for s in strings]


def answered(coded: DataFrame, make: Callable[[], Callable[[pa.Array, np.ndarray], bytes]]) -> DataFrame:
    """(block, shard, payload), stored: for each row of strings its answer. make, once a task, gives the function of (strings, how often each occurs).

    The strings themselves are deleted then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = make()
        for b in batches:
            for block, shard, payload in zip(*(c.to_pylist() for c in b.columns)):
                sizes, data, often = unpack(payload, np.uint32, np.uint8, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([answer(strings_of(data, sizes), often)], pa.binary())], _NAMES)

    out = stored(mapped(asked(coded), run, SCHEMA), "dictionary-answers")
    release_part(coded, "of_docs=false")
    return out


Build = Callable[[list, np.ndarray, np.ndarray, np.ndarray, list[bytes]], Iterator[pa.RecordBatch]]


def joined(coded: DataFrame, answers: DataFrame, build: Build, schema: str) -> DataFrame:
    """build(doc_ids, strings of each, codes, order, answers) of every block; answers, one after the other, are those of codes `order`.

    Blocks are stored in buckets, so that only the answers move.
    """

    def whole(docs: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, null, counts, codes, of = unpack(docs, np.int64, np.uint8, np.int64, np.uint32, np.uint32)
        names = [None if n else int(i) for i, n in zip(ids, null)]
        return build(names, counts, codes, np.argsort(of, kind="stable"), answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, got in zip(*b.columns):
                yield from whole(docs.as_py(), got.as_py() or [])

    parts = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "payload"))).alias("_parts"))
    rows = coded.where("of_docs").select("block", F.col("payload").alias("docs")).hint("merge").join(parts.select("block", F.col("_parts.payload").alias("answers")), "block", "left")
    return mapped(rows.select("docs", "answers"), run, schema)
