"""Best-fit packing with certified bounds.

Documents become pieces of at most one sequence. Pieces are dealt evenly to partitions of bounded
size; each is packed by best-fit decreasing, and dual-feasible functions give a lower bound
of its number of sequences. A partition that meets its bound is certified: no packing of its
pieces is smaller. The others give the pieces of their unfilled sequences away, which are
dealt anew and packed again; where best-fit decreasing again misses the bound, sequences are filled by exact
sums instead if that takes fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, release, stored
from .tokens import encoder, vocabulary_path

CAPACITY = 1024
END = 2
#: Pieces of a partition, on average.
PARTITION_ROWS = 100_000


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; a null text is empty.

    ids, if asked for, are little-endian unsigned 32-bit numbers. Each text ends with the id `end`.
    """
    path = path or vocabulary_path()
    tried = encoder(path).fast is not None
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, tried).ids
        for b in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = np.append(ids_of(text.as_py() or ""), np.uint32(end)).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    for c, v in zip(cols, (doc, k, s, n, zlib.crc32(part), part)):
                        c.append(v)
                    size += len(part)
                if with_ids and size > 1 << 24:
                    yield _batch(cols, names)
                    cols, size = [[] for _ in names], 0
            if cols[0]:
                yield _batch(cols, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return mapped(docs.select("doc_id", "text"), run, schema)


def _batch(cols: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs at least, by two families of dual-feasible functions.

    One drops what is shorter than k and rounds what is longer than capacity - k up; the other
    rounds (q + 1) * length / capacity down to whole parts of 1 / q.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(1, capacity // 2 + 1)
    large = number[capacity] - number[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for q in range(1, 65):
        x = (q + 1) * size
        parts = np.where(x % capacity == 0, q * size, x // capacity * capacity)  # of q * capacity
        best = max(best, -(-int((count * parts).sum()) // (q * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, and the room left in every sequence.

    Sequences are kept by the room left in them; a bit mask of the rooms that occur finds the
    tightest fit in constant time. Pieces of equal length keep their order.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - n
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(left, np.int64)


def tightest_fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_fit_decreasing, but each sequence takes the longest piece left and then the set of others that fills it best.

    Sums that sets of pieces can reach are bits of an integer; lengths enter from the longest on, at most as often as
    they fit, until the room is met exactly.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-np.arange(len(lengths)), kind="stable").tolist():
        stacks[int(lengths[i])].append(i)
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    left: list[int] = []
    present = sorted({int(n) for n in lengths}, reverse=True)
    while present:
        taken = [present[0]]
        room = capacity - present[0]
        limit = (1 << (room + 1)) - 1
        sums, steps = 1, []
        for n in present:
            if n > room:
                continue
            for _ in range(min(len(stacks[n]) - (n == present[0]), room // n)):
                more = (sums | sums << n) & limit
                if more == sums:
                    break
                steps.append((n, sums))
                sums = more
            if sums >> room & 1:
                break
        rest = sums.bit_length() - 1
        left.append(room - rest)
        for n, before in reversed(steps):
            if not before >> rest & 1:
                taken.append(n)
                rest -= n
        at = 0
        for n in taken:
            i = stacks[n].pop()
            bins[i], offsets[i] = len(left) - 1, at
            at += n
        present = [n for n in present if stacks[n]]
    return bins, offsets, np.array(left, np.int64)


def _packed(rows: DataFrame, turn: int, groups: int, capacity: int) -> DataFrame:
    """One round: deals rows to `groups` partitions and packs each."""
    kept = [f for f in rows.schema.fields if f.name not in ("sequence_id", "offset", "certified", "open")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        if turn and len(left) > lower_bound(lengths, capacity):
            tight = tightest_fill(lengths, capacity)
            if len(tight[2]) < len(left):
                bins, offsets, left = tight
        out = part[names].copy()
        out["sequence_id"] = bins + (int(part["_group"].iloc[0]) << 32 if len(part) else 0) + (turn << 60)
        out["offset"] = offsets
        sure = len(left) == lower_bound(lengths, capacity)
        out["certified"] = sure
        out["open"] = (left[bins] > 0) & (not sure)
        return out

    # The row's place in the stored table takes part in the hash, so that rows with one doc_id are dealt evenly too.
    salted = rows.select(*names, F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)).alias("_group"))
    return salted.groupBy("_group").applyInPandas(run, schema + ", sequence_id bigint, offset bigint, certified boolean, open boolean")


def pack(found: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, rounds: int = 3) -> DataFrame:
    """Adds sequence_id, offset and certified to pieces (doc_id, piece, length, ...).

    Every piece gets one place; places of a sequence are gapless from 0. certified: the
    number of sequences of the piece's partition is proven least. A further round is kept only
    if it takes fewer sequences. Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    found = stored(found, "packing-pieces")
    n = found.count()
    now = stored(_packed(found, 0, max(1, -(-n // partition_rows)), capacity), "packing-0")
    for turn in range(1, rounds):
        loose = now.where("open")
        was = loose.agg(F.count("*").alias("n"), F.count_if(F.expr("offset = 0")).alias("bins")).first()
        if not was["n"]:
            break
        again = stored(_packed(loose, turn, max(1, -(-was["n"] // partition_rows)), capacity), f"packing-{turn}")
        if again.where("offset = 0").count() >= was["bins"]:
            break
        now = now.where("not open").unionByName(again)
    return now.drop("open")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n): the sequences themselves, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n"))
