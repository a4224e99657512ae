"""Sparse indicator features and what the two text classifiers share: sampling, calibration, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped
from .textvec import Words, flat, mix, once, slices

#: Feature extractor: (flat bytes, offsets) to one array of distinct feature ids per text.
Extract = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]

#: Documented bound of a fit, beside its rows: characters of text that are taken for each tag.
SAMPLE_CHARACTERS = 64_000_000

#: A name that tables are unlikely to have.
_TEXT = "_linear_model_text"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _byte_class() -> np.ndarray:
    """Letters, digits and non-ASCII bytes by kind; every other byte is a class of its own."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("a") : ord("z") + 1] = 256
    out[ord("A") : ord("Z") + 1] = 257
    out[ord("0") : ord("9") + 1] = 258
    out[128:] = 259
    return out


_CLASS = _byte_class()


@dataclass(frozen=True)
class ShapeAndCharacterGrams:
    """Indicators of character trigrams and of 1- to 3-grams of word shapes.

    A word's shape is the kinds of its first, second and last bytes and whether the word
    repeats the one before it, so that case, symbols and stuttering show in unseen words.
    """

    bits: int = 16

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        wide = buf.astype(np.uint32)
        tri = np.zeros(len(buf), np.uint32)
        if len(buf) > 2:
            tri[:-2] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        tri = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int32)
        words = Words(buf, offs, ~_SPACE, lower=False)
        s, e, h = words.starts, words.ends, words.hash
        same = np.zeros(len(s), np.uint64)
        if len(s):
            same[1:] = h[1:] == h[:-1]
            same[words.first[:-1][words.first[:-1] < len(s)]] = 0
        second = np.where(e - s > 1, _CLASS[buf[np.minimum(s + 1, max(len(buf) - 1, 0))]] if len(buf) else 0, 300)
        words.hash = mix(((_CLASS[buf[s]] * np.uint64(512) + second.astype(np.uint64)) * np.uint64(512) + _CLASS[buf[e - 1]]) * np.uint64(2) + same + np.uint64(1))
        shapes = [words.grams(n) for n in (1, 2, 3)]
        ids = [((g + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32) for n, (g, _) in enumerate(shapes)]
        stamp = np.zeros(1 << self.bits, np.int32)
        out = []
        for k in range(len(offs) - 1):
            a, b = words.first[k], words.first[k + 1]
            found = [tri[offs[k] : max(offs[k], offs[k + 1] - 2)]]
            found += [i[a:b][ok[a:b]] for i, (_, ok) in zip(ids, shapes)]
            out.append(once(np.concatenate(found), stamp))
        return out


@dataclass(frozen=True)
class WordGrams:
    """Indicators of lower-cased word unigrams."""

    bits: int = 18

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        words = Words(buf, offs)
        ids = (words.hash >> np.uint64(64 - self.bits)).astype(np.int32)
        stamp = np.zeros(1 << self.bits, np.int32)
        return [once(ids[words.first[k] : words.first[k + 1]], stamp) for k in range(len(offs) - 1)]


def sampled_ids(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The `n` rows whose hashed doc_id is least; the same rows however the table is partitioned."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def one_label(labelled: DataFrame) -> DataFrame:
    """(doc_id, tag): one row for every doc_id whose labels, 0 or 1, agree; nulls count for nothing."""
    rows = labelled.select("doc_id", F.col("label").cast("int").alias("tag")).where("doc_id is not null and tag in (0, 1)")
    return rows.groupBy("doc_id").agg(F.min("tag").alias("tag"), F.max("tag").alias("_most")).where("tag = _most").select("doc_id", "tag")


def gather(docs: DataFrame, ids: DataFrame, extract: Extract, characters: int = SAMPLE_CHARACTERS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tag and features of the documents named in `ids` (doc_id, tag), which the caller has bounded.

    Of rows that repeat a doc_id the least text counts. A tag's texts are taken in the order of the hashed doc_id while they hold
    `characters` at most together, one text at least, so that what reaches the driver is bounded in bytes too.
    Rows come in the order of doc_id and features, so that a fit doesn't depend on partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                found = [np.sort(x).astype(np.int32).tobytes() for x in extract(*flat(b.column(2)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "tag", "ids"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "tag")), "doc_id")  # thousands of ids at most
    chosen = chosen.groupBy("doc_id", "tag").agg(F.min("text").alias("text"))
    before = F.sum(F.length(F.coalesce("text", F.lit("")))).over(W.partitionBy("tag").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    first = F.row_number().over(W.partitionBy("tag").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = chosen.withColumns({"_held": before, "_first": first}).where((F.col("_held") <= characters) | (F.col("_first") == 1)).select("doc_id", "tag", "text")
    got = mapped(chosen, run, "doc_id bigint, tag int, ids binary").toArrow().to_pydict()
    rows = sorted(zip(got["doc_id"], got["tag"], got["ids"]), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], np.int32) for r in rows]


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by damped Newton steps; y is 0 or 1."""
    a, b = 1.0, 0.0
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, s = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-12)
        g = np.array([(d * margin).sum() + 1e-4 * a, d.sum()])
        h = np.array([[(s * margin**2).sum() + 1e-4, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 4 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class LinearModel:
    """score = logistic(slope * margin + offset); margin = sum of weights, over the norm of scales if given."""

    extract: Extract
    weights: np.ndarray
    scales: np.ndarray | None
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows))
        for k, ids in enumerate(rows):
            if len(ids):
                out[k] = self.weights[ids].sum(dtype=np.float64)
                if self.scales is not None:
                    out[k] /= max(float(np.sqrt(np.square(self.scales[ids], dtype=np.float64).sum())), 1e-9)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        # Feature ids are sorted, so that sums, and thus scores, of equal texts are equal.
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins([np.sort(r) for r in rows]) + self.offset, -40, 40)))

    def score(self, docs: DataFrame, *keep: str, name: str = "score") -> DataFrame:
        """(keep columns, score) for every row of docs; a null or empty text gets a score too. name: of the new column."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, _TEXT):
                    got = self.scores(self.extract(*flat(b.column(b.num_columns - 1))))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], [*b.schema.names[:-1], name])

        kept = docs.select(*keep)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        return mapped(docs.select(*keep, F.col("text").alias(_TEXT)), run, f"{fields}, `{name}` double")
