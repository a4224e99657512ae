"""Importance resampling towards a target distribution, over hashed runs of words.

The distinct runs of words of the corpus form a dictionary (dictionary.py): there each is counted over all documents and
hashed once. Counts of buckets give each bucket's gain, the logarithm of the target's share over the corpus's; gains go
back to the counts of every document's runs. A document's weight is the mean gain of its runs. Gumbel noise from the
document's id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, release, stored
from .dictionary import Remembered, answered, blocks, joined, pack, strings_of, unpack
from .textvec import ALNUM, LOWER, flat
from .training_order import numbered

BUCKETS = 10_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of digits, ASCII letters and non-ASCII characters, A-Z in lower case, and the number of them in each text."""
    buf, offs = flat(texts)
    inside = ALNUM[buf]
    before = np.concatenate((np.zeros(min(1, len(buf)), bool), inside[:-1]))
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    starts = np.flatnonzero(inside & ~before)
    place = np.cumsum(inside)  # words stand one after the other once all else is left out
    begin = place[starts] - 1
    sizes = np.diff(np.append(begin, place[-1] if len(place) else 0))
    return strings_of(LOWER[buf[inside]], sizes), np.diff(np.searchsorted(starts, offs))


def runs(texts: pa.Array, longest: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to `longest` consecutive words, joined by one blank, text by text, and the number of them in each."""
    one, counts = words(texts)
    if longest == 1:
        return one, counts
    first = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][text] - np.arange(len(one))
    found, at, of = [one], [text], [counts]
    grown = one
    for n in range(2, longest + 1):
        keep = np.flatnonzero(left >= n)
        grown = pc.binary_join_element_wise(grown.slice(0, max(0, len(grown) - 1)), one.slice(n - 1), pa.scalar(b" ", pa.large_binary())) if len(grown) > 1 else grown.slice(0, 0)
        found.append(grown.take(pa.array(keep)))
        at.append(text[keep])
        of.append(np.maximum(counts - n + 1, 0))
    order = np.argsort(np.concatenate(at), kind="stable")
    return pa.concat_arrays(found).take(pa.array(order)), np.sum(of, axis=0)


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean gain of every document's runs of 1 to `longest` words; 0 without any.

    docs: doc_id, text; target: text. A null text has no words; rows that repeat count each; an empty target gives all buckets the same
    counts, an empty table no rows. Other columns are ignored. Only the buckets' counts are gathered. The tables that
    it reads are `_parts` of the result, to be released by whoever has stored or dropped it.
    """

    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return runs(texts, longest)

    def bucketed(table: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """The dictionary of a table, the bucket of each of its strings, and the counts of buckets."""
        coded = blocks(table, cut)

        def make():
            known = Remembered(lambda strings: [zlib.crc32(s) % buckets for s in strings])

            def answer(strings: pa.Array, often: np.ndarray) -> bytes:
                of = np.array(known(strings.to_pylist()), np.uint32)
                seen, at = np.unique(of, return_inverse=True)
                total = np.zeros(len(seen), np.int64)
                np.add.at(total, at, often)
                return pack(of, seen, total)

            return answer

        answers = answered(coded, make)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(buckets, np.int64)
            for b in batches:
                for payload in b.column(0).to_pylist():
                    _, seen, total = unpack(payload, np.uint32, np.uint32, np.int64)
                    n[seen] += total
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[np.flatnonzero(n)])], ["bucket", "n"])

        count = np.zeros(buckets, np.int64)
        for r in mapped(answers.select("payload"), sums, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            count[r["bucket"]] = r["n"]
        return coded, answers, count

    there = bucketed(target.select(F.lit(0).alias("doc_id"), "text"))
    release(*there[:2])
    coded, answers, own = bucketed(docs)
    gain = gains(own, there[2])

    def build(names: list, counts: np.ndarray, codes: np.ndarray, order: np.ndarray, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        of = np.zeros(len(order), np.uint32)
        of[order] = np.concatenate([np.zeros(0, np.uint32), *(unpack(a, np.uint32, np.uint32, np.int64)[0] for a in answers)])
        total = np.concatenate(([0], np.cumsum(gain[of][codes])))
        ends = np.concatenate(([0], np.cumsum(counts)))
        weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(counts, 1)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts), pa.array(weight)], ["doc_id", "n_features", "weight"])

    out = joined(coded, answers, build, "doc_id bigint, n_features bigint, weight bigint")
    out._parts = coded, answers
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, both with one count more in every bucket."""
    up = (target + 1).astype(float) * float(own.sum() + len(own))
    down = (own + 1).astype(float) * float(target.sum() + len(own))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def features_of(n_words: int, longest: int = 1) -> int:
    """How many runs of 1 to `longest` words a text of n_words has."""
    return sum(max(0, n_words - k + 1) for k in range(1, longest + 1))


def drawn(weighed: DataFrame, percent: int, seed: int, least: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows; of the N rows with `least` features, the floor(percent * N / 100) highest scores have ranks from 1.

    Ties go to the smaller doc_id, rows without one last; a missing id is empty in the noise. Rows are sorted in ranges, the
    row's own number among them, so that rows that repeat one document are dealt to several; only row counts of files are gathered.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_features") < least).alias("_out"), F.monotonically_increasing_id().alias("_row"))
    by = [F.col("_out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ordered = stored(rows.repartitionByRange(*by, "_row").sortWithinPartitions(*by).drop("_row"), "importance-order")
    taken = percent * ordered.where("not _out").count() // 100
    rank = F.when(F.col("number") < taken, F.col("number") + 1)
    return numbered(ordered)[0].select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
