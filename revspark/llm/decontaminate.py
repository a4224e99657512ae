"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are seeds. A seed is rare if its words make it unlikely to
occur by chance in the corpus, judged by document frequencies of the items' words over all documents, where
occurrences inside an item's n-gram don't count: an item that was copied a million times doesn't make its own words
look frequent. Besides, each stretch of STRETCH words keeps its rarest n-gram as a seed however frequent it is; that one
counts where the words around it agree for a whole stretch. So a copy that has a stretch word for word is found
whatever the number of its holders and the size of the table. Seeds join the words of every passage; seed matches of an item that lie near one another
mark a region, and local alignment with gaps scores the region against the whole item.

A passage is a copy by its share of the item, or by its own length: OWN_WORDS equal words in an alignment of OWN_SHARE of the best score.

An item of more than PIECE words is aligned piece by piece, pieces overlapping by half, so that a passage copied out of a long
item counts by its own length and tables stay small.

Texts are never shuffled: items travel to the documents in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .textvec import Words, flat, slices

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that one scan carries; a longer benchmark is scanned for in several blocks.
BLOCK_WORDS = 1_000_000
#: Words of the parts that longer items are aligned by; each begins half as many on.
PIECE = 128
#: Words of a stretch, each of which has a seed; an n-gram that isn't rare counts only in a whole stretch of equal words.
STRETCH = 8
#: Equal words, and share of the greatest score over the passage's length, of passages that count whatever the item's length.
OWN_WORDS, OWN_SHARE = 32, 0.6
#: Cells of one alignment step, to bound its memory.
CELLS = 1 << 19

SCHEMA = "doc_id bigint, item_id bigint, score double, matched int, item_words int, start_word int, end_word int"


@dataclass
class Block:
    """Items, or pieces of them, as word hashes, and their seeds sorted by hash; item and size of a part: its item's place in names and words."""

    names: np.ndarray
    item: np.ndarray
    size: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_pos: np.ndarray
    seed_rare: np.ndarray
    n: int


def words_of(texts: pa.Array) -> Words:
    return Words(*flat(pc.utf8_lower(texts)))


def _item_words(texts: list) -> Words:
    return words_of(pa.array(texts, pa.string()))


def pieces_of(n: int, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n words: the whole, or pieces that overlap by half and cover it."""
    if n <= piece:
        return [(0, n)]
    return [(s, s + piece) for s in range(0, n - piece, piece // 2)] + [(n - piece, n)]


def make_block(ids: list[int], texts: list, n: int, common: dict[int, int], docs: int, chance: float) -> Block:
    """Seeds are all n-grams (whole items if shorter) expected, by their words' frequencies, in under `chance` places a document, and the rarest of each stretch."""
    whole = _item_words(texts)
    parts = [(k, whole.first[k] + s, whole.first[k] + e) for k in range(len(ids)) for s, e in pieces_of(int(whole.first[k + 1] - whole.first[k]))]
    item = np.array([p[0] for p in parts], int)
    words = np.concatenate([np.zeros(0, np.uint64), *(whole.hash[s:e] for _, s, e in parts)])
    first = np.concatenate(([0], np.cumsum([e - s for _, s, e in parts]))).astype(int)
    grams, _ = whole.grams(n)
    share = np.array([(common.get(int(h), 0) + 1) / (docs + 1) for h in whole.hash])
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.minimum(share, 1.0)))))
    seeds, owner, pos, rares = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, bool)]
    for k, (_, s, e) in enumerate(parts):
        at = np.arange(s, e - n + 1)
        likely = logs[at + n] - logs[at]
        rare = likely < np.log(chance)
        width = min(STRETCH - n + 1, len(at))
        if width > 0:
            views = np.lib.stride_tricks.sliding_window_view(likely, width)
            rarest = np.zeros(len(at), bool)
            rarest[np.arange(len(views)) + views.argmin(1)] = True
            keep = np.flatnonzero(rare | rarest)
        else:
            keep = np.zeros(0, int)
        seeds.append(grams[at[keep]])
        owner.append(np.full(len(keep), k))
        pos.append(keep)
        rares.append(rare[keep] | (e - s < STRETCH))
    seeds, owner, pos, rares = np.concatenate(seeds), np.concatenate(owner), np.concatenate(pos), np.concatenate(rares)
    order = np.lexsort((pos, owner, seeds))
    return Block(np.array(ids, np.int64), item, np.diff(whole.first)[item], words, first, seeds[order], owner[order], pos[order], rares[order], n)


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Smith-Waterman over words for each (item, region): score, matches, start and end word in the region.

    The table is filled row by row for all pairs at once; gaps along a row are a running
    maximum. Start and match count travel with each cell in one packed integer, so
    that no table has to be kept. Of equal scores the first end wins.
    """
    p = len(items)
    rows, cols = max(map(len, items)), max(map(len, regions))
    a = np.zeros((p, rows), np.uint64)
    b = np.zeros((p, cols), np.uint64)
    live_a = np.zeros((p, rows), bool)
    live_b = np.zeros((p, cols), bool)
    for k, (x, y) in enumerate(zip(items, regions)):
        a[k, : len(x)], live_a[k, : len(x)] = x, True
        b[k, : len(y)], live_b[k, : len(y)] = y, True
    # A cell is score << 40 | (cols - start) << 20 | matches: comparing cells compares scores first,
    # then prefers the earliest start. An empty alignment has score 0 and no start.
    high, mid = np.int64(1) << 40, np.int64(1) << 20
    at = np.arange(cols, dtype=np.int64)
    slope = at * high * -GAP
    low = np.int64(mid * mid - 1)
    prev = np.zeros((p, cols + 1), np.int64)
    best = np.zeros(p, np.int64)
    end = np.zeros(p, np.int64)
    for i in range(rows):
        hit = (a[:, i : i + 1] == b) & live_b & live_a[:, i : i + 1]
        diag = prev[:, :-1]
        fresh = diag < high
        came = np.where(hit, np.where(fresh, (cols - at) * mid, diag) + MATCH * high + 1, np.where(fresh, 0, diag + MISMATCH * high))
        up = prev[:, 1:] + GAP * high
        cell = np.maximum(np.maximum(came, up), 0)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        cell = np.where(cell < high, 0, cell)
        prev[:, 1:] = cell
        top = cell.argmax(1)
        got = cell[np.arange(p), top]
        better = (got >> 40) > (best >> 40)
        best, end = np.where(better, got, best), np.where(better, top + 1, end)
    return [(int(s >> 40), int(s & (mid - 1)), int(cols - ((s & low) >> 20)), int(e)) for s, e in zip(best, end)]


def _in_stretch(w: Words, block: Block, at: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Whether a stretch of STRETCH equal words, all of one text and one item, holds the match of a seed at word `at`."""
    doc = np.searchsorted(w.first, at, "right") - 1
    item = block.seed_item[seed]
    there = block.first[item] + block.seed_pos[seed]
    length = np.full(len(at), block.n)
    for step, begin in ((1, block.n), (-1, -1)):
        alive = np.ones(len(at), bool)
        for k in range(STRETCH - block.n):
            x, y = at + begin + step * k, there + begin + step * k
            alive &= (x >= w.first[doc]) & (x < w.first[doc + 1]) & (y >= block.first[item]) & (y < block.first[item + 1])
            alive[alive] = w.hash[x[alive]] == block.words[y[alive]]
            length += alive
    return length >= STRETCH


def _scan(doc_ids: list, w: Words, block: Block, least: float) -> list[tuple]:
    """Alignments of at least `least` of all texts of one slice."""
    grams, whole = w.grams(block.n)
    if not len(block.seeds) or not len(grams):
        return []
    lo = np.searchsorted(block.seeds, grams)
    found = np.flatnonzero(whole & (block.seeds[np.minimum(lo, len(block.seeds) - 1)] == grams))
    if not len(found):
        return []
    lo, hi = lo[found], np.searchsorted(block.seeds, grams[found], "right")
    many = hi - lo
    at = np.repeat(found, many)
    seed = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    counts = block.seed_rare[seed]
    counts[~counts] = _in_stretch(w, block, at[~counts], seed[~counts])
    at, seed = at[counts], seed[counts]
    if not len(at):
        return []
    item = block.seed_item[seed]
    doc = np.searchsorted(w.first, at, "right") - 1
    size = np.diff(block.first)[item]
    begin = at - block.seed_pos[seed]  # where the item would begin, in words
    order = np.lexsort((begin, item, doc))
    doc, item, begin, size = doc[order], item[order], begin[order], size[order]
    new = np.ones(len(doc), bool)  # a region ends where the next beginning lies more than half an item on
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:] // 2 + 2)
    heads = np.flatnonzero(new)
    far = (begin - np.repeat(begin[heads], np.diff(np.append(heads, len(doc))))) // (4 * size + 64)
    new[1:] |= far[1:] != far[:-1]  # long chains are cut; neighbours overlap by more than an item
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    out: dict[tuple[int, int], tuple] = {}
    slack = size[heads] // 4 + 4
    left = np.maximum(begin[heads] - slack, w.first[doc[heads]])
    right = np.minimum(begin[tails] + size[heads] + slack, w.first[doc[heads] + 1])
    k = np.argsort(right - left, kind="stable")
    i = 0
    while i < len(k):
        j = i + 1
        long = int(right[k[i]] - left[k[i]])
        while j < len(k) and (j - i + 1) * max(long, int(right[k[j]] - left[k[j]])) <= CELLS and right[k[j]] - left[k[j]] <= 2 * long + 64:
            j += 1
        part = k[i:j]
        i = j
        which = item[heads[part]]
        scored = align([block.words[block.first[x] : block.first[x + 1]] for x in which], [w.hash[l:r] for l, r in zip(left[part], right[part])])
        for x, d, l, (score, matched, s, e) in zip(which, doc[heads[part]], left[part], scored):
            n = int(block.first[x + 1] - block.first[x])
            share = score / (MATCH * n)
            begin_word = int(l - w.first[d]) + s
            row = (share, matched, int(block.size[x]), begin_word, int(l - w.first[d]) + e)
            key = int(d), int(block.item[x])
            was = out.get(key)
            own = matched >= OWN_WORDS and score >= OWN_SHARE * MATCH * (e - s)
            if (share >= least or own) and (was is None or (share, -begin_word) > (was[0], -was[3])):
                out[key] = row
    return [(doc_ids[d], int(block.names[x]), *row) for (d, x), row in sorted(out.items())]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list]:
    """Rows of the benchmark, in the order of item_id, in lists of about block_words words; one row at least."""
    part, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").split()) + 1
        if part and size + n > block_words:
            yield part
            part, size = [], 0
        part.append(r)
        size += n
    if part:
        yield part


def _frequencies(docs: DataFrame, vocabulary: np.ndarray, grams: np.ndarray, n_words: int) -> tuple[dict[int, int], int]:
    """Number of all documents with each of the given sorted word hashes outside the given n-grams, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for b in slices(batch, "text"):
                w = words_of(b.column(0))
                if len(w.hash) and len(vocabulary):
                    k = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                    own, whole = w.grams(n_words)
                    copied = np.flatnonzero(whole & (grams[np.minimum(np.searchsorted(grams, own), len(grams) - 1)] == own)) if len(grams) else np.zeros(0, int)
                    outside = np.ones(len(w.hash), bool)
                    for step in range(n_words):
                        outside[copied + step] = False
                    hit = np.flatnonzero(outside & (vocabulary[k] == w.hash))
                    doc = np.searchsorted(w.first, hit, "right") - 1
                    total += np.bincount(np.unique(doc * len(vocabulary) + k[hit]) % len(vocabulary), minlength=len(vocabulary))
        ids = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.append(total[ids[:-1]], n))], ["word", "n"])

    rows = mapped(docs.select("text"), run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}  # at most as many rows as the block has words
    return {int(vocabulary[k]): n for k, n in count.items() if k >= 0}, count.get(-1, 0)


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.4, seed_words: int = 3, chance: float = 1e-3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and test item that a passage of the document copies.

    docs: doc_id, text; items: item_id, text. score is the alignment's score over that of a full copy
    (1.0: word for word); rows below `least` are left out unless the passage is a copy by its own length. start_word and end_word
    (exclusive) bound the best passage, the first among equals. Words are runs of digits, ASCII
    letters and non-ASCII characters, in any case. Null or empty texts match nothing;
    rows that repeat an id each give rows. Other columns are ignored. Items shorter than
    `seed_words` words are sought by all their words. Of an item of more than PIECE words the score is that of its best piece.
    """
    out = None
    for blocks in _item_blocks(docs, items, seed_words, chance, block_words):

        def run(batches: Iterator[pa.RecordBatch], blocks: list[Block] = blocks) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            for batch in batches:
                for b in slices(batch, "text"):
                    ids, words = b.column(0).to_pylist(), words_of(b.column(1))
                    got = [row for block in blocks for row in _scan(ids, words, block, least)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

        found = mapped(docs.select("doc_id", "text"), run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _item_blocks(docs: DataFrame, items: DataFrame, seed_words: int, chance: float, block_words: int) -> Iterator[list[Block]]:
    """The items in sets of bounded size, each a block of items as long as a seed and blocks of shorter ones; frequencies are counted in one scan a set."""
    for rows in _blocks(items, block_words):
        words = _item_words([r["text"] for r in rows])
        sizes = np.diff(words.first)
        grams, within = words.grams(seed_words)
        common, total = _frequencies(docs, np.unique(words.hash), np.unique(grams[within]), seed_words)
        parts = ((n, [r for r, size in zip(rows, sizes) if min(size, seed_words) == n]) for n in range(1, seed_words + 1))
        yield [make_block([r["item_id"] for r in part], [r["text"] for r in part], n, common, total, chance) for n, part in parts if part]


def clean(docs: DataFrame, items: DataFrame, least: float = 0.4, seed_words: int = 3, chance: float = 1e-3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any passage that copies an item; all their columns stay.

    Rows are judged one by one in the scan itself, so that nothing is joined or shuffled.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for blocks in list(_item_blocks(docs, items, seed_words, chance, block_words)):

        def run(batches: Iterator[pa.RecordBatch], blocks: list[Block] = blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "text"):
                    words = words_of(b.column(b.schema.get_field_index("text")))
                    keep = np.ones(b.num_rows, bool)
                    for block in blocks:
                        keep[[g[0] for g in _scan(list(range(b.num_rows)), words, block, least)]] = False
                    yield b.filter(pa.array(keep))

        docs = mapped(docs, run, fields)
    return docs
