"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one narrow pass. Only distinct fingerprints are compared, so that
exact copies, however many, cost one row. Each fingerprint is entered in two tables, one
per 32-bit segment; two fingerprints at distance 2 or less differ by at most one bit in one
of the segments, so a look-up of the radius-1 ball of each segment finds every pair. Of a
ball only the centre and the points with one bit cleared are enumerated: of two segments that
differ in one bit, one is the other with a bit cleared.

A segment value that many fingerprints share (a large group of near copies) would give
the square of its size in candidates. Buckets beyond `bucket` members are therefore handled
in another exact way: every member, and whoever looks them up, is entered under all points of its
balls in the four 16-bit segments, the others kept whole. Two fingerprints share such a
point if and only if they differ in at most two bits, and no point has more than 65 entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mapped, merged, release, stored
from .textvec import Words, flat, mix, slices

BITS = 64
SEED = 42
CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash over XXH64 of word shingles, repeats included; bits set in over half of them."""
    tokens = (text or b"").lower().split()  # bytes: ASCII case and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - w + 1].tolist(), ends[w - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def _flip(value: F.Column, bit: int) -> F.Column:
    return value.bitwiseXOR(F.lit((1 << bit) - (1 << 64) if bit == 63 else 1 << bit))


def links(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """(u, v): links whose components are those of all pairs of the distinct `fp` that differ in at most two bits.

    In buckets of up to `bucket` members these are the pairs themselves; in larger ones every
    fingerprint is linked with the least fingerprint of each point that it shares.
    """
    fps = fps.select("fp").distinct()
    halves = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)]

    def key(segment: int, value: F.Column) -> F.Column:
        return value.bitwiseOR(F.lit(segment << 32))

    index = fps.select("fp", F.explode(F.array(*[key(s, h) for s, h in enumerate(halves)])).alias("key"))
    balls = [
        F.when(F.lit(r == 0) | (h.bitwiseAND(F.lit(1 << max(r - 1, 0))) != 0), key(s, _flip(h, r - 1) if r else h))
        for s, h in enumerate(halves)
        for r in range(33)
    ]
    probes = fps.select("fp", F.explode(F.array_compact(F.array(*balls))).alias("key"))
    index = stored(index, "simhash-index")
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    hot = stored(sizes.where(F.col("n") > bucket).select("key"), "simhash-hot")
    some_hot = not hot.isEmpty()
    cool = index.join(hot, "key", "left_anti") if some_hot else index
    a, b = probes.select(F.col("fp").alias("u"), "key"), cool.select(F.col("fp").alias("v"), "key")
    near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    pairs = a.join(b, (a["key"] == b["key"]) & near).select("u", "v")
    if not some_hot:
        return pairs
    members = probes.join(hot, "key", "left_semi").select("fp").distinct()
    points = members.select("fp", F.explode(F.array(F.col("fp"), *[_flip(F.col("fp"), i) for i in range(BITS)])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"))
    return pairs.union(points.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct())


def clusters(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    component_id is the smallest doc_id that can be reached over links of at most two
    differing bits. Null and empty texts have fingerprint zero and link as any other. Rows
    that repeat a doc_id are kept. Other columns are ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, words), "simhash-fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(nodes), "simhash-cc")
    joined = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = stored(joined, "simhash-roots")
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = joined.join(best, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


#: Segments of the long fingerprint that similar texts are sought by, 32 bits each, and the bits in which such texts may differ.
SEGMENTS, DISTANCE = 10, 80
#: Rounds of comparing texts with the first, then with the first of another group, of each segment value that they look up; all others follow.
ROUNDS = 2
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def _sequence(words: Words, k: int) -> np.ndarray:
    return words.hash[words.first[k] : words.first[k + 1]]


def _majority(h: np.ndarray) -> np.uint64:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]


def _longs(segments: int = SEGMENTS) -> list[str]:
    """Names of the columns that hold a long fingerprint, two segments each."""
    return [f"f{k}" for k in range(-(-segments // 2))]


def _long_fingerprint(h: np.ndarray, longs: int) -> list[np.uint64]:
    g = np.unique(h)
    return [_majority(mix(g + np.uint64(42 + v))) if len(g) else np.uint64(0) for v in range(longs)]


def long_fingerprints(docs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, content, f0, f1, ...): a hash of the text's words in order, and a SimHash fingerprint of 32 bits for each of `segments`, two in a long.

    Features are the distinct words: an edit touches few of these, so that a similarity of 0.8 over five words, about
    one word in forty-five replaced, is one bit in fifteen. Counted with repeats, common words would place all texts of a
    language close.
    """
    names = ["doc_id", "content", *_longs(segments)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                words = Words(*flat(b.column(1)), _NOT_SPACE)
                out = [np.zeros(b.num_rows, np.uint64) for _ in names[1:]]
                for k in range(b.num_rows):
                    h = _sequence(words, k)
                    place = np.arange(1, len(h) + 1, dtype=np.uint64)
                    out[0][k] = np.bitwise_xor.reduce(mix(h + mix(place))) if len(h) else 0
                    for c, f in zip(out[1:], _long_fingerprint(h, len(names) - 2)):
                        c[k] = f
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c.view(np.int64)) for c in out)], names)

    return mapped(docs.select("doc_id", "text"), run, ", ".join(f"{n} bigint" for n in names))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def looked_up(texts: DataFrame, segments: int = SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(doc, key) of texts under each segment's value, and of texts that look such a value up; both only where two texts meet.

    texts: (doc, f0, f1, ...). A text looks up the ball of radius 1 around each of its segments: the value, and the values
    with one bit cleared, as of two values that differ in one bit one is the other with a bit cleared.
    """
    values = [(F.col(f"f{k // 2}") if k % 2 == 0 else F.shiftrightunsigned(f"f{k // 2}", 32)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(segments)]
    index = texts.select("doc", F.explode(F.array(*[v.bitwiseOR(F.lit(k << 32)) for k, v in enumerate(values)])).alias("key"))
    ball = F.array_compact(F.array(F.col("key"), *[F.when(F.col("key").bitwiseAND(F.lit(1 << b)) != 0, _flip(F.col("key"), b)) for b in range(32)]))
    index = stored(index, "simhash-index")
    first = stored(index.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "simhash-values")
    probes = index.select("doc", F.explode(ball).alias("key"))
    hits = stored(probes.join(first, "key").where("doc <> first or n > 1").select("doc", "key"), "simhash-hits")
    members = stored(index.join(stored(hits.select("key").distinct(), "simhash-keys"), "key", "left_semi"), "simhash-members")
    release(index, first)
    return members, hits


def _grouped(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, rows["doc"] == comp["node"], "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))


def against_first(members: DataFrame, hits: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(a, b): each text that looks a value up, with the first text of that value; with groups comp (node, root), with the first of the value's second group.

    A value's second group is the one with the smallest text beside the group of its first. Texts of the same group aren't paired.
    """
    if comp is None:
        first = stored(members.groupBy("key").agg(F.min("doc").alias("b")), "simhash-firsts")
        return _ordered(hits.join(first, "key").select(F.col("doc").alias("a"), "b"))
    groups = stored(_grouped(members, comp).groupBy("key", "root").agg(F.min("doc").alias("b")), "simhash-key-groups")
    first = stored(groups.groupBy("key").agg(F.min("b").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "simhash-firsts")
    others = stored(groups.join(first, "key").where("b <> first").select("key", "root", "b"), "simhash-others")
    second = stored(others.groupBy("key").agg(F.min(F.struct("b", "root")).alias("s")).select("key", "s.b", F.col("s.root").alias("other")), "simhash-seconds")
    return _ordered(_grouped(hits, comp).join(second, "key").where("root <> other").select(F.col("doc").alias("a"), "b"))


def across_groups(members: DataFrame, hits: DataFrame, comp: DataFrame, texts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): each text that looks a value up, with every text of that value in another group whose whole fingerprint differs in at most `distance` bits.

    Groups meet before their texts do, so that texts of one group, however large, are never paired.
    """
    names = [n for n in texts.columns if n not in ("content", "doc")]
    # The groups that meet under a value: those without another group leave before their texts are named.
    a, b = _grouped(hits, comp), _grouped(members, comp).select("key", F.col("doc").alias("b"), F.col("root").alias("other"))
    met = a.select("key", "root").distinct().join(b.select("key", "other").distinct(), "key").where("root <> other")
    met = stored(met, "simhash-met")
    pairs = stored(_ordered(a.join(met, ["key", "root"]).join(b, ["key", "other"]).select(F.col("doc").alias("a"), "b")), "simhash-across")
    x, y = (texts.select(F.col("doc").alias(side), *(F.col(n).alias(f"{side}_{n}") for n in names)) for side in "ab")
    bits = reduce(add, (F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names))
    return pairs.join(x, "a").join(y, "b").where(bits <= distance).select("a", "b")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, shingles, f0, f1, ...) of the documents named in ids (doc_id): sorted distinct hashes of shingles, 8 bytes each, and the long fingerprint.

    Of rows that repeat a doc_id the one with the least shingles counts.
    """
    names = _longs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(*flat(b.column(1)), _NOT_SPACE)
                grams, whole = w.grams(words)
                out: list[list] = [[] for _ in range(1 + len(names))]
                for k in range(b.num_rows):
                    part = slice(w.first[k], w.first[k + 1])
                    g = grams[part][whole[part]]
                    if not len(g):  # fewer words than a shingle has: the whole sequence
                        g = np.array([mix(np.append(w.hash[part], np.uint64(7))).sum(dtype=np.uint64)])
                    out[0].append(np.unique(g).tobytes())
                    for c, f in zip(out[1:], _long_fingerprint(w.hash[part], len(names))):
                        c.append(f)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.binary()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[1:])], ["doc_id", "shingles", *names])

    # Ids grow with the corpus: they are never broadcast, at any size.
    rows = docs.select("doc_id", "text").join(ids.distinct().hint("merge"), "doc_id")
    sets = mapped(rows, run, ", ".join(["doc_id bigint, shingles binary", *(f"{n} bigint" for n in names)]))
    return sets.groupBy("doc_id").agg(F.min(F.struct("shingles", *names)).alias("s")).select("doc_id", "s.*")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float, distance: int = DISTANCE) -> DataFrame:
    """The pairs (a, b) whose complete fingerprints differ in at most `distance` bits and whose shingle sets have at least the given Jaccard similarity."""
    names = _longs()
    x, y = (sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"{side}_set"), *(F.col(n).alias(f"{side}_{n}") for n in names)) for side in "ab")
    bits = reduce(add, (F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(x, "a").join(y, "b").where(bits <= distance).select("a", "b", "a_set", "b_set")
    return mapped(rows, run, "a bigint, b bigint")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, group_id) of every document with a doc_id: near copies have one group, named by its smallest doc_id.

    Texts that some segment of the long fingerprint places within one bit, and the whole of it within `DISTANCE`, are compared by
    their sets of shingles of `words` words, and linked from `similarity` on. Each text is compared with the first text of
    every segment value that it looks up, and in further rounds with the first one that no group joins with that first, so that
    groups of any size form without the square of their texts. A last round compares all texts that still stand in different groups, so
    that no link between two groups is left out. Texts whose words are the
    same, whatever their white space and case, are one. Rows that repeat a doc_id are compared by one of their texts.
    """
    docs = docs.where("doc_id is not null")
    found = stored(long_fingerprints(docs), "simhash-long")
    names = _longs()
    texts = stored(found.groupBy("content", *names).agg(F.min("doc_id").alias("doc")), "simhash-texts")
    members, hits = looked_up(texts)
    sets, comp, tested = None, None, None
    for k in range(rounds + 1):
        pairs = against_first(members, hits, comp) if k < rounds else across_groups(members, hits, comp, texts)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"simhash-pairs-{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if sets is None:
            sets = stored(shingle_sets(docs, hits.select(F.col("doc").alias("doc_id")).union(members.select("doc")), words), "simhash-sets")
        new = stored(similar(pairs, sets, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")), f"simhash-joined-{k}")
        comp = merged(comp, new, "simhash-groups")
    release(sets, members, hits)
    first = texts.select(F.col("content").alias("_content"), *(F.col(v).alias(f"_{v}") for v in names), F.col("doc").alias("first"))
    # One long is the key; that the fingerprints agree too is tested on the rows it brings together.
    equal = reduce(and_, (F.col(v).bitwiseXOR(F.col(f"_{v}")) == 0 for v in names), F.col("content") == F.col("_content"))
    rows = found.join(first, equal).select("doc_id", "first")
    return rows.join(comp, rows["first"] == comp["node"], "left").select("doc_id", F.coalesce("root", "first").alias("group_id"))


def keep_one(docs: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """The documents without near copies: of each component, or with `similarity` of each similar group, those with its smallest doc_id.

    Rows that repeat a doc_id stand or fall together; rows without doc_id, which can't be
    told apart, stay. All columns of docs are returned.
    """
    if similarity is None:
        kept = clusters(docs.where("doc_id is not null"), words).where("doc_id = component_id")
    else:
        kept = similar_groups(docs, words, similarity).where("doc_id = group_id")
    kept = kept.select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
