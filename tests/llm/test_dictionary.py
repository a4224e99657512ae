"""Dictionaries of distinct strings, and what is built on them, against brute force; the audit of sources against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revspark.llm import dictionary, divergence, importance, queries, sentencepieces
from revspark.llm.common import release, stored, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
NASTY = ["", None, " ", "  a", "a ", "a\x00b", "<s> </s> <unk>", "▁x ▁▁ y▁", "日本 語 text", "é" * 50, "x" * 5000, " " * 3000 + "end", "tab\tnew\nline\r\n", "🙂👍🏽   　z", "a b" * 1000]


def frame(spark, texts, ids=None, **more):
    rows = [(k if ids is None else ids[k], t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})


def test_packing():
    r = np.random.default_rng(1)
    arrays = [r.integers(-(1 << 62), 1 << 62, 500), np.zeros(0, np.uint8), r.integers(0, 1 << 30, 77).astype(np.uint32)]
    got = dictionary.unpack(dictionary.pack(*arrays), np.int64, np.uint8, np.uint32)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, got))
    strings = pa.array([b"", b"ab", b"", b"c"], pa.large_binary())
    data, sizes = dictionary.bytes_of(strings.slice(1))
    assert dictionary.strings_of(data, sizes).to_pylist() == [b"ab", b"", b"c"]


def test_remembered():
    """Values are worked out once while they are remembered, and are right after the memory was emptied."""
    asked = []
    known = dictionary.Remembered(lambda s: asked.extend(s) or [len(x) for x in s], limit=3)
    assert known([b"a", b"bb"]) == [1, 2] and known([b"bb", b"ccc"]) == [2, 3] and asked == [b"a", b"bb", b"ccc"]
    assert known([b"dddd", b"a"]) == [4, 1] and known([b"e"] * 2) == [1, 1]


@pytest.mark.parametrize("block_bytes, shards", [(1, 3), (200, 1), (1 << 24, 5)])
def test_blocks(spark, block_bytes, shards):
    """Codes and strings of the blocks give back all documents' strings in order; counts add up; strings of one kind are in one shard."""
    r = random.Random(block_bytes)
    texts = [" ".join(r.choices(["the", "a", "Zoo", "é", "x1"], k=r.randint(0, 12))) for _ in range(60)] + ["", None]
    docs = frame(spark, texts).repartition(3)
    coded = dictionary.blocks(docs, importance.words, block_bytes, shards)
    seen = defaultdict(set)
    count = Counter()
    for row in dictionary.asked(coded).collect():
        sizes, data, often = dictionary.unpack(row["payload"], np.uint32, np.uint8, np.int64)
        for s, n in zip(dictionary.strings_of(data, sizes).to_pylist(), often):
            seen[s].add(row["shard"])
            count[s] += int(n)
    want = Counter(w.encode() for t in texts for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    assert count == want and all(len(s) == 1 for s in seen.values())

    def make():
        return lambda strings, often: b"\x00".join(strings.to_pylist())

    def build(names, counts, codes, order, answers):
        flat = [s for a in answers for s in a.split(b"\x00")]
        of = [b""] * len(order)
        for place, s in zip(order, flat):
            of[place] = s
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([b" ".join(of[c] for c in codes[e - n : e]).decode() for n, e in zip(counts, ends)])], ["doc_id", "words"])

    answers = dictionary.answered(coded, make)
    got = {r["doc_id"]: r["words"] for r in dictionary.joined(coded, answers, build, "doc_id bigint, words string").collect()}
    assert got == {k: (t or "").lower() for k, t in enumerate(texts)}
    release(coded, answers)


def test_sentencepieces(spark):
    """Ids and texts are those of the library for whole texts, whatever stands in them."""
    model = sentencepieces.pieces(sentencepieces.model_path()).model
    r = random.Random(3)
    texts = NASTY + ["".join(r.choice("ab  ▁é日\n.thex") for _ in range(r.randint(0, 60))) for _ in range(300)]
    docs = frame(spark, texts + ["a b"], [*range(len(texts)), None], payload="clash", n_tokens=1, block=2)
    plain = sentencepieces.encode(docs)
    rows = sentencepieces.decode(plain).collect()
    both = {(x["doc_id"], x["ids"]): x["text"] for x in sentencepieces.encode(docs, decoded=True).collect()}
    assert len(rows) == len(texts) + 1 and both == {(x["doc_id"], x["ids"]): x["text"] for x in rows}
    for x in rows:
        text = "a b" if x["doc_id"] is None else texts[x["doc_id"]] or ""
        ids = [model.bos_id(), *model.encode(text), model.eos_id()]
        assert np.frombuffer(x["ids"], "<u4").tolist() == ids and x["n_tokens"] == len(ids) and x["text"] == model.decode(ids)
    assert sentencepieces.encode(docs.where("false")).count() == 0
    assert sentencepieces.decode(spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")).first()["text"] is None


def test_whole_texts_as_chunks(spark, monkeypatch):
    """A model whose pieces can cross markers is given whole texts by the same way."""
    own = sentencepieces.pieces(sentencepieces.model_path())
    monkeypatch.setattr(own, "separable", False)
    strings, counts = sentencepieces.whole(pa.array(["a b", None, ""]))
    assert strings.to_pylist() == [b"a b", b"", b""] and counts.tolist() == [1, 1, 1]
    assert own.ids([b"a b", b""]) == [own.model.encode("a b"), []]


def test_op13(spark):
    """The registered query over its whole table."""
    model = sentencepieces.pieces(sentencepieces.model_path()).model
    got = {x["doc_id"]: x for x in queries.op13_sentencepiece(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = [model.bos_id(), *model.encode(d["text"]), model.eos_id()]
        x = got[d["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def plain_runs(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_weights(spark, longest):
    r = random.Random(longest)
    texts = NASTY + [" ".join(r.choices(["alpha", "Beta", "gamma", "d1", "É"], k=r.randint(0, 30))) for _ in range(80)]
    goal = [" ".join(r.choices(["alpha", "omega"], k=9)), None, ""]
    docs, target = frame(spark, texts, weight=5, n_features=6), frame(spark, goal)
    own, there = (Counter(zlib.crc32(f.encode()) % 50 for t in ts for f in plain_runs(t, longest)) for ts in (texts, goal))
    s, t = sum(own.values()), sum(there.values())
    gain = [math.floor(1000 * math.log((there[b] + 1) * (s + 50) / ((own[b] + 1) * (t + 50)))) for b in range(50)]
    got = {x["doc_id"]: (x["n_features"], x["weight"]) for x in importance.weights(docs, target, longest, 50).collect()}
    for k, text in enumerate(texts):
        f = plain_runs(text, longest)
        assert got[k] == (len(f), sum(gain[zlib.crc32(x.encode()) % 50] for x in f) // max(1, len(f)))
    assert len(got) == len(texts) and importance.features_of(20, longest) == len(plain_runs("a " * 20, longest))
    assert importance.weights(docs.where("false"), target).count() == 0
    assert {x["weight"] for x in importance.weights(frame(spark, ["", None]), target.where("false")).collect()} == {0}


def test_draw(spark):
    """The highest scores have ranks from 1; ties go to the smaller id, rows without one come last, short ones are never drawn."""
    r = random.Random(2)
    rows = [(k if k % 50 else None, r.randint(15, 30), r.randint(-3, 3) * 1000) for k in range(400)] + [(7, 25, 0)] * 5
    weighed = spark.createDataFrame(rows, "doc_id long, n_features long, weight long").repartition(7)
    got = importance.drawn(weighed, 25, 9, 20).collect()

    def score(d, w):
        h = int(hashlib.sha256(f"9:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        return w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    want = sorted(((d, n, w, score(d, w)) for d, n, w in rows if n >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    taken = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in taken] == list(range(1, len(want) * 25 // 100 + 1))
    assert [(x["doc_id"], x["score"]) for x in taken] == [(d, s) for d, _, _, s in want[: len(taken)]]
    assert sorted((str(x["doc_id"]), x["score"]) for x in got) == sorted((str(d), score(d, w)) for d, _, w in rows)
    assert importance.drawn(weighed.where("false"), 25, 9, 20).count() == 0


def plain_audit(rows, least):
    """All shares of all groups, pair by pair and term by term."""
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    df = Counter((lang, t) for lang, _, w in terms for t in set(w))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    count = Counter((lang, s, t) for lang, s, w in terms for t in w if df[lang, t] >= least)
    groups = {(lang, s) for lang, s, _ in terms}
    whole = Counter()
    for (lang, _, t), n in count.items():
        whole[lang, t] += n

    def shares(n_of, lang):
        total = sum(n_of(t) for t in kept[lang])
        return {t: 1 + 10**9 * (n_of(t) + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    p = {(lang, s): shares(lambda t, lang=lang, s=s: count[lang, s, t], lang) for lang, s in groups}
    q = {lang: shares(lambda t, lang=lang: whole[lang, t], lang) for lang, _ in groups}
    out = []
    for lang, s in groups:
        pairs = [(o, sum(abs(p[lang, s][t] - p[lang, o][t]) for t in kept[lang])) for g, o in groups if g == lang and o != s]
        own = [(t, p[lang, s][t] - q[lang][t]) for t in kept[lang] if count[lang, s, t] and p[lang, s][t] > q[lang][t]]
        for part, items in (("pair", pairs), ("term", own)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= 50]
    return sorted(out)


@pytest.mark.parametrize("least, shards", [(1, 1), (2, 7), (99, 3)])
def test_audit(spark, least, shards):
    """Sources with and without terms, languages without kept terms, nulls, repeats and ties; all sums are exact."""
    r = random.Random(least)
    rows = [(" ".join(r.choices(["The", "the", "cat", "dog", "É", "zz", "9", f"w{r.randint(0, 90)}x"], k=r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "ü", None])) for _ in range(90)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("123 ...", "fr", "other"), *[("same words here", "en", "a")] * 4]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "shard": F.lit(3)})
    got = divergence.audit(docs, least, shards)
    assert sorted(tuple(x) for x in got.collect()) == plain_audit(rows, least)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    assert divergence.audit(docs.where("false"), least, shards).count() == 0


def test_audit_keeps_fifty_terms(spark, monkeypatch):
    """A task that deals its counts out more than once gives the same sums, and the fifty highest terms are those of all shards."""
    monkeypatch.setattr(divergence, "STEP", 50)
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdef", k=4)) for _ in range(200)]
    rows = [(" ".join(r.choices(vocabulary, k=60)), "en", r.choice("ab")) for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(2)
    assert sorted(tuple(x) for x in divergence.audit(docs, 1, 5).collect()) == plain_audit(rows, 1)
