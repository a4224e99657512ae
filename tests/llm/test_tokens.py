"""Packing, training order and audio: exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from revspark.llm import packing, telephony, tokens, training_order
from revspark.llm.common import stored

SCHEMA = "doc_id long, text string, piece string, length string, media binary, slot int"
ODD = ["", None, "a", "<|endoftext|> x", "日本語 🙂", " ", "\n\n  x\t", "é ﬀ Ⅷ ½   \u0085z", "'s 'S it's", "1234567 12.5"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "p", "l", None, 1) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def texts(n=60, seed=1):
    r = random.Random(seed)
    return ODD + [" ".join(r.choice(["the", "Ouè", "x1", "\n", "thwhand", "!!", "ß"]) for _ in range(r.choice([3, 50, 400, 1500]))) for _ in range(n)]


def test_encoder(library):
    e = tokens.encoder(tokens.vocabulary_path())
    r = random.Random(4)
    pool = "ab éß日🙂́  ​ \x1c\x85\t\n 12½Ⅷ.'!_-"
    for t in [x for x in ODD if x is not None] + ["".join(r.choices(pool, k=r.randint(0, 30))) for _ in range(3000)]:
        assert e.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.fixture(scope="module")
def extreme():
    """Texts on which the fast path gives up or may be slow, and a random walk through all of Unicode."""
    r = random.Random(9)
    sweep = "".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(200_000))
    return [" " * 2_000_000, "a" * 1_000_000, "x" + "\n" * 1_200_000 + "y", sweep, "the end"]


def test_extreme_texts(spark, library, extreme):
    """Every text is encoded as the library encodes it, whatever its length."""
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in extreme]
    docs = frame(spark, extreme)
    found = packing.pieces(docs, with_ids=True).collect()
    rows = training_order.read(training_order.written(docs, key=1)).collect()
    for got, kind in ((found, "<u4"), (rows, "<u2")):
        for k, ids in enumerate(want):
            parts = sorted((x["piece"], bytes(x["ids"])) for x in got if x["doc_id"] == k)
            assert np.frombuffer(b"".join(p for _, p in parts), kind).tolist() == ids


def test_pieces(spark, library):
    docs = texts()
    want = {}
    for k, t in enumerate(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        bounds = [0] + list(range(head, len(ids) + 1, 1024)) if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[k, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    got = {(x["doc_id"], x["piece"]): (x["start"], x["length"], x["ids_crc32"]) for x in packing.pieces(frame(spark, docs)).collect()}
    assert got == want


@pytest.mark.parametrize("per", [100_000, 20])
def test_packing(spark, per):
    docs = texts(120)
    found = packing.pieces(frame(spark, docs), with_ids=True)
    placed = packing.pack(found, partition_rows=per)
    rows = placed.collect()
    assert len(rows) == found.count()
    bins = defaultdict(list)
    for x in rows:
        bins[x["sequence_id"]].append((x["offset"], x["length"], x["ids"]))
    for parts in bins.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(np.array([x["length"] for x in rows]))
    assert bound <= len(bins) <= bound + 1 + len(rows) // per
    whole = {x["sequence_id"]: (bytes(x["ids"]), x["n"]) for x in packing.sequences(placed).collect()}
    assert whole == {s: (b"".join(bytes(i) for _, _, i in sorted(p)), sum(n for _, n, _ in p)) for s, p in bins.items()}


def test_packing_edges(spark):
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0
    same = packing.pack(packing.pieces(frame(spark, ["a b"] * 30, [7] * 15 + [None] * 15)), partition_rows=10).collect()
    assert len(same) == 30


def test_bounds():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([10, 17, 64])
        lengths = np.array([r.randint(1, cap) for _ in range(r.randint(0, 9))], int)
        for pack in (packing.tightest_fill, packing.best_fit_decreasing):
            bins, offsets, left = pack(lengths, cap)
            load = np.bincount(bins, weights=lengths, minlength=len(left)) if len(left) else np.zeros(0)
            assert (load <= cap).all() and (cap - load == left).all()
            for b in range(len(left)):
                inside = sorted(zip(offsets[bins == b], lengths[bins == b]))
                assert [o for o, _ in inside] == [0, *np.cumsum([n for _, n in inside])[:-1]]

        def optimum(rest, open_bins):
            if not rest:
                return len(open_bins)
            best = 99
            for k in {x: i for i, x in enumerate(open_bins) if x >= rest[0]}.values():
                best = min(best, optimum(rest[1:], open_bins[:k] + [open_bins[k] - rest[0]] + open_bins[k + 1 :]))
            return min(best, optimum(rest[1:], [*open_bins, cap - rest[0]]))

        if len(lengths) <= 6:
            best = optimum(sorted(lengths.tolist(), reverse=True), [])
            assert packing.lower_bound(lengths, cap) <= best <= len(left)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 255, 1000, 65_537])
def test_permutation(n):
    for key in (0, 1, 2**63):
        p = training_order.Permutation(n, key)
        x = np.arange(n)
        s = p.slot(x)
        assert sorted(s.tolist()) == x.tolist() and (p.index(s) == x).all()
    if n > 100:
        a, b = (training_order.Permutation(n, k).slot(np.arange(n)) for k in (1, 2))
        assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.2


def test_training_order(spark, library, tmp_path):
    docs = texts(50)
    made = training_order.written(frame(spark, docs).repartition(3), key=5, length=64, shard_slots=32)
    rows = training_order.read(made, shard_slots=32).collect()
    assert sorted(x["slot"] for x in rows) == list(range(len(rows)))
    got = defaultdict(dict)
    for x in rows:
        got[x["doc_id"]][x["piece"]] = np.frombuffer(x["ids"], "<u2").tolist()
        assert x["shard"] == x["slot"] // 32 and x["byte_offset"] == x["slot"] % 32 * (16 + 128) and x["ids_crc32"] == zlib.crc32(x["ids"]) and x["length"] * 2 == len(x["ids"])
    for k, t in enumerate(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert sum((got[k][p] for p in sorted(got[k])), []) == ids
    later = training_order.read(made, start=40, shard_slots=32).collect()
    assert sorted(x["slot"] for x in later) == list(range(40, len(rows)))
    files = [sorted(x["shard"] for x in g) for _, g in groupby(made.select("shard", F.col("_metadata.file_name").alias("f")).orderBy("f").collect(), lambda x: x["f"])]
    assert sum(files, []) == list(range(-(-len(rows) // 32)))  # a file holds a range of shards, in order
    for n in (1, 5):  # another layout, the same shards
        again = training_order.written(frame(spark, docs[::-1], range(len(docs) - 1, -1, -1)).repartition(n), key=5, length=64, shard_slots=32)
        assert sorted(again.collect()) == sorted(made.collect())
    files = training_order.export(made, str(tmp_path)).collect()
    by_slot = {x["slot"]: x for x in rows}
    for f in files:
        raw = open(f["file"], "rb").read()
        assert len(raw) % 144 == 0
        head = np.frombuffer(raw[144:160], training_order.HEADER)[0] if len(raw) > 144 else None
        if head is not None:
            assert head["doc_id"] == by_slot[f["shard"] * 32 + 1]["doc_id"]


def test_training_order_moves_little(spark, monkeypatch):
    """Large stored tokens aren't shuffled to be numbered, and a file of shards is read a few shards at a time."""
    monkeypatch.setattr("revspark.plans.store.BROADCAST_BYTES", 0)
    tokens = training_order.stored(training_order.token_sequences(frame(spark, texts(9))), "t")
    plan = training_order.numbered(tokens)[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    made = training_order.written(frame(spark, texts(50)).coalesce(1), key=5, length=8, shard_slots=4, file_shards=32)
    found = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made.inputFiles()]
    assert max(m.num_rows for m in found) > 4 and all(m.row_group(k).num_rows <= 4 for m in found for k in range(m.num_row_groups))


def test_training_edges(spark):
    assert training_order.shards(frame(spark, []), key=1).count() == 0
    rows = training_order.read(training_order.written(frame(spark, ["a", "a"], [None, None]), key=1)).collect()
    assert [(x["doc_id"], x["slot"]) for x in sorted(rows, key=lambda x: x["slot"])] == [(-1, 0), (-1, 1)]


def scalar_adpcm(block):
    value, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = step >> 3
            if code & 4:
                diff += step
            if code & 2:
                diff += step >> 1
            if code & 1:
                diff += step >> 2
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm():
    r = np.random.default_rng(1)
    blocks = r.integers(0, 256, (37, 24)).astype(np.uint8)
    assert telephony.expand_adpcm(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]


def scalar_mulaw(u):
    u = ~u & 255
    t = ((u & 15) * 8 + 132) * 2 ** (u >> 4 & 7)
    return 132 - t if u & 128 else t - 132


def scalar_alaw(a):
    a ^= 0x55
    t, seg = (a & 15) * 16, a >> 4 & 7
    t = t + 8 if seg == 0 else (t + 264) * 2 ** (seg - 1)
    return t if a & 128 else -t


def test_companding():
    assert telephony.EXPAND[telephony.MULAW].tolist() == [scalar_mulaw(k) for k in range(256)]
    assert telephony.EXPAND[telephony.ALAW].tolist() == [scalar_alaw(k) for k in range(256)]
    assert telephony.EXPAND[telephony.MULAW][[0, 255]].tolist() == [-32124, 0] and telephony.EXPAND[telephony.ALAW][[0x55, 0xD5]].tolist() == [-8, 8]


def test_double_rate():
    x = np.array([0, 100, 200, 300, 400, 500], np.int16)
    y = telephony.double_rate(x)
    assert y[::2].tolist() == x.tolist() and y[3] == 150 and y[5] == 250
    assert telephony.double_rate(np.zeros(0, np.int16)).tolist() == []


def test_audio(spark):
    docs = texts(40) + ["z" * 100_000, "a"]
    decoded = stored(telephony.decode(stored(telephony.encode(frame(spark, docs)), "test-media")), "test-pcm")
    rows = {x["doc_id"]: x for x in decoded.collect()}
    feature = {k: x["feature"] for k, x in rows.items()}
    media = {x["doc_id"]: bytes(x["media"]) for x in telephony.encode(frame(spark, docs)).collect()}
    seen = set()
    for k, t in enumerate(docs):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        x = rows[k]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(media[k]), hashlib.sha256(media[k]).hexdigest())
        tag, rate, align, data = telephony.parse(media[k])
        seen.add(tag)
        assert telephony.codes(tag, align, data) == payload and rate == 8000
        if tag == telephony.ADPCM:
            pcm = np.array([v for b in data.reshape(-1, align)[:3] for v in scalar_adpcm(b.tobytes())], np.int16)
        else:
            pcm = np.array([(scalar_mulaw if tag == telephony.MULAW else scalar_alaw)(v) for v in data[:600].tolist()], np.int16)
        got = np.frombuffer(x["pcm"], np.int16)
        wide = got.astype(object)
        assert f"samples={len(got)};peak={max(abs(wide))};power={sum(wide * wide) // len(got)};" in feature[k] and f"codec={telephony.NAMES[tag]};rate=16000" in feature[k] and f"crc={zlib.crc32(x['pcm']):08x}" in feature[k]
        assert got[::2][: len(pcm)].tolist() == pcm.tolist()
    assert seen == set(telephony.NAMES) and feature[2] == feature[len(docs) - 1]
    assert telephony.decode(telephony.encode(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        telephony.parse(b"not audio")
