"""SimHash and passage deduplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from revspark.llm import passages, simhash
from revspark.llm import common
from revspark.llm.common import components

SCHEMA = "doc_id long, text string, fp string, component_id int, key string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 7, "k") for i, t in zip(ids, texts)], SCHEMA)


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(grams))


def plain_components(ids, fps, radius=2):
    parent = dict.fromkeys(ids)
    root = {i: i for i in parent}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def sentences(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(n))


def near_copies(r, n):
    base = sentences(r, 300).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = sentences(r, 1)
        out.append(" ".join(w))
    return out


TEXTS = ["", None, "   ", "a", "A", "a b", "Ünï cödé ÀÉ", "a b c d", "a\x1cb c\x85d e", "one two three four", "one  two\tthree\nfour"]


def test_fingerprints(spark):
    r = random.Random(1)
    texts = TEXTS + [sentences(r, r.randint(1, 80)) for _ in range(60)] + [" ".join(["w"] * 70_000)]
    got = {x["doc_id"]: x["fp"] % (1 << 64) for x in simhash.fingerprints(frame(spark, texts)).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in enumerate(texts)}


def test_clusters(spark):
    r = random.Random(2)
    texts = TEXTS + near_copies(r, 60) + near_copies(r, 40) + [sentences(r, 40) for _ in range(40)]
    texts += texts[30:40]
    got = {x["doc_id"]: x["component_id"] for x in simhash.clusters(frame(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert got == plain_components(list(range(len(texts))), fps)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_in_large_buckets(spark, bucket):
    """Fingerprints that share halves, so that tables overflow: components stay exact."""
    r = random.Random(bucket)
    fps = set()
    for _ in range(6):
        seed = r.getrandbits(64)
        for _ in range(30):
            x = seed
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) | 1, 1 << 32, 1 << 31}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(rows, bucket=bucket)
    found = {(x["u"] % (1 << 64), x["v"] % (1 << 64)) for x in links.collect()}
    if bucket == 64:
        assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    comp = {x["node"] % (1 << 64): x["root"] for x in components(links).collect()}
    want = plain_components(fps, fps)
    assert len({frozenset(k for k in fps if want[k] == v) for v in want.values()} ^ {frozenset([k for k in fps if comp.get(k, ("own", k)) == c]) for c in {comp.get(k, ("own", k)) for k in fps}}) == 0


def test_hot_links_are_linear(spark):
    """A group of many near copies makes links in proportion to its size, not to its square."""
    r = random.Random(4)
    rows = spark.createDataFrame([(x,) for x in {r.getrandbits(12) for _ in range(4000)}], "fp long")
    n = rows.count()
    assert simhash.links(rows).count() < 90 * n


def test_cluster_edges(spark):
    empty = frame(spark, [])
    assert simhash.clusters(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    same = frame(spark, ["t t t"] * 50, [5] * 25 + list(range(10, 35)))
    got = simhash.clusters(same).collect()
    assert len(got) == 50 and {x["component_id"] for x in got} == {5}
    kept = simhash.keep_one(frame(spark, ["a b c", "a b c", "d e f", None, "a b c"], [3, 2, 9, None, None]))
    assert kept.columns == ["doc_id", "text", "fp", "component_id", "key"]
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in kept.collect()) == [(-1, ""), (-1, "a b c"), (2, "a b c"), (9, "d e f")]


def test_clusters_are_not_broadcast(spark, monkeypatch):
    """Stored tables of more than BROADCAST_BYTES, here of any size, never go through the driver."""
    monkeypatch.setattr("revspark.plans.store.BROADCAST_BYTES", 0, raising=False)
    found = simhash.clusters(frame(spark, ["t t t", "t t t", "a b c d", None]))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x["doc_id"]: x["component_id"] for x in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5400)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars already are written once and not worked on; a chain is."""
    made = []
    monkeypatch.setattr(common, "stored", lambda df, what, **more: made.append(what) or df)
    star = spark.createDataFrame([(9, k) for k in (5, 3)] + [(k, 20) for k in range(21, 40)], "u long, v long")
    got = {x["node"]: x["root"] for x in components(star.where("u >= 20")).collect()}
    assert made == ["cc"] and got == dict.fromkeys(range(20, 40), 20)
    got = {x["node"]: x["root"] for x in components(star.where("u < 20")).collect()}
    assert len(made) > 2 and got == {3: 3, 5: 3, 9: 3}


def test_merged(spark):
    """Further edges join the groups that there are; without any that do, the groups aren't worked on again."""
    r = random.Random(10)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(180)]

    def frame_of(part):
        return spark.createDataFrame(part, "u long, v long")

    comp = common.merged(None, frame_of(edges[:90]))
    for part in (edges[90:140], edges[140:]):
        comp = common.merged(comp, frame_of(part))
    want = {x["node"]: x["root"] for x in components(frame_of(edges)).collect()}
    rows = comp.collect()
    assert len(rows) == len(want) and {x["node"]: x["root"] for x in rows} == want
    assert common.merged(comp, frame_of(edges[::3])) is comp


def naive_windows(v, least):
    out = []
    for c in range(len(v)):
        if v[c] == 0:
            continue
        left = right = c
        while left > 0 and v[left - 1] > v[c]:
            left -= 1
        while right + 1 < len(v) and v[right + 1] >= v[c]:
            right += 1
        if right - left + 1 >= least:
            out.append((left, c, right))
    return out


@pytest.mark.parametrize("least", [1, 2, 5, 13])
def test_compact_windows(least):
    r = np.random.default_rng(least)
    for _ in range(60):
        v = r.integers(0, r.integers(2, 60), r.integers(0, 120)).astype(np.uint64)
        got = list(zip(*(x.tolist() for x in passages.compact_windows(v, least))))
        assert got == naive_windows(v.tolist(), least)


def plain_words(text):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def test_exact_passages(spark):
    """Every passage of 50 words that two documents share is found, and nothing in documents without one."""
    r = random.Random(7)
    shared = [sentences(r, 60) for _ in range(4)]
    texts = []
    for k in range(80):
        parts = [sentences(r, r.randint(0, 150))]
        if k % 2:
            parts += [r.choice(shared).upper(), sentences(r, r.randint(0, 80))]
        if k % 7 == 0:
            parts.insert(0, " ".join(shared[0].split()[5:40]))
        texts.append(". ".join(parts))
    texts += [texts[0], "", None, " ".join(["a"] * 400), "short " * 20]
    got = {x["doc_id"]: x for x in passages.classes(passages.near_duplicates(frame(spark, texts))).collect()}
    where = defaultdict(set)
    for k, t in enumerate(texts):
        w = plain_words(t)
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    groups = [s for s in where.values() if len(s) > 1]
    assert set(got) == set().union(*groups)
    for s in groups:
        assert len({got[k]["class_id"] for k in s}) == 1
    for k, x in got.items():
        spans = [tuple(map(int, p.split("-"))) for p in x["spans"].split(",")]
        assert x["n_words"] == sum(b - a for a, b in spans) and all(0 <= a < b <= len(plain_words(texts[k])) and b - a >= 50 for a, b in spans)


def test_edited_passages(spark):
    """Passages with one word in sixty replaced keep a similarity over 0.8 and are found; with one in ten they aren't."""
    r = random.Random(8)
    texts, close = [], set()
    for k in range(30):
        p = sentences(r, 240).split()
        q = list(p)
        step = 60 if k % 2 else 10
        for i in range(7, len(q), step):
            q[i] = "EDITED" + sentences(r, 1)
        texts += [" ".join([sentences(r, 100), *p]), " ".join([*q, sentences(r, 100)])]
        if k % 2:
            close |= {2 * k, 2 * k + 1}
    got = {x["doc_id"] for x in passages.classes(passages.near_duplicates(frame(spark, texts))).collect()}
    assert got <= close and len(got) >= 0.9 * len(close)


def edited(r, words, n):
    """n words replaced, left out or put in, anywhere."""
    out = list(words)
    for _ in range(n):
        k = r.randrange(len(out))
        out[k : k + 1] = r.choice([["x" + sentences(r, 1)], [], [out[k], "y" + sentences(r, 1)]])
    return out


def word_grams(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def holds_copy(a, b, least=50, similarity=0.8):
    """Brute force: whether some passage of words a and some of b, `least` words or more each, are similar enough."""
    x, y = plain_words(a), plain_words(b)
    for i in range(0, len(x) - least + 1):
        for n in range(least, min(len(x) - i, 3 * least) + 1, 5):
            s = word_grams(x[i : i + n])
            for j in range(max(0, i - 3), min(len(y) - least, i + 3) + 1):
                t = word_grams(y[j : j + n])
                if len(s & t) >= similarity * len(s | t):
                    return True
    return False


def test_edited_passages_of_all_lengths(spark):
    """Of passages of 50 to 200 words with a similarity of 0.8 to 0.95, edits anywhere, nine in ten are found; texts without any are left alone."""
    r = random.Random(21)
    texts, want, band = [], set(), []
    for k in range(220):
        p = sentences(r, r.choice([50, 55, 60, 70, 80, 90, 120, 150, 200])).split()
        q = edited(r, p, r.randint(1, 1 + len(p) // 60))
        s, t = word_grams(p), word_grams(q)
        share = len(s & t) / len(s | t)
        texts += [" ".join([sentences(r, 40), *p, sentences(r, 40)]), " ".join([sentences(r, 70), *q, sentences(r, 20)])]
        if share >= 0.8 and len(q) >= 50:
            want.add((2 * k, 2 * k + 1))
            band.append(share)
    got = {x["doc_id"]: x["class_id"] for x in passages.classes(passages.near_duplicates(frame(spark, texts))).collect()}
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in want)
    assert len(want) > 120 and min(band) < 0.82 and found >= 0.9 * len(want)
    assert all(got[k] == min(k, k ^ 1) for k in got)


def test_segments():
    """One word replaced in the middle leaves a similarity over 0.8 from 50 words on; brute force agrees on whole texts."""
    r = random.Random(22)
    for n in range(50, 130, 5):
        p = sentences(r, n).split()
        q = p[: n // 2] + ["zzz"] + p[n // 2 + 1 :]
        ids = {}
        a, b = (np.array([ids.setdefault(tuple(w[k : k + 5]), len(ids)) for k in range(n - 4)], "<u4") for w in (p, q))
        found = passages.segments(a, b, 46, 0.8)
        assert len(found) == 1 and found[0][:4] == (0, n - 4, 0, n - 4)
    few, many = np.array([1] * 50 + [2, 3] * 20 + [1] * 70, "<u4"), np.array([9, 8, 7, 6, 5, 4, 1, 2, 3] * 30 + [1] * 60, "<u4")
    assert passages.segments(few, many, 46, 0.8) and passages.segments(many, few, 46, 0.8)
    r = random.Random(23)
    for _ in range(25):
        p = sentences(r, r.randint(40, 75)).split()
        q = edited(r, p, r.randint(0, 4))
        ids = {}
        a, b = (np.array([ids.setdefault(tuple(w[k : k + 5]), len(ids)) for k in range(max(0, len(w) - 4))], "<u4") for w in (p, q))
        if holds_copy(" ".join(p), " ".join(q)):
            assert passages.segments(a, b, 46, 0.8)
    for _ in range(200):
        hit = np.array([r.random() < 0.85 for _ in range(r.randint(0, 60))], bool)
        for s, e in passages._stretches(hit, 3.0, 5):
            assert hit[s] and hit[e - 1] and e - s >= 5 and hit[s:e].sum() >= 3 * (~hit[s:e]).sum() - 3 * 5


def test_hot_passage(spark):
    """A passage in every document gives links in proportion to the documents."""
    r = random.Random(6)
    hot = sentences(r, 70)
    texts = [f"{sentences(r, 60)} {hot} {sentences(r, 60)}" for _ in range(300)]
    links = passages.near_duplicates(frame(spark, texts))
    assert links.count() <= 2 * len(texts)
    got = passages.classes(links).collect()
    assert len(got) == 300 and {x["class_id"] for x in got} == {0}


def test_passage_of_a_covered_document(spark):
    """A passage shared with whole copies is found though smaller documents hold fragments of all of it."""
    r = random.Random(14)
    whole = sentences(r, 300).split()
    fragments = [sentences(r, 60).split() + whole[k : k + 40] + sentences(r, 60).split() for k in range(90, 190, 10)]
    mine = whole[110:170]
    texts = [" ".join(w) for w in fragments + [whole, whole, sentences(r, 60).split() + mine + sentences(r, 60).split()]]
    got = {x["doc_id"]: x["class_id"] for x in passages.classes(passages.near_duplicates(frame(spark, texts))).collect()}
    n = len(fragments)
    assert got == {n: n, n + 1: n, n + 2: n}


def test_passage_edges(spark):
    assert passages.classes(passages.near_duplicates(frame(spark, []))).count() == 0
    r = random.Random(3)
    t = sentences(r, 90)
    got = passages.classes(passages.near_duplicates(frame(spark, [t, t, t], [4, None, 4])))
    assert got.count() == 0
    assert passages.segments(np.zeros(0, "<u4"), np.arange(9, dtype="<u4"), 3, 0.8) == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similar_groups(spark):
    """Nothing under a similarity of 0.8 is grouped, and nearly all texts with one word in sixty replaced are."""
    r = random.Random(11)
    texts = ["", None, " \t", "one", "ONE", "two words", "two  WORDS"]
    pairs = []
    for k in range(60):
        p = sentences(r, r.randint(120, 500)).split()
        q = list(p)
        for i in range(r.randrange(60), len(q), 60 if k % 2 else 12):
            q[i] = "edited" + sentences(r, 1)
        if k % 2:
            pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(p), " ".join(q)]
    texts += [texts[20].upper(), texts[21]]
    got = {x["doc_id"]: x["group_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and got[1] == got[2] == 0 and got[4] == 3 and got[6] == 5 and got[len(texts) - 2] == got[20] and got[len(texts) - 1] == got[21]
    groups = defaultdict(list)
    for k, g in got.items():
        groups[g].append(k)
    for members in groups.values():
        assert len(members) == 1 or all(any(similarity(texts[a], texts[b]) >= 0.8 for b in members if b != a) for a in members)
        assert min(members) == got[members[0]]
    close = [(a, b) for a, b in pairs if similarity(texts[a], texts[b]) >= 0.8]
    assert len(close) > 20 and sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close)
    kept = {x["doc_id"] for x in simhash.keep_one(frame(spark, texts), words=5, similarity=0.8).collect()}
    assert kept == set(got.values())


def test_similar_recall_of_all_degrees(spark):
    """Against brute force over all pairs: of pairs from 0.8 on, down to its edge, nine in ten are grouped; no text without a partner is."""
    r = random.Random(31)
    texts = []
    for _ in range(60):
        p = sentences(r, r.choice([60, 100, 200, 400, 900])).split()
        texts += [" ".join(p)] + [" ".join(edited(r, p, r.randint(1, 1 + len(p) // 40))) for _ in range(3)]
    texts += [sentences(r, r.randint(5, 300)) for _ in range(60)]
    sets = [shingles(t) for t in texts]
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] & sets[b]}
    close = [p for p, x in share.items() if x >= 0.8]
    assert len(close) > 60 and min(share[p] for p in close) < 0.81
    got = {x["doc_id"]: x["group_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    partner = {k for p in close for k in p}
    assert all(k in partner for k, g in got.items() if g != k)


def test_similar_group_of_many(spark):
    """A group of hundreds of near copies becomes one group with comparisons in proportion to its size."""
    r = random.Random(12)
    texts = near_copies(r, 400)
    docs = frame(spark, texts)
    found = simhash.long_fingerprints(docs).withColumnRenamed("doc_id", "doc")
    assert simhash.against_first(*simhash.looked_up(found), None).count() < 60 * len(texts)
    assert {x["group_id"] for x in simhash.similar_groups(docs).collect()} == {0}
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_similar_behind_a_representative(spark, monkeypatch):
    """Near copies are compared though a dissimilar text is the first of every value that they share."""
    r = random.Random(13)
    texts, rows = [], []
    for k in range(30):  # a text unlike the others, and two near copies behind it
        near = sentences(r, 80)
        texts += [sentences(r, 80), near, near + " end"]
        print_of = [r.getrandbits(62) for _ in range(5)]
        rows += [(3 * k + i, 100 * k + i, print_of[0] ^ i, *print_of[1:]) for i in range(3)]
    fields = ", ".join(["doc_id long", "content long", *(f"f{k} long" for k in range(5))])
    monkeypatch.setattr(simhash, "long_fingerprints", lambda docs: spark.createDataFrame(rows, fields))
    got = {x["doc_id"]: x["group_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert got == {k: k - k % 3 + min(k % 3, 1) for k in range(len(texts))}


def test_similar_behind_several_representatives(spark, monkeypatch):
    """Near copies are compared though texts of three other groups stand before them in every value that they share."""
    r = random.Random(14)
    texts, rows = [], []
    for k in range(10):
        near = sentences(r, 80)
        texts += [*(sentences(r, 80) for _ in range(3)), near, near + " end"]
        print_of = [r.getrandbits(62) for _ in range(5)]
        rows += [(5 * k + i, 100 * k + i, print_of[0] ^ i, *print_of[1:]) for i in range(5)]
    fields = ", ".join(["doc_id long", "content long", *(f"f{k} long" for k in range(5))])
    monkeypatch.setattr(simhash, "long_fingerprints", lambda docs: spark.createDataFrame(rows, fields))
    got = {x["doc_id"]: x["group_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert got == {k: k - k % 5 + min(k % 5, 3) for k in range(len(texts))}


def test_across_groups(spark):
    """Texts of one group are never paired, nor those whose fingerprints are far from each other."""
    texts = spark.createDataFrame([(k, 0, 0, 0, 0, -1 if k == 4 else 0) for k in range(5)], "doc long, f0 long, f1 long, f2 long, f3 long, f4 long")
    rows = spark.createDataFrame([(k, 9) for k in range(5)], "doc long, key long")
    comp = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "node long, root long")
    got = {tuple(p) for p in simhash.across_groups(rows, rows, comp, texts, 63).collect()}
    assert got == {(2, 0), (2, 1), (3, 0), (3, 1)}


def test_similar_edges(spark):
    """Rows that repeat an id, equal texts and null ids and texts."""
    docs = frame(spark, ["a b c d e f", "a b c d e f", "other words here", None, "", "a b c d e f"], [5, 3, 5, 9, 8, None])
    rows = sorted((x["doc_id"], x["group_id"]) for x in simhash.similar_groups(docs).collect())
    assert rows == [(3, 3), (5, 3), (5, 5), (8, 8), (9, 8)]
    kept = simhash.keep_one(docs, words=5, similarity=0.8)
    assert kept.columns == docs.columns and sorted((x["doc_id"] or -1) for x in kept.collect()) == [-1, 3, 5, 5, 8]
