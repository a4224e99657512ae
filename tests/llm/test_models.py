"""Classifiers by held-out accuracy, decontamination against a plain alignment, and the pipeline stage by stage."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from revspark.llm import decontaminate, linear, nbsvm, nnpu
from revspark.llm.common import fold, table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, tag int, ids binary"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 0.1, 1, None) for i, t in zip(ids, texts)], SCHEMA)


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


def test_features():
    f = linear.ShapeAndCharacterGrams()
    texts = ["ab cd", "", "ab cd", "x", "AB!! CD!!"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(t) for t in raw])
    rows = f(np.frombuffer(b"".join(raw), np.uint8), offs)
    alone = [f(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in raw]
    assert [sorted(x.tolist()) for x in rows] == [sorted(x.tolist()) for x in alone]
    assert len(rows[1]) == 0 and sorted(rows[0]) == sorted(rows[2]) and all(len(set(x.tolist())) == len(x) for x in rows)


def test_dual_coordinate_descent():
    """The primal objective of the result is near that of a long subgradient descent."""
    r = np.random.default_rng(0)
    rows = [np.sort(r.choice(30, 6, replace=False)) for _ in range(80)]
    truth = r.normal(size=30)
    y = np.where([truth[x].sum() + r.normal() > 0 for x in rows], 1.0, -1.0)
    ratio = np.ones(30)
    w = nbsvm.dual_coordinate_descent(rows, y, ratio, np.ones(80), epochs=200)
    x = np.zeros((80, 30))
    for k, ids in enumerate(rows):
        x[k, ids] = 1 / np.sqrt(6)

    def objective(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    v = np.zeros(30)
    for t in range(1, 20_000):
        v -= (v - x.T @ (y * (y * (x @ v) < 1))) / (t + 10)
    assert objective(w) <= objective(v) * 1.01


def test_quality(spark):
    r = random.Random(1)
    good = [words(r, 40) for _ in range(150)]
    bad = [r.choice([words(r, 40).upper().replace(" ", "!! "), words(r, 30).replace(" ", " | "), (words(r, 1) + " ") * 50]) for _ in range(60)]
    docs = frame(spark, good + bad + ["", None])
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(210) if k % 3] + [(None, 1), (3, None)], "doc_id long, label int")
    model = nbsvm.fit(docs, labels)
    rows = {x["doc_id"]: x["score"] for x in model.score(docs, "doc_id").collect()}
    held = [k for k in range(210) if k % 3 == 0]
    assert np.mean([(rows[k] >= 0.3) == (k < 150) for k in held]) > 0.97
    assert len(rows) == 212 and all(0 <= s <= 1 for s in rows.values())
    again = {x["doc_id"]: x["score"] for x in nbsvm.fit(docs.repartition(5), labels.repartition(3)).score(docs, "doc_id").collect()}
    assert again == rows


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)], [(None, 1)]])
def test_without_two_classes(spark, labels):
    docs = frame(spark, ["a b", None, "c"])
    rows = spark.createDataFrame(labels, "doc_id long, label int")
    for fit in (nbsvm.fit, nnpu.fit):
        got = fit(docs, rows).score(docs, "doc_id").collect()
        assert len(got) == 3 and all(0 <= x["score"] <= 1 for x in got)
        assert fit(docs.where("false"), rows).score(docs.where("false"), "doc_id").count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    bad_words = ["scumm", "idiott", "losser"]
    texts, y = [], []
    for k in range(600):
        t = words(r, 60).split()
        if k % 8 == 0:
            for w in r.sample(bad_words, 2):
                t.insert(r.randrange(len(t)), w)
        texts.append(" ".join(t))
        y.append(int(k % 8 == 0))
    docs = frame(spark, texts + [None])
    labels = spark.createDataFrame([(k, y[k]) for k in range(600) if k % 3], "doc_id long, label int")
    rows = {x["doc_id"]: x["score"] for x in nnpu.fit(docs, labels).score(docs, "doc_id").collect()}
    held = [k for k in range(600) if k % 3 == 0]
    assert np.mean([(rows[k] >= 0.3) == bool(y[k]) for k in held]) > 0.97


def test_conflicting_and_repeated_labels(spark):
    """A doc_id with both labels teaches nothing, a repeated row counts once, and a sample is bounded in characters."""
    r = random.Random(4)
    texts = [words(r, 20) if k % 2 else words(r, 20).upper() + " !!" for k in range(80)]
    docs = frame(spark, texts)
    pairs = [(k, k % 2) for k in range(60)]
    plain = spark.createDataFrame(pairs, "doc_id long, label int")
    noisy = spark.createDataFrame(pairs + pairs[:20] + [(70, 0), (70, 1), (71, 1), (71, 0)], "doc_id long, label int")
    twice = docs.union(docs.where("doc_id < 9"))
    for fit in (nbsvm.fit, nnpu.fit):
        want = fit(docs, plain).score(docs, "doc_id").collect()
        assert sorted(fit(twice, noisy).score(docs, "doc_id").collect()) == sorted(want)
    ids = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, tag int")
    tags, rows = linear.gather(docs, ids, linear.WordGrams(), characters=300)
    assert 2 <= len(rows) < 12 and {*tags.tolist()} == {0, 1}


def test_plain_scores(spark):
    """Scores of all documents against a scorer that works word by word, very long, empty and repeated texts among them."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels")
    long = "word scumm " * 50_000
    docs = docs.union(spark.createDataFrame([(10**6, long), (10**6, long), (10**6 + 1, ""), (10**6 + 2, None)], "doc_id long, text string"))
    texts = [(x["doc_id"], x["text"] or "") for x in docs.collect()]
    for fit, label in ((nnpu.fit, "toxic"), (nbsvm.fit, "quality")):
        model = fit(docs, labels.select("doc_id", F.col(label).alias("label")))
        got = sorted((x["doc_id"], x["score"]) for x in model.score(docs, "doc_id").collect())
        want = []
        of_word = {}
        for k, t in texts:
            data = t.encode()
            raw = np.frombuffer(data, np.uint8)
            if fit is nnpu.fit:
                tokens = set(re.findall(rb"[0-9a-z\x80-\xff]+", data.lower()))
                for w in tokens - of_word.keys():
                    of_word[w] = int(model.extract(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
                margin = sum(float(model.weights[i]) for i in {of_word[w] for w in tokens})
            else:
                ids = set(model.extract(raw, np.array([0, len(raw)]))[0].tolist())
                grams = {(int.from_bytes(data[i : i + 3]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(raw) - 2)}
                assert grams <= ids
                margin = sum(float(model.weights[i]) for i in ids) / max(sum(float(model.scales[i]) ** 2 for i in ids) ** 0.5, 1e-9) if ids else 0.0
            want.append((k, 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -40, 40)))))
        assert len(got) == len(want) and all(a == b and abs(x - y) < 1e-6 for (a, x), (b, y) in zip(got, sorted(want)))


def test_long_items(spark):
    """A passage copied out of a long item is found by its own length, however long the item is; shorter or edited beyond use, it isn't."""
    r = random.Random(6)
    item, huge = words(r, 1000).split(), words(r, 30_000).split()
    texts = [" ".join([words(r, 50), *item[k : k + 60], words(r, 50)]) for k in (0, 333, 940)] + [" ".join([words(r, 30), *huge[20_000:20_080], words(r, 30)]), words(r, 300), " ".join(item[100:120]), "", None]
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(huge)), (9, ""), (10, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.leaks(frame(spark, texts), items).collect()}
    assert set(got) == {(0, 7), (1, 7), (2, 7), (3, 8)} and got[0, 7]["item_words"] == 1000
    assert {x["doc_id"] for x in decontaminate.clean(frame(spark, texts), items).collect()} == {4, 5, 6, 7}
    for n in range(400):
        parts = decontaminate.pieces_of(n)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(b - a <= decontaminate.PIECE for a, b in parts) and all(c <= a + decontaminate.PIECE // 2 for (a, _), (c, _) in zip(parts, parts[1:]))


def test_risk_is_corrected():
    """Unlabelled positives don't drag the positive feature down, as they would if unlabelled meant negative."""
    rng = np.random.default_rng(1)
    pos = [np.array([0, 1 + rng.integers(20)]) for _ in range(100)]
    unl = [np.array([0, 1 + rng.integers(20)]) if k < 60 else np.array([21, 1 + rng.integers(20)]) for k in range(200)]
    w, b = nnpu.train(pos, unl, 0.3, 22)
    assert w[0] + b > 0 > w[21] + b


@pytest.mark.parametrize("query, column, n, out, least", [("op7_quality", "quality", 5, 0, 0.97), ("op10_toxicity", "toxic", 4, 2, 0.92)])
def test_held_out(spark, query, column, n, out, least):
    from revspark.llm.queries import QUERIES

    rows = QUERIES[query](spark, SF).collect()
    labels = {x["doc_id"]: x[column] for x in table(spark, SF, "labels").collect()}
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(x["held_out"] == (fold(x["doc_id"], n) == out) and x["predicted"] == (x["score"] >= 0.3) for x in rows)
    held = [x["predicted"] == labels[x["doc_id"]] for x in rows if x["held_out"] and x["doc_id"] in labels]
    assert np.mean(held) >= least


def plain_words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def plain_align(a, b):
    best = 0
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
        best = max(best, *row)
        prev = row
    return best


def test_align():
    r = random.Random(3)
    for _ in range(60):
        items = [[r.randint(1, 4) for _ in range(r.randint(1, 9))] for _ in range(5)]
        texts = [[r.randint(1, 4) for _ in range(r.randint(1, 14))] for _ in range(5)]
        got = decontaminate.align([np.array(x, np.uint64) for x in items], [np.array(x, np.uint64) for x in texts])
        for a, b, (score, matched, s, e) in zip(items, texts, got):
            assert score == plain_align(a, b)
            if score:
                assert 0 <= s < e <= len(b) and score == plain_align(a, b[s:e]) and matched <= e - s


def edited(r, text, every):
    w = text.split()
    for k in range(every - 1, len(w), every):
        w[k] = words(r, 1)
    return " ".join(w)


def test_leaks(spark):
    """All documents that copy an item, verbatim or edited, are found with the score of a plain alignment; no others."""
    r = random.Random(4)
    items = [words(r, r.randint(12, 40)) for _ in range(12)] + ["tiny one", ""]
    texts, want = [], {}
    for k in range(120):
        t = words(r, r.randint(0, 200)).split()
        if k % 3 == 0:
            i = r.randrange(12)
            copy = r.choice([items[i], items[i].upper(), edited(r, items[i], 6), edited(r, items[i], 5), " ".join(x for n, x in enumerate(items[i].split()) if n % 7)])
            t.insert(r.randint(0, len(t)), copy)
            want[k] = i
        texts.append(", ".join(t))
    texts += [None, "", "a Tiny one here", items[0] + " x " + items[0]]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (99, None), (None, "z")], "item_id long, text string")
    rows = decontaminate.leaks(docs, bench).collect()
    got = {(x["doc_id"], x["item_id"]): x for x in rows}
    assert len(got) == len(rows) and set(got) == {(k, i) for k, i in want.items()} | {(122, 12), (123, 0)}
    for (k, i), x in got.items():
        a, b = plain_words(items[i]), plain_words(texts[k])
        assert x["score"] == pytest.approx(plain_align(a, b) / (2 * len(a))) and x["item_words"] == len(a)
        assert plain_align(a, b[x["start_word"] : x["end_word"]]) == plain_align(a, b)
    small = decontaminate.leaks(docs, bench, block_words=30).collect()
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in small} == {k: x["score"] for k, x in got.items()}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {x["doc_id"] for x in clean.collect()} == set(range(len(texts))) - {k for k, _ in got}


@pytest.mark.parametrize("holders, n", [(1, 12), (15, 300), (30, 300), (60, 300), (300, 300)])
def test_popular_partial_copies(spark, holders, n):
    """100 of an item's 128 words, verbatim or with every sixth word changed, are found whether few or all documents hold them, and clean documents stay."""
    r = random.Random(holders)
    item = words(r, 128)
    part = " ".join(item.split()[14:114])
    texts = [f"{words(r, 60)} {part if k % 2 else edited(r, part, 6)} {words(r, 60)}" if k < holders else words(r, 220) for k in range(n)]
    items = spark.createDataFrame([(1, item), (2, words(r, 40))], "item_id long, text string")
    docs = frame(spark, texts)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, items).collect()} == {(k, 1) for k in range(holders)}
    assert {x["doc_id"] for x in decontaminate.clean(docs, items).collect()} == set(range(holders, n))


def test_passages_count_by_their_own_length(spark):
    """50 words of an item of 128, or from the middle of one of 900, are copies; 20 of them aren't. Words common everywhere, as copies hold them, are no hindrance."""
    r = random.Random(9)
    short, long = words(r, 128), " ".join(r.choices([f"c{k}" for k in range(12)], k=900))
    texts = [f"{words(r, 40)} {' '.join(t.split()[s : s + m])} {words(r, 40)}" for t, s, m in ((short, 30, 50), (long, 425, 50), (short, 5, 20), (long, 100, 20))]
    texts += [f"{words(r, 30)} {' '.join(r.choices([f'c{k}' for k in range(12)], k=40))}" for _ in range(30)]
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(frame(spark, texts), items).collect()} == {(0, 1), (1, 2)}


def test_leak_edges(spark):
    docs = frame(spark, ["one two three four five"] * 3, [None, 1, 1])
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert decontaminate.leaks(docs, bench).count() == 3 and decontaminate.clean(docs, bench).count() == 0
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == 3
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0
    every = frame(spark, [f"{k} one two three four five" for k in range(200)])
    assert decontaminate.leaks(every, bench).count() == 200


def test_pipeline(spark):
    """Every stage is held against its own input, by plain versions where there are any."""
    import corpus_pipeline
    from revspark.llm.common import stored

    from .test_dedup import similarity
    from .test_scans import plain_spans

    docs = table(spark, SF, "documents").union(spark.createDataFrame([(10**9, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    names = docs.columns
    rows = {x["doc_id"]: x for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        now = docs.collect()
        if name == "packing":
            assert {x["doc_id"] for x in now} == set(rows)
            break
        assert docs.columns == names
        out = {x["doc_id"]: x for x in now}
        assert len(out) == len(now) and set(out) <= set(rows)
        gone = set(rows) - set(out)
        if name == "quality":
            labels = {x["doc_id"]: x["quality"] for x in table(spark, SF, "labels").collect()}
            assert not [k for k in gone if labels.get(k) == 1] and not [k for k in out if labels.get(k) == 0]
        elif name == "simhash_dedup":
            texts = {" ".join((x["text"] or "").split()) for x in rows.values()}
            assert {" ".join((x["text"] or "").split()) for x in out.values()} <= texts
            for k in gone:  # each has a near copy with a smaller id
                assert any(similarity(rows[k]["text"], rows[j]["text"]) >= 0.8 for j in rows if j != k)
            kept = [" ".join((x["text"] or "").lower().split()) for x in out.values()]
            assert len(kept) == len(set(kept))
        elif name == "decontamination":
            items = [" ".join(plain_words(x["text"])) for x in table(spark, SF, "benchmark").collect()]
            hold = {k for k, x in rows.items() if any(f" {i} " in f" {' '.join(plain_words(x['text']))} " for i in items)}
            assert hold == gone
        elif name == "personal_data":
            assert not gone
            for k, x in out.items():
                assert x["text"] is None or not plain_spans(x["text"])
                assert rows[k]["text"] == x["text"] or "<" in x["text"]
        rows = out
    assert corpus_pipeline.run(spark, SF).where(F.col("offset") == 0).count() > 0


def test_pipeline_edges(spark):
    """Empty tables, nulls, repeated rows and further columns with the stages' own names pass through every stage."""
    import corpus_pipeline
    from revspark.llm.common import stored

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    odd = docs.limit(5).union(spark.createDataFrame([(None, None, None, None, None), (None, "x", None, None, 1), (7, "", None, None, 0), (7, None, None, None, 0)], docs.schema))
    odd = odd.withColumns({"score": F.lit(1), "fp": F.lit("a"), "spans": F.lit(2), "_text": F.lit(3), "group_id": F.lit(4)})
    for df, n in ((odd.where("false"), 0), (odd, 9)):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, "/root/testdata/sf0.001"), f"edge-{name}")
            if name != "packing":
                assert now.columns == df.columns and (now.count() == 0 if n == 0 else now.where("doc_id is null").count() == 2)
        assert (now.count() > 0) == (n > 0)
