"""License scans and personal data against brute force."""

import math
import random
import re

from pyspark.sql import functions as F

from revspark.llm import licenses, pii

SCHEMA = "doc_id long, text string, label string, spans int, base double"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in zip(ids, texts)], SCHEMA)


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    found = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    r = random.Random(1)
    words = "gnu general public license apache cc by mit the of Licensé 4 0 version MIT-License CC_BY x".split()
    texts = ["", None, "MIT License", "mit", "cc by cc by", "GNU General Public Licenses", "Licensed under CC BY-NC 4.0.", "Ünder the ÀPACHE license apache LICENSE"]
    texts += [r.choice([" ", ", ", "\n"]).join(r.choices(words, k=r.randint(0, 60))) for _ in range(300)]
    texts += ["x " * 50_000 + "mit license " * 300, texts[5]]
    rows = {x["doc_id"]: x for x in licenses.scan(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        x = rows[k]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == plain_license(t), t
        assert 0 <= x["score"] <= 1 and set(filter(None, x["base_labels"].split(","))) <= set(filter(None, x["labels"].split(",")))


def test_license_method(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "GNU Lesser General Public License terms", "gnu lesser and general public notice", "Licensed under the Apache License, Version 2.0.",
    ]
    rows = licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [x["labels"] for x in rows] == ["gpl,gpl-3", "bsd", "lgpl", "", "apache,apache-2.0"]
    assert rows[0]["score"] == 1.0 and rows[3]["score"] == 0.0


def plain_labels(texts, least=0.25):
    """Every place of every template by comparing word for word; labels and score of each text."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) for t in texts]
    idf = {w: math.log((len(texts) + 2) / (sum(w in x for x in split) + 1)) for t in licenses.TEMPLATES for w in t.words()}
    out = []
    for words in split:
        labels, score = set(), 0.0
        for t in licenses.TEMPLATES:
            begin, size = t.phrase_at()
            tw = t.words()
            for k in range(len(words)):
                if words[k : k + size] == tw[begin : begin + size]:
                    held = sum(idf[w] for i, w in enumerate(tw) if 0 <= k - begin + i < len(words) and words[k - begin + i] == w)
                    share = min(held / sum(idf[w] for w in tw), 1.0)
                    if t.base or share >= least:
                        labels.add(t.label)
                        score = max(score, share)
        out.append((",".join(sorted(labels)), score))
    return out


def test_license_labels(spark):
    """Labels and scores against brute force, on passages cut, joined and edited."""
    r = random.Random(5)
    texts = [""]
    for _ in range(250):
        words = []
        for _ in range(r.randint(0, 4)):
            w = r.choice(licenses.TEMPLATES).passage.split()
            a = r.randint(0, len(w) // 3)
            w = w[a : r.randint(2 * len(w) // 3, len(w))]
            if r.random() < 0.3 and w:
                w[r.randrange(len(w))] = r.choice(["other", "license", "public"])
            words += w + ["x"] * r.randint(0, 3)
        texts.append(r.choice([" ", " - ", "\n"]).join(words).title())
    rows = {x["doc_id"]: x for x in licenses.scan(frame(spark, texts)).collect()}
    want = plain_labels(texts)
    assert len({x for x, _ in want}) > 25
    for k, (labels, score) in enumerate(want):
        assert rows[k]["labels"] == labels and abs(rows[k]["score"] - score) < 1e-9


def test_license_edges(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    same = licenses.scan(frame(spark, ["mit license", "mit license"], [None, None])).collect()
    assert [(x["doc_id"], x["n_base"]) for x in same] == [(None, 1), (None, 1)]


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def random_text(r):
    parts = ["a@b.c", "x.y+z@a-b.co.uk", "_e@f.g", "@", "..", "1.2.3.4", "256.1.1.1", "007.08.9.10", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "+49 123", "é", "🙂", " ", "\n", "5", "12345678901234567", "0", "-", "a1b2c3d4", 'token = "9f8e7d6c"']
    return "".join(r.choices(parts, k=r.randint(0, 14)))


def test_spans(spark):
    r = random.Random(2)
    texts = ["", None] + [random_text(r) for _ in range(600)] + [random_text(r) * 40, "9" * 30_000, "4111111111111111 " * 500, "a" * 30_000 + "@b.c", "1." * 20_000]
    rows = {x["doc_id"]: x for x in pii.scan(frame(spark, texts), "doc_id").collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in rows[k]["base"]] == plain_spans(t), t[:200]
        mine = [tuple(s) for s in rows[k]["base"]]
        assert [tuple(s) for s in rows[k]["spans"] if not s["kind"].startswith("like_")] == mine


def test_discovery(spark):
    """Strings in a context that seeds share are found in it, and then elsewhere; others aren't."""
    seeds = [f"please write to u{k}@mail{k}.org today" for k in range(12)]
    new = ["please write to contact-777-box today", "or see contact-777-box there"]
    other = ["please read item-555-xyz today", "version 2024.10 is out"]
    rows = pii.scan(frame(spark, seeds + new + other), "doc_id").orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in x["spans"]] for x in rows]
    assert kinds == [["email"]] * 12 + [["like_email"]] * 2 + [[]] * 2
    s = rows[12]["spans"][0]
    assert new[0][s["start"] : s["end"]] == "contact-777-box"


def test_discovery_goes_on(spark):
    """Strings found in one context support a further one, spaced and bracketed numbers among them; a string of any length is found."""
    long = "k" * 200 + "7"
    seeds = [f"ring me at +44 20 7946 {k:03} please" for k in range(9)]
    new = [f"ring me at 020 7946 1{k:03} please" for k in range(6)] + [f"desk line 020 7946 1{k:03} open" for k in range(6)]
    far = ["desk line (555) 123-4567 open", f"ring me at {long} please"]
    rows = pii.scan(frame(spark, seeds + new + far + ["about 1999 people"]), "doc_id").orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in x["spans"]] for x in rows]
    assert kinds == [["phone"]] * 9 + [["like_phone"]] * 14 + [[]]
    s = rows[21]["spans"][0]
    assert far[0][s["start"] : s["end"]] == "(555) 123-4567"


def test_long_text_in_time(spark):
    """A megabyte of addresses takes time in proportion."""
    import time

    text = "u1@a.bc " * 125_000
    docs = frame(spark, [text, "x@y.zz"])
    began = time.time()
    rows = {x["doc_id"]: x for x in pii.scan(docs, "doc_id").select("doc_id", F.size("base").alias("n"), F.element_at("base", -1).alias("last")).collect()}
    assert rows[0]["n"] == 125_000 and rows[0]["last"]["end"] == len(text) - 1
    out = {x["doc_id"]: x["text"] for x in pii.redact(docs).collect()}
    assert out[0] == "<email> " * 125_000 and out[1] == "<email>"
    assert time.time() - began < 120


def test_scan_edges(spark):
    assert pii.scan(frame(spark, []), "doc_id").count() == 0
    docs = frame(spark, ["a@b.cd", "x", "a@b.cd", None], [1, 1, None, None]).selectExpr("doc_id", "text", "doc_id as candidates", "label")
    rows = pii.scan(docs, "doc_id", "candidates", "label").collect()
    assert sorted((x["doc_id"] or 0, x["candidates"] or 0, x["label"], len(x["spans"])) for x in rows) == [(0, 0, "x", 0), (0, 0, "x", 1), (1, 1, "x", 0), (1, 1, "x", 1)]


def test_redaction(spark):
    r = random.Random(3)
    texts = [random_text(r) for _ in range(200)] + [None, "", "no data"]
    docs = frame(spark, texts).withColumn("_r", F.lit(1))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {x["doc_id"]: x for x in out.collect()}
    assert len(rows) == len(texts) and rows[200]["text"] is None and rows[202]["text"] == "no data" and rows[0]["spans"] == 1
    for k, t in enumerate(texts):
        if t is None:
            continue
        merged = []
        for s, _, kind, e in plain_spans(t):
            if merged and merged[-1][2] > s:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([s, kind, e])
        want, at = "", 0
        for s, kind, e in merged:
            want, at = f"{want}{t[at:s]}<{kind}>", e
        if "like_" not in rows[k]["text"]:
            assert rows[k]["text"] == want + t[at:]
    twice = pii.redact(frame(spark, ["a@b.cd", "x", "a@b.cd"], [1, 1, None])).collect()
    assert sorted(((x["doc_id"] or 0), x["text"]) for x in twice) == [(0, "<email>"), (1, "<email>"), (1, "x")]
    assert pii.redact(frame(spark, [])).count() == 0
