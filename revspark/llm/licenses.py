"""License scans by a positional index of rare words, with DataFrame functions only.

Templates are passages of license notices, each with a mandatory phrase. Document frequencies of their words over all
documents give inverse document frequencies. Of each template the phrase's words of highest IDF are postings: (word,
template, place). A file's licence words of highest IDF are looked up there, with the places where they stand; each
posting says where the template would begin, and only beginnings on which all of a template's postings agree
remain. There the mandatory phrase is compared word for word, and the words that stand where the passage has them
must carry enough of its weight.

Only texts that hold some template's rarest word are read as arrays of words; nothing but word counts is shuffled.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

#: Characters of words, in texts of any case: digits, letters and everything beyond ASCII; and all others, between which texts are split.
_IN, _OUT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of a phrase whose postings are intersected.
POSTINGS = 3


@dataclass(frozen=True)
class Template:
    """A passage; `phrase` is the part of it that must stand word for word. Base templates consist of their phrase."""

    label: str
    passage: str
    phrase: str
    base: bool = False

    def words(self) -> list[str]:
        return re.findall(r"[0-9a-z]+", self.passage.lower())

    def phrase_at(self) -> tuple[int, int]:
        """Start of the phrase in the passage and its length, in words."""
        all_words, part = self.words(), re.findall(r"[0-9a-z]+", self.phrase.lower())
        return next((k, len(part)) for k in range(len(all_words)) if all_words[k : k + len(part)] == part)


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, phrase, True)


TEMPLATES = [
    _base("gpl", "gnu general public license"),
    _base("apache", "apache license"),
    _base("cc-by", "cc by"),
    _base("mit", "mit license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge to any person"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "modify it under the terms of the gnu lesser general public license"),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "the names of its contributors may be used to endorse or promote products"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable for any damages"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    Template("epl", "made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    Template("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("artistic", "you may use this package under the terms of the artistic license 2 0", "artistic license"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "may not use this file except in compliance with the license"),
]


def words_of(text: Column) -> Column:
    """The words of a text, lower-casing A-Z only; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, f"{_OUT}+"), "")


def count_words(text: Column) -> Column:
    """How many words a text has: splitting leaves an empty part at most at either end."""

    def count(parts: Column) -> Column:
        inner = F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
        return F.greatest(inner, F.lit(0)).cast("long")

    return let(F.split(text, f"{_OUT}+"), count)


def any_of(words: list[str]) -> str:
    """A pattern of any of the words standing alone, in any case; words of one first letter share a branch."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    branches = "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in by_letter.items())
    return f"(?i)(?<!{_IN})(?:{branches})(?!{_IN})"


def document_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, and the number of documents.

    What is gathered has a row for each template word at most.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(any_of([w for t in templates for w in t.words()])), F.lit(0))
    seen = F.array_distinct(F.transform(F.array_distinct(found), F.lower))
    rows = docs.select(F.explode(F.array_append(seen, F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def rarest(t: Template, idf: dict[str, float], n: int = POSTINGS) -> list[int]:
    """Places in the passage of the n words of highest IDF of the mandatory phrase, the rarest first; each word once."""
    begin, size = t.phrase_at()
    tw = t.words()
    places: dict[str, int] = {}
    for k in range(begin, begin + size):
        places.setdefault(tw[k], k)
    return sorted(places.values(), key=lambda k: (-idf[tw[k]], k))[:n]


def _places(words: Column, index: Column, t: Template, idf: dict[str, float], least: float) -> Column:
    """(label, start of phrase, share of weight, base) of every place of the template; index: (word, at) of the file's rare licence words."""
    tw = t.words()
    begin, size = t.phrase_at()
    total = sum(idf[w] for w in tw)

    def beginnings(k: int) -> Column:
        """Where the passage would begin, by every place of its word k."""
        return F.transform(F.filter(index, lambda x: x["word"] == tw[k]), lambda x: x["at"] - k)

    starts = reduce(F.array_intersect, map(beginnings, rarest(t, idf)))
    phrase = F.array(*map(F.lit, tw[begin : begin + size]))
    starts = F.filter(starts, lambda s: (s + begin >= 0) & (F.slice(words, F.greatest(s + begin + 1, F.lit(1)), size) == phrase))

    def share(s: Column) -> Column:
        held = sum((F.when((s + k >= 0) & (F.get(words, s + F.lit(k)) == tw[k]), F.lit(idf[tw[k]])).otherwise(F.lit(0.0)) for k in range(len(tw))), F.lit(0.0))
        return F.least(held / F.lit(total), F.lit(1.0))

    found = F.transform(starts, lambda s: F.struct(F.lit(t.label).alias("label"), (s + begin).cast("long").alias("start"), share(s).alias("share"), F.lit(t.base).alias("base")))
    return F.filter(found, lambda x: x["share"] >= least)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, least: float = 0.25) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and places to doc_id.

    n_base counts all places of base templates, first_word and last_word are the least and
    greatest of them (null without any); score is the greatest share of a template's weight
    found, 0 without any. places: (label, start, share) of every place. Null and empty texts
    have no words. One row per row of docs, whose other columns are ignored.
    """
    counts, n = document_frequencies(docs, templates)
    idf = {w: math.log((n + 2) / (counts.get(w, 0) + 1)) for t in templates for w in t.words()}
    anchors = [t.words()[rarest(t, idf)[0]] for t in templates]
    indexed = sorted({t.words()[k] for t in templates for k in rarest(t, idf)})
    none = F.array().cast("array<struct<label:string,start:bigint,share:double,base:boolean>>")

    def of_words(words: Column) -> Column:
        index = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(indexed))
        return let(index, lambda index: F.concat(*[_places(words, index, t, idf, 0.0 if t.base else least) for t in templates]))

    text = F.coalesce("text", F.lit(""))
    places = F.when(F.rlike(text, F.lit(any_of(anchors))), let(words_of(text), of_words)).otherwise(none)
    got = docs.select("doc_id", count_words(text).alias("n_words"), places.alias("places"))

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    return got.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"), "places",
    )
