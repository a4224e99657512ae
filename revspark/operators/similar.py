"""Similar findings: a set-similarity join of their words, and greedy groups of near findings.

Findings of a diff with the same set of words are one class. Few classes of a diff are compared one by one, many are joined on their rarest words: two
sets of n and s words that are similar enough share so many words that the first few of each, rarest first, must
meet. How many is worked out for every pair of sizes, so that sets that differ in more than the threshold allows hardly meet.

Groups are those of the greedy order. Whatever is near a finding in another file is near every finding there, so that
across files only the first of a class in each of two files counts; within a file only lines a few apart matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, word_set
from ..plans.fold import fold
from ..plans.store import release, stored


def _words(findings: DataFrame) -> DataFrame:
    """diff_id, seq, file, line and confidence with the words, sorted: what makes the class."""
    words = F.sort_array(word_set(F.concat_ws(" ", "concern", "message")))
    return findings.select("diff_id", "seq", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).cast("long").alias("line"), "confidence", words.alias("words"))


#: Names of a key up to which all its pairs are compared within the key's row; keys with more are joined on rare words.
FEW = 32


def similar_sets(sets: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """(key, a, b): pairs of different names of one key whose word sets are as similar as threshold, each pair in both directions.

    sets: key, name, words (distinct ones), stored, as it is read several times. Empty sets are similar to none here. Keys of up to `FEW` names
    have their pairs compared one by one; of the others only candidates that share one of their rarest words are compared.
    """
    sizes = stored(sets.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "similar-sizes")
    similarity = jaccard(F.col("wa"), F.col("wb"))
    few = sets.where(F.size("words") > 0).join(sizes.where(F.col("_n") <= FEW), key).groupBy(key).agg(F.collect_list(F.struct(F.col(name).alias("k"), F.col("words").alias("w"))).alias("all"))
    x = few.where(F.size("all") > 1).select(key, "all", F.explode("all").alias("x"))
    met = x.select(key, "x", F.explode("all").alias("y")).where("x.k < y.k").select(key, F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.w").alias("wa"), F.col("y.w").alias("wb"))
    near = met.select(key, "a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    near = near.select(key, "similarity", ways).select(key, "p.a", "p.b", "similarity")
    many = sizes.where(F.col("_n") > FEW).select(key)
    if many.isEmpty():
        return near
    return near.unionByName(_by_rare_words(sets.join(many, key, "left_semi"), key, name, threshold))


def _by_rare_words(sets: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """similar_sets of keys with many names, by a join on the rarest words of each set."""
    words = sets.select("words").distinct().select("words", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    rare = words.join(often, "word").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("rare")).select("words", F.col("rare.word").alias("rare"))
    own, other = F.size("words"), F.col("size")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (own + other) - 1e-9)  # words that two such sets share at least
    sizes = F.explode(F.sequence(F.ceil(own * threshold - 1e-9).cast("int"), F.floor(own / threshold + 1e-9).cast("int"))).alias("size")
    ends = sets.join(rare, "words").select(key, name, "words", "rare", sizes)
    ends = ends.select(key, name, "words", F.least(own, other).alias("small"), F.greatest(own, other).alias("large"), F.explode(F.slice("rare", F.lit(1), (own - least + 1).cast("int"))).alias("word"))
    x, y = ends.withColumnsRenamed({name: "a", "words": "wa"}), ends.withColumnsRenamed({name: "b", "words": "wb"})
    met = x.join(y, [key, "word", "small", "large"]).where("a <> b and size(wa) + size(wb) = small + large")
    return met.where(jaccard(F.col("wa"), F.col("wb")) >= threshold).select(key, "a", "b", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).distinct()


def similar_pairs(findings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(diff_id, a, b, similarity) of findings a before b of one diff that are similar enough.

    Findings without words are similar to one another. Pairs are listed one by one: their number is the result's, not that of comparisons.
    """
    rows = stored(_words(findings).select("diff_id", "seq", "words"), "near-words")
    classes = stored(rows.groupBy("diff_id", "words").agg(F.min("seq").alias("class")), "near-classes")
    of = rows.join(classes, ["diff_id", "words"]).select("diff_id", "seq", "class")
    same = classes.select("diff_id", F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    pairs = similar_sets(classes, "diff_id", "class", threshold).unionByName(same)
    found = pairs.join(of.withColumnsRenamed({"class": "a", "seq": "_a"}), ["diff_id", "a"]).join(of.withColumnsRenamed({"class": "b", "seq": "_b"}), ["diff_id", "b"])
    return found.where("_a < _b").select("diff_id", F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity")


def _two_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file1, first1, first2: of rows (keys, file, first) the least `first` with its file, and the least in any other file."""
    best = rows.groupBy(*keys).agg(F.min(F.struct("first", "file")).alias("_best"))
    other = F.min(F.when(F.col("file") != F.col("_best.file"), F.col("first")))
    return rows.join(best, keys).groupBy(*keys).agg(F.first("_best.file").alias("file1"), F.first("_best.first").alias("first1"), other.alias("first2"))


def _elsewhere(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """diff_id, class, file1, first1, first2: the first of nodes in similar classes, and the first of them in a file other than that one's."""
    per_file = nodes.groupBy("diff_id", "class", "file").agg(F.min("seq").alias("first"))
    around = pairs.join(per_file.withColumnRenamed("class", "b"), ["diff_id", "b"]).groupBy("diff_id", F.col("a").alias("class"), "file").agg(F.min("first").alias("first"))
    return _two_first(around, ["diff_id", "class"])


def _settle(distance: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Greedy choice within a file, in order, as far as what stands in other files and isn't settled allows.

    Rows: diff_id, file, seq, line, class, near (similar classes), elsewhere (the first open finding in similar classes of
    other files). Yields those that lead (settled) and those that have to wait.
    """

    def within(lines: dict[int, set[int]], line: int, near: list[int]) -> bool:
        return any(not lines[c].isdisjoint(range(line - distance, line + distance + 1)) for c in near if c in lines)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        leaders: dict[int, set[int]] = defaultdict(set)
        open_: dict[int, set[int]] = defaultdict(set)
        for diff, file, seq, line, cls, near, elsewhere in rows:
            if within(leaders, line, near):
                continue
            settled = (elsewhere is None or elsewhere > seq) and not within(open_, line, near)
            (leaders if settled else open_)[cls].add(line)
            yield diff, file, seq, line, cls, settled

    return run


def _leaders(nodes: DataFrame, pairs: DataFrame, distance: int, same_file_only: bool) -> DataFrame:
    """diff_id, file, seq, line, class of the findings that lead in the greedy order.

    Each round settles, in all files at once, those that no open finding before them can take, and drops what the new leaders take in
    other files. The first open finding of a diff is always settled; findings of one class need two rounds.
    """
    near = pairs.groupBy("diff_id", F.col("a").alias("class")).agg(F.collect_list("b").alias("near"))
    fields = ["diff_id", "file", "seq", "line", "class"]
    left = stored(nodes.select(*fields), "near-open")
    done: list[DataFrame] = []
    while not left.isEmpty():
        rows = left.join(near, ["diff_id", "class"])
        if same_file_only:
            rows = rows.withColumn("elsewhere", F.lit(None).cast("long"))
        else:
            other = F.when(F.col("file1") != F.col("file"), F.col("first1")).otherwise(F.col("first2"))
            rows = rows.join(_elsewhere(pairs, left), ["diff_id", "class"], "left").withColumn("elsewhere", other)
        judged = stored(fold(rows.select(*fields, "near", "elsewhere"), ["diff_id", "file"], ["seq"], _settle(distance), "diff_id bigint, file string, seq bigint, line bigint, class bigint, settled boolean"), "near-judged")
        led = judged.where("settled").drop("settled")
        done.append(led)
        waiting = judged.where("not settled").drop("settled")
        if waiting.isEmpty():
            break
        if not same_file_only:
            taken = _elsewhere(pairs, led)
            waiting = waiting.join(taken, ["diff_id", "class"], "left").where("file1 is null or (file1 = file and first2 is null)").select(*fields)
        last, left = left, stored(waiting, "near-open")
        release(last)
    out = done[0] if done else left
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_dedup(findings: DataFrame, distance: int = 5, threshold: float = 0.8, same_file_only: bool = False) -> DataFrame:
    """findings with group_id (seq of the group's first, null outside), is_rep and is_unique.

    Greedy, in order of seq, which numbers the findings of a diff: a finding that belongs to no group takes all later ones whose words of
    concern and message are as similar as threshold and that stand within distance lines, or in another file.
    The representative has the greatest confidence, the first among equals. Findings without words are similar to one
    another; null files are one file, null lines line 0. No findings give none.
    """
    rows = stored(_words(findings).withColumn("class", F.min("seq").over(W.partitionBy("diff_id", "words"))), "near-words")
    place = F.struct("file", "line")
    classes = rows.groupBy("diff_id", "class").agg(F.first("words").alias("words"), (F.min(place) != F.max(place)).alias("_spread"))
    classes = stored(classes, "near-classes")
    alike = stored(similar_sets(classes, "diff_id", "class", threshold).select("diff_id", "a", "b"), "near-pairs")
    # Classes of one place without a similar class are left out: nothing else is near them.
    busy = classes.where("_spread").select("diff_id", "class").unionByName(alike.select("diff_id", F.col("a").alias("class"))).distinct()
    pairs = stored(alike.unionByName(busy.select("diff_id", F.col("class").alias("a"), F.col("class").alias("b"))), "near-pairs")
    # Of findings of one class and place the first decides for all: they are near one another and the same others.
    nodes = rows.join(busy, ["diff_id", "class"]).groupBy("diff_id", "class", "file", "line").agg(F.min("seq").alias("seq"))
    nodes = stored(nodes, "near-nodes")
    led = stored(_leaders(nodes, pairs, distance, same_file_only), "near-leaders")

    # A finding belongs to the first leader that it is near: one in its own file a few lines away, or any in another file.
    places = led.select("diff_id", F.col("class").alias("b"), "file", F.col("line").alias("_line"), F.col("seq").alias("_lead"), F.floor(F.col("line") / (distance + 1)).alias("cell"))
    around = F.array(*(F.floor(F.col("line") / (distance + 1)) + k for k in (-1, 0, 1)))
    here = nodes.join(pairs.withColumnRenamed("a", "class"), ["diff_id", "class"]).select("diff_id", "file", "seq", "line", "b", F.explode(around).alias("cell")).join(places, ["diff_id", "b", "file", "cell"])
    first = here.where(F.abs(F.col("line") - F.col("_line")) <= distance).groupBy("diff_id", "seq").agg(F.min("_lead").alias("_here"))
    found = nodes.join(first, ["diff_id", "seq"], "left")
    if same_file_only:
        found = found.withColumn("lead", F.col("_here"))
    else:
        there = F.when(F.col("file1") != F.col("file"), F.col("first1")).otherwise(F.col("first2"))
        found = found.join(_elsewhere(pairs, led), ["diff_id", "class"], "left").withColumn("lead", F.least("_here", there))
    place = ["diff_id", "class", "file", "line"]
    of = rows.join(found.select(*place, F.col("lead").alias("_lead")), place, "left").select("diff_id", "seq", "confidence", F.coalesce("_lead", "class").alias("_group"))
    of = stored(of, "near-groups")
    best = F.min_by("seq", F.struct(F.isnull("confidence"), -F.col("confidence"), F.col("seq")))
    groups = of.groupBy("diff_id", "_group").agg(F.count("*").alias("_n"), best.alias("_best"))
    marked = of.join(groups, ["diff_id", "_group"]).select("diff_id", "seq", F.when(F.col("_n") > 1, F.col("_group")).alias("group_id"), (F.col("_best") == F.col("seq")).alias("_first"))
    release(rows, classes, alike, pairs, nodes, led)
    out = findings.join(marked, ["diff_id", "seq"])
    return out.select(*findings.columns, "group_id", (F.col("_first") & F.col("group_id").isNotNull()).alias("is_rep"), "_first").withColumnRenamed("_first", "is_unique")

