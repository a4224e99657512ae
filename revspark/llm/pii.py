"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Entities that fixed patterns find (e-mail and IP addresses, card and phone numbers) are the
seeds. The words around them induce lexical patterns. Patterns and identifier-like strings form a
bipartite graph on which Spark scores both sides in turns: a pattern by the scores of the
strings it surrounds, a string by its best patterns. Strings that reliable patterns surround are
reported too, as kind `like_<kind>`, and support patterns in their turn, until no more are found.

Texts are read in one narrow pass; only mentions, a few words each, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from .common import release, stored

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They match what greedy matching from the left matches: repeated parts are possessive, as nothing
# that follows could need them back, and a match can begin only where a run of its first characters
# begins or the last match ended. So time stays linear and no run of digits, however long, deepens the stack.
_E, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_E})){_E}++@{_D}++(?:\.{_D}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_C = "A-Za-z0-9._@+/=-"
#: In place of spans already found: no character of any pattern, but one that keeps a string beside it from being a candidate.
_HIDDEN = "\ufdd0"
#: Strings that may be identifiers, of any length: groups of digits with blanks, brackets, dots or hyphens between, or else a whole run of the characters in _C with a digit or an at sign.
CANDIDATE = rf"(?<![{_HIDDEN}{_C}])(?:\(?[0-9]++(?:[\x20().-]{{1,2}}+[0-9]++)++(?![._@+/=-]*+[{_HIDDEN}A-Za-z0-9])|(?=[A-Za-z._+/=-]*+[0-9@])[{_C}]{{5,}}+(?!{_HIDDEN}))"
CONTEXT = 200  # characters of context that words are taken from

MENTION = "array<struct<start:bigint,end:bigint,kind:string,token:string,left:string,right:string>>"


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        twice = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        small = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(small, lambda p: F.when(F.length(p) < 3, True).when(F.length(p) > 3, False).otherwise(p <= "255"))
    if kind == "card":
        n = F.length(digits)
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _mentions(text: Column, kind: str, pattern: str, holds: Callable[[Column], Column], trim: str = "") -> Column:
    """All matches of a pattern that hold, with places in code points and the words around them; trim: characters taken off their ends."""

    def found(hits: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0)).cast("long"))

            def rows(starts: Column) -> Column:
                def row(h: Column, i: Column) -> Column:
                    before, after = F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.get(gaps, i + 1), F.lit(CONTEXT))
                    h = F.rtrim(h, F.lit(trim)) if trim else h
                    return F.struct(
                        F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(h)).alias("end"), F.lit(kind).alias("kind"), F.lower(h).alias("token"),
                        F.lower(F.regexp_extract(before, r"(?:\S+\s+)?\S+\s*$", 0)).alias("left"), F.lower(F.regexp_extract(after, r"^\s*\S+", 0)).alias("right"),
                    )

                return F.filter(F.transform(hits, row), lambda m: holds(m["token"]))

            return let(running_sums(steps), rows)

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(MENTION))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _all_base(text: Column) -> Column:
    """Mentions of all base kinds; cheap tests spare most texts the patterns."""
    none = F.array().cast(MENTION)
    digit = F.rlike(text, F.lit("[0-9]"))
    needed = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    return F.concat(*(F.when(needed[k], _base(text, k)).otherwise(none) for k in KINDS))


def _is_candidate(token: Column) -> Column:
    """Five characters or more with a digit or an at sign; groups of digits have seven digits or more."""
    grouped = F.rlike(token, F.lit(r"^\(?[0-9][0-9\x20().-]*$")) & F.rlike(token, F.lit(r"[\x20()]"))
    return (F.length(token) >= 5) & F.when(grouped, F.length(F.regexp_replace(token, "[^0-9]", "")) >= 7).otherwise(F.rlike(token, F.lit("[0-9@]")))


def mentions(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep columns, base, candidates): mentions of base kinds, and of identifier-like strings beside them.

    Base spans are hidden before candidates are looked for, so that no candidate touches one.
    """

    text, rest = F.col("_pii_text"), F.col("_pii_rest")
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_pii_text"))
    rows = rows.withColumn("_pii_base", _all_base(text)).withColumn("_pii_merged", _merged(_ordered(_spans(F.col("_pii_base")))))
    hidden = _replaced(text, F.col("_pii_merged"), lambda s: F.repeat(F.lit(_HIDDEN), (s["end"] - s["start"]).cast("int")))
    rows = rows.withColumn("_pii_rest", F.when(F.size("_pii_base") > 0, hidden).otherwise(text))
    others = F.when(F.rlike(rest, F.lit("[0-9@]")), _mentions(rest, "", CANDIDATE, _is_candidate, "._@+/=-"))
    return rows.select(*keep, F.col("_pii_base").alias("base"), F.coalesce(others, F.array().cast(MENTION)).alias("candidates"))


def _base(text: Column, kind: str) -> Column:
    return _mentions(text, kind, PATTERNS[kind], lambda h: _holds(kind, h))


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of a context: two words before, one word before with one behind. Digits are masked."""
    l = F.regexp_replace(F.trim(F.regexp_replace(left, r"\s+", " ")), "[0-9]", "9")
    r = F.regexp_replace(F.trim(F.regexp_replace(right, r"\s+", " ")), "[0-9]", "9")
    one = F.element_at(F.split(l, " "), -1)
    return F.array_distinct(F.array(F.concat(l, F.lit(" _")), F.concat(one, F.lit(" _ "), r)))


def discover(found: DataFrame, rounds: int = 8, min_support: int = 3, least: float = 0.5) -> DataFrame:
    """(token, kind, confidence) of strings beyond the seeds that reliable patterns surround.

    found: base and candidates of `mentions`. A pattern's score for a kind is the sum of its strings'
    scores over their number plus one; it counts if it is `least` or more and at least min_support different strings, seeds or
    such as score `least`, support it. A string's score is one minus the product of its patterns' doubts, at most. Rounds end when no
    further string reaches `least`, after `rounds` at most.
    """
    cells = found.select(F.explode(F.concat("base", "candidates")).alias("m"))
    edges = cells.select(F.col("m.token").alias("token"), F.col("m.kind").alias("seed"), F.explode(_patterns(F.col("m.left"), F.col("m.right"))).alias("pattern"))
    edges = stored(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "pii-edges")
    spread = edges.groupBy("pattern").agg(F.count("*").alias("strings"))
    scores = edges.where("seed <> ''").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(True).alias("is_seed")).distinct()
    seeds = scores
    had = 0
    for k in range(rounds):
        support = edges.join(scores, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("is_seed") | (F.col("score") >= least)).alias("backing"))
        rated = support.where(F.col("backing") >= min_support).join(spread, "pattern").withColumn("rate", F.col("mass") / (F.col("strings") + 1))
        good = rated.where(F.col("rate") >= least).select("pattern", "kind", "rate")
        fresh = edges.where("seed = ''").select("pattern", "token").join(good, "pattern")
        fresh = fresh.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("rate"))))).alias("score"))
        last, scores = scores, stored(seeds.unionByName(fresh.select("token", "kind", "score", F.lit(False).alias("is_seed"))), f"pii-scores-{k}")
        release(last)
        now = scores.where((~F.col("is_seed")) & (F.col("score") >= least)).count()
        if now == had:
            break
        had = now
    best = scores.where((~F.col("is_seed")) & (F.col("score") >= least)).groupBy("token").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("token", F.col("b.kind").alias("kind"), F.col("b.score").alias("confidence"))


def _ordered(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate([*KINDS, *(f"like_{k}" for k in KINDS)]) for x in (kind, k)])
    sortable = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(sortable)


def joined(spans: Column) -> Column:
    """kind:start:end of ordered spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


SPAN = "array<struct<start:bigint,kind:string,end:bigint>>"


def _spans(mentions: Column) -> Column:
    return F.transform(mentions, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def _discovered(found: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    """(key, extra): spans of discovered strings, of texts that have any. What is gathered is part of one text's own mentions."""
    loose = found.select(*key, F.explode("candidates").alias("m")).select(*key, "m.token", "m.start", "m.end")
    rows = loose.join(known, "token").select(*key, F.struct("start", F.concat(F.lit("like_"), "kind").alias("kind"), "end").alias("s"))
    return rows.groupBy(*key).agg(F.collect_set("s").alias("extra"))


def scan(docs: DataFrame, *keep: str, rounds: int = 8) -> DataFrame:
    """(keep columns, base, spans): ordered spans (start, rank, kind, end) of base kinds, and of all kinds.

    Places are code points, ends exclusive. One row per row of docs, repeated ids included;
    a null text is empty and has no spans; an empty table gives no rows. Kept columns may have any names but base and spans.
    """
    named = [F.col(k).alias(f"_pii_keep_{i}") for i, k in enumerate(keep)]
    rows = docs.select(*named, "text", F.monotonically_increasing_id().alias("_pii_at"))
    found = stored(mentions(rows, *(f"_pii_keep_{i}" for i in range(len(keep))), "_pii_at"), "pii-mentions")
    extra = _discovered(found, discover(found, rounds), "_pii_at")
    base = _spans(F.col("base"))
    rows = found.join(extra, "_pii_at", "left")
    back = [F.col(f"_pii_keep_{i}").alias(k) for i, k in enumerate(keep)]
    return rows.select(*back, _ordered(base).alias("base"), _ordered(F.concat(base, F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"))


def _running_max(numbers: Column) -> Column:
    """The greatest of an array's elements up to and with each; two levels of blocks keep this near linear."""
    size = 64

    def of(numbers: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int")), lambda b: F.array_max(F.slice(numbers, b * size + 1, size)))

        def with_tops(tops: Column) -> Column:
            before = F.transform(tops, lambda _, b: F.array_max(F.slice(tops, F.lit(1), b)))

            def each(before: Column) -> Column:
                return F.transform(numbers, lambda _, i: F.greatest(F.get(before, F.floor(i / size).cast("int")), F.array_max(F.slice(numbers, F.floor(i / size).cast("int") * size + 1, i % size + 1))))

            return let(before, each)

        return let(tops, with_tops)

    return F.when(F.size(numbers) > 0, let(numbers, of)).otherwise(F.array().cast("array<bigint>"))


def _merged(spans: Column) -> Column:
    """Of each run of overlapping spans the first's kind and start and the greatest end; spans are ordered by start."""

    def of(spans: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(spans, i)["start"]))

            def each(heads: Column) -> Column:
                def row(h: Column, k: Column) -> Column:
                    last = F.coalesce(F.get(heads, k + 1), F.size(spans)) - 1
                    return F.struct(F.get(spans, h)["start"].alias("start"), F.get(spans, h)["kind"].alias("kind"), F.get(ends, last).alias("end"))

                return F.transform(heads, row)

            return let(heads, each)

        return let(_running_max(F.transform(spans, lambda s: s["end"])), with_ends)

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(F.array().cast(SPAN))


CHUNK = 4096


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """text with each of the ordered, disjoint spans replaced.

    Parts are cut from chunks of the text, as a substring is counted off from the beginning.
    """

    def with_chunks(chunks: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            a, b = (F.floor(x / CHUNK).cast("int") for x in (begin, end))
            head = F.substring(F.get(chunks, a), (begin % CHUNK + 1).cast("int"), F.when(a == b, (end - begin).cast("int")).otherwise(CHUNK))
            middle = F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
            tail = F.coalesce(F.substring(F.get(chunks, b), F.lit(1), (end % CHUNK).cast("int")), F.lit(""))
            return F.when(begin >= end, "").when(a == b, head).otherwise(F.concat(head, middle, tail))

        def with_ends(ends: Column) -> Column:
            parts = F.transform(spans, lambda s, i: F.concat(part(F.get(ends, i), s["start"]), by(s)))
            return F.concat(F.array_join(parts, ""), part(F.element_at(ends, -1), F.length(text).cast("long")))

        return let(F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"])), with_ends)

    return let(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK))), with_chunks)


def redact(docs: DataFrame, rounds: int = 8) -> DataFrame:
    """docs with every span replaced by <kind>; overlapping spans become one. Other columns and null texts stay as they are.

    Base kinds are found and replaced in the scan itself. Only spans of discovered strings, of the texts that have any,
    are joined to the documents, by doc_id and the text's hash, so that rows that repeat an id each get their own.
    """
    names = docs.columns
    keyed = docs.withColumn("_pii_hash", F.xxhash64("text"))
    found = stored(mentions(keyed, "doc_id", "_pii_hash"), "pii-mentions")
    extra = stored(_discovered(found, discover(found, rounds), "doc_id", "_pii_hash"), "pii-extra")
    extra = extra.select(F.col("doc_id").alias("_pii_doc"), F.col("_pii_hash").alias("_pii_text"), F.col("extra").alias("_pii_extra"))
    rows = keyed.join(extra, F.col("doc_id").eqNullSafe(F.col("_pii_doc")) & (F.col("_pii_hash") == F.col("_pii_text")), "left")
    text = F.col("text")

    def masked(spans: Column) -> Column:
        return F.when(F.size(spans) == 0, text).otherwise(let(_merged(_ordered(spans)), lambda m: _replaced(text, m, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))))

    every = F.concat(_spans(_all_base(text)), F.coalesce("_pii_extra", F.array().cast(SPAN)))
    return rows.withColumn("text", F.when(text.isNotNull(), let(every, masked))).select(*names)
