"""Queries on scalar text functions, symbols and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import symbols
from ..sources import synthetic as S
from ..operators.prompts import SECURITY_CONCERNS
from . import estimated, literal, query


@query("estimate_tokens", f"SELECT key, tokens FROM ({estimated('SELECT doc_id AS key, text FROM documents UNION ALL SELECT -diff_id * 10 - n, text FROM {l} q')}) c")
def estimate_tokens(spark, sf):
    rows = S.documents(spark, sf).select(F.col("doc_id").alias("key"), "text").unionByName(S.line_items(spark, sf).select((-F.col("diff_id") * 10 - F.col("n")).alias("key"), "text"))
    return rows.select("key", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("is_code_word", r"SELECT DISTINCT w AS word, (regexp_matches(w, '\p{Lu}') AND regexp_matches(w, '\p{Ll}') AND regexp_matches(w, '^(?s:.)(?s:.*)\p{Lu}')) OR contains(w, '_') OR (regexp_matches(w, '\p{Nd}') AND (regexp_matches(w, '\p{Lu}') OR regexp_matches(w, '\p{Ll}'))) AS code FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_$]+')) AS w FROM {l} t) u")
def is_code_word(spark, sf):
    words = S.line_items(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.is_code_word(F.col("word")).alias("code"))


def _cwe_sql() -> str:
    cases = " ".join("WHEN regexp_matches(low, " + literal("(^|[^a-z0-9])(" + "|".join(T._quote(w) for w in words) + ")([^a-z0-9]|$)") + f") THEN {literal(cwe)}" for cwe, _, words in T.WEAKNESSES)
    return f"SELECT DISTINCT message, fix, CASE {cases} ELSE '' END AS cwe FROM (SELECT message, fix, lower(message || ' ' || fix) AS low FROM {{f}} t) u"


@query("match_cwe", _cwe_sql())
def match_cwe(spark, sf):
    rows = S.findings(spark, sf).select("message", "fix").distinct()
    return rows.select("message", "fix", T.match_cwe(F.col("message"), F.col("fix")).alias("cwe"))


@query("cwe_name", "SELECT diff_id, seq, CASE cwe " + " ".join(f"WHEN {literal(c)} THEN {literal(n)}" for c, n, _ in T.WEAKNESSES) + " ELSE '' END AS name FROM {f} t")
def cwe_name(spark, sf):
    return S.findings(spark, sf).select("diff_id", "seq", T.cwe_name(F.col("cwe")).alias("name"))


@query("extract_words", "SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w : trim(w, '.,;:!?\"''()[]{}')), lambda w : w <> ''))) AS w FROM documents) t GROUP BY doc_id, w".replace("\\\\", "\\"))
def extract_words(spark, sf):
    docs = S.documents(spark, sf)
    return docs.select("doc_id", F.explode(T.word_set(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("significant_words", "SELECT item_id, w AS word, count(*) AS n FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ ,.:;()\\[\\]\"''\\-_/\\\\]+'), lambda w : strlen(trim(w)) >= 3 AND NOT list_contains([".replace("\\\\]+", "\\\\]+") + ", ".join(map(literal, T.STOP_WORDS)) + "], trim(w)))) AS w FROM benchmark) t GROUP BY item_id, w")
def significant_words(spark, sf):
    items = S.table(spark, sf, "benchmark")
    return items.select("item_id", F.explode(T.significant_words(F.col("text"))).alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("n"))


@query("looks_like_code", "SELECT DISTINCT fix, regexp_matches(fix, ':=|func |if |for |return |\\{|\\}|//|import|var |const ') AS code FROM {f} t".replace("\\\\", "\\"))
def looks_like_code(spark, sf):
    return S.findings(spark, sf).select("fix").distinct().select("fix", T.looks_like_code(F.col("fix")).alias("code"))


@query("leading_spaces", "SELECT diff_id, n, n % 4 + 4 * (n % 3) AS width FROM {l} t")
def leading_spaces(spark, sf):
    rows = S.line_items(spark, sf).withColumn("line", F.concat(F.repeat(F.lit(" "), F.col("n") % 4), F.repeat(F.lit("\t"), F.col("n") % 3), F.lit("x y"), "text"))
    return rows.select("diff_id", "n", T.leading_spaces(F.col("line")).alias("width"))


@query("truncate", "SELECT doc_id, substr(text, 1, 80) AS head, regexp_replace(substr(text, 1, 80), '(?m)^', '  ', 'g') AS indented FROM documents")
def truncate(spark, sf):
    head = T.cap(F.col("text"), 80)
    return S.documents(spark, sf).select("doc_id", head.alias("head"), T.indent(head).alias("indented"))


_SOURCE = "'package p' || chr(10) || chr(10) || 'func F' || k || '(a int) error {' || chr(10) || chr(9) || 'if a > ' || k || ' {' || chr(10) || chr(9) || chr(9) || 'return nil' || chr(10) || chr(9) || '}' || chr(10) || '}' || chr(10) || 'type T' || k || ' struct {' || chr(10) || chr(9) || 'x int' || chr(10) || '}' || chr(10) || 'func (t *T' || k || ') M() {}' || chr(10)"


def _sources(spark, sf):
    keys = S.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"))
    return keys.select(F.concat("k", F.lit(".go")).alias("path"), F.expr(_SOURCE).alias("content"))


@query("symbol_search", "SELECT k || '.go' AS path, unnest(['F' || k, 'T' || k, 'T' || k || '.M']) AS symbol, unnest(['function', 'type', 'method']) AS kind, unnest([3, 8, 11]) AS start_line, unnest([7, 10, 11]) AS end_line FROM (SELECT CAST(p_partkey AS STRING) AS k FROM part) t")
def symbol_search(spark, sf):
    return symbols.search(_sources(spark, sf), ".go").drop("body")


@query("symbol_body", "SELECT k || '.go' AS path, 'T' || k || '.M' AS symbol, 'func (t *T' || k || ') M() {}' AS body FROM (SELECT CAST(p_partkey AS STRING) AS k FROM part) t")
def symbol_body(spark, sf):
    return symbols.body(_sources(spark, sf), ".go", "m").select("path", "symbol", "body")


@query("symbol_end_line", "SELECT k || '.go' AS path, 'F' || k AS symbol, CAST(7 AS INT) AS end_line FROM (SELECT CAST(p_partkey AS STRING) AS k FROM part) t")
def symbol_end_line(spark, sf):
    return symbols.search(_sources(spark, sf), ".go", "f", "function").select("path", "symbol", "end_line")


def _security_sql() -> str:
    from .findings import _overlap

    return f"SELECT concern, message, n FROM (SELECT message, count(*) AS n FROM {{f}} t GROUP BY message) m, (SELECT unnest([{', '.join(map(literal, SECURITY_CONCERNS))}]) AS concern) c WHERE {_overlap('concern', 'message')}"


@query("security_concerns", _security_sql())
def security_concerns(spark, sf):
    """What a security review looks for, with the findings' messages that speak of it."""
    said = S.findings(spark, sf).groupBy("message").agg(F.count("*").alias("n"))
    each = said.withColumn("concern", F.explode(F.array(*map(F.lit, SECURITY_CONCERNS))))
    return each.where(T.message_overlap(F.col("concern"), F.col("message"))).select("concern", "message", "n")


@query(
    "build_prompt",
    """SELECT diff_id, '## ' || path || chr(10) || string_agg(part, chr(10) ORDER BY hunk) AS prompt FROM (SELECT diff_id, path, hunk, '@@ new ' || CAST(new_start AS STRING) || chr(10) || coalesce(string_agg('+' || text, chr(10) ORDER BY n) FILTER (WHERE mark = '+'), '') ||
    chr(10) || '@@ old' || chr(10) || coalesce(string_agg('-' || text, chr(10) ORDER BY n) FILTER (WHERE mark = '-'), '') AS part FROM {l} t GROUP BY diff_id, path, hunk, new_start) u GROUP BY diff_id, path""",
)
def build_prompt(spark, sf):
    from ..operators import diff
    from ..operators.prompts import build

    return build(diff.hunks(S.diffs(spark, sf)))


@query(
    "sast_prompt",
    """SELECT diff_id, string_agg('- ' || file || ':' || CAST(line AS STRING) || ' ' || message, chr(10) ORDER BY seq) AS section FROM (
    SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY seq) AS n FROM {f} t WHERE sast_source) u WHERE n <= 50 GROUP BY diff_id""",
)
def sast_prompt(spark, sf):
    from ..operators.prompts import sast_section

    return sast_section(S.findings(spark, sf).where("sast_source"))


def _scratch(spark) -> str:
    import uuid

    from ..plans.store import shared_dir

    return f"{shared_dir(spark)}/cursor-{uuid.uuid4().hex}"


def _events(spark, sf):
    """The events as a stream, whether they are a file or a folder of files: a pattern may name either, a plain path only a folder."""
    return spark.readStream.schema(S.table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


@query("incremental_cursor", "SELECT user_id, max(ts) AS cursor, count(*) AS seen FROM events GROUP BY user_id")
def incremental_cursor(spark, sf):
    """Streams the events through the incremental module: each batch leaves its users' last times, which are merged."""
    from ..plans.store import discard, stored
    from ..streaming import incremental

    folder = _scratch(spark)
    seen = incremental.review(_events(spark, sf), lambda batch: batch.groupBy("user_id").agg(F.max("ts").alias("cursor"), F.count("*").alias("seen")), f"{folder}/out", f"{folder}/checkpoint")
    seen.awaitTermination()
    out = stored(incremental.cursors(spark, f"{folder}/out", "user_id"), "cursors")
    discard(spark, folder)
    return out


@query("cursor_state", "SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS seq, CAST(arg_max(event_id * 7, event_id) AS VARCHAR) AS head FROM events WHERE event_type <> 'error' GROUP BY user_id")
def cursor_state(spark, sf):
    """Events as outcomes of reviews, errors as failed ones: the cursors that the stream's state holds in the end."""
    from ..plans.store import discard, stored
    from ..streaming import cursors

    folder = _scratch(spark)
    outcomes = _events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 7).cast("string").alias("head"), (F.col("event_type") != "error").alias("ok"))
    cursors.resolved(None, outcomes).writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = stored(cursors.known(spark, f"{folder}/checkpoint"), "cursors")
    discard(spark, folder)
    return out


@query("blame_author_counts", "SELECT c_name AS author, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def blame_author_counts(spark, sf):
    from ..sources.git import author_counts

    names = S.table(spark, sf, "orders").join(S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = names.select(F.explode(F.array(F.concat(F.lit("author "), "c_name"), F.lit("author-mail <x@example.com>"), F.lit("\tcode"))).alias("line"))
    return author_counts(lines)


@query("path_clean", "SELECT DISTINCT path FROM {l} t")
def path_clean(spark, sf):
    from ..sources.files import clean_path

    dirty = S.line_items(spark, sf).select(F.expr(S.PATH).alias("p")).distinct().select(F.concat(F.lit("./a/.././"), F.regexp_replace("p", "/", "//")).alias("p"))
    return dirty.select(clean_path(F.col("p")).alias("path"))
