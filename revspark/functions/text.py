"""Scalar text functions of the review engine."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Weaknesses with their names and the key words that name them, in order of precedence.
WEAKNESSES = [
    ("CWE-89", "SQL Injection", ["sql injection", "sql concat", "string concatenation into sql", "raw query", "unsanitized sql"]),
    ("CWE-79", "Cross-site Scripting (XSS)", ["xss", "cross-site scripting", "unescaped output", "unsanitized html", "reflected input"]),
    ("CWE-78", "OS Command Injection", ["command injection", "os.exec", "exec.command", "shell injection", "unsanitized command"]),
    ("CWE-22", "Path Traversal", ["path traversal", "directory traversal", "../ ", "dot dot slash", "file path manipulation"]),
    ("CWE-918", "Server-Side Request Forgery (SSRF)", ["ssrf", "server-side request forgery", "unvalidated url", "open redirect to internal"]),
    ("CWE-798", "Hardcoded Credentials", ["hardcoded secret", "hardcoded password", "hardcoded credential", "hardcoded api key", "embedded secret", "secret in code"]),
    ("CWE-327", "Use of Broken Crypto Algorithm", ["weak crypto", "md5", "sha1 ", "des ", "broken crypto", "insecure hash", "weak hash"]),
    ("CWE-502", "Deserialization of Untrusted Data", ["insecure deserialization", "unsafe deserialization", "untrusted deserialization", "pickle", "yaml.load"]),
    ("CWE-611", "XML External Entity (XXE)", ["xxe", "xml external entity", "xml injection"]),
    ("CWE-352", "Cross-Site Request Forgery (CSRF)", ["csrf", "cross-site request forgery", "missing csrf token"]),
    ("CWE-200", "Information Exposure", ["information disclosure", "sensitive data exposure", "data leak", "credential in log", "logging sensitive"]),
    ("CWE-362", "Race Condition", ["race condition", "data race", "toctou", "time of check"]),
    ("CWE-190", "Integer Overflow", ["integer overflow", "integer underflow", "int overflow"]),
    ("CWE-601", "Open Redirect", ["open redirect", "url redirect", "unvalidated redirect"]),
    ("CWE-862", "Missing Authorization", ["missing authorization", "missing auth check", "authorization bypass", "broken access control"]),
]
# Words without weight when messages are compared.
STOP_WORDS = [
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "can", "and", "or", "but", "not", "no", "if", "then", "than", "that", "this", "it", "its",
    "from", "into", "up", "out", "so", "as", "via",
]


def _quote(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in word)


def match_cwe(message: Column, fix: Column) -> Column:
    """The first weakness one of whose key words stands in message or fix between other than letters and digits; else empty."""
    text = F.lower(F.concat_ws(" ", F.coalesce(message, F.lit("")), F.coalesce(fix, F.lit(""))))
    out = F.lit("")
    for cwe, _, words in reversed(WEAKNESSES):
        any_word = "|".join(map(_quote, words))
        out = F.when(F.rlike(text, F.lit(f"(?<![a-z0-9])(?:{any_word})(?![a-z0-9])")), cwe).otherwise(out)
    return out


def cwe_name(cwe: Column) -> Column:
    out = F.lit("")
    for known, name, _ in WEAKNESSES:
        out = F.when(cwe == known, name).otherwise(out)
    return out


def word_set(text: Column) -> Column:
    """Distinct lower-cased words between white space, without punctuation at their ends."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"\A[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+\z", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def significant_words(text: Column) -> Column:
    """Lower-cased words of three bytes and more without stop words, repeats kept."""
    words = F.split(F.lower(text), r"[ ,.:;()\[\]\"'\-_/\\]+")
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOP_WORDS))


def message_overlap(a: Column, b: Column) -> Column:
    """Whether the words of a that b has too are 40 % or more of the shorter message's words."""

    def test(x: Column, y: Column) -> Column:
        shared = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
        return (F.size(x) > 0) & (F.size(y) > 0) & (shared >= F.least(F.size(x), F.size(y)) * F.lit(0.4).cast("double"))

    return let(F.struct(significant_words(a).alias("a"), significant_words(b).alias("b")), lambda s: test(s["a"], s["b"]))


WORD = r"[\p{L}\p{Nd}_$]+"


def is_code_word(word: Column) -> Column:
    """Mixed case beyond the first letter, an underscore, or digits with letters."""
    upper, lower = F.rlike(word, F.lit(r"\p{Lu}")), F.rlike(word, F.lit(r"\p{Ll}"))
    return (upper & lower & F.rlike(word, F.lit(r"(?s)\A.+\p{Lu}"))) | F.contains(word, F.lit("_")) | (F.rlike(word, F.lit(r"\p{Nd}")) & (upper | lower))


#: A whole word that looks like code, as is_code_word has it: each condition is looked up from the word's first character.
CODE_WORD = r"(?<![\p{L}\p{Nd}_$])(?:(?=[\p{L}\p{Nd}_$]*_)|(?=[\p{L}\p{Nd}_$]*\p{Nd})(?=[\p{L}\p{Nd}_$]*[\p{Lu}\p{Ll}])|(?=[\p{L}\p{Nd}_$]+\p{Lu})(?=[\p{L}\p{Nd}_$]*\p{Ll}))[\p{L}\p{Nd}_$]++"


def token_counts(text: Column) -> Column:
    """(n, code): words of a text, and how many of them look like code; every other character but white space is a word that does."""
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{Nd}_$\s\u0085\p{Z}]"))
    return let(symbols, lambda s: F.struct((F.regexp_count(text, F.lit(WORD)) + s).cast("long").alias("n"), (F.regexp_count(text, F.lit(CODE_WORD)) + s).cast("long").alias("code")))


def tokens_of(n: Column, code: Column) -> Column:
    """Tokens that a model would need for n > 0 words, of which `code` look like code: words times 1.3, or 2.0 if over 30 % do."""
    factor = F.when(code / n > F.lit(0.3).cast("double"), F.lit(2.0).cast("double")).otherwise(F.lit(1.3).cast("double"))
    return F.greatest(F.lit(1), F.floor(n * factor + F.lit(0.5).cast("double"))).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Tokens that a model would need for a text; blank ones count four bytes a token, empty and null ones none."""
    found = let(token_counts(text), lambda c: F.when(c["n"] == 0, F.floor((F.octet_length(text) + 3) / 4).cast("long")).otherwise(tokens_of(c["n"], c["code"])))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(found)


def leading_spaces(line: Column) -> Column:
    """Width of a line's indentation, a tab counting four."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"\A[ \t]*", 0), "\t", "    "))


def cap(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def indent(text: Column, prefix: str = "  ") -> Column:
    """A text with `prefix` before each line."""
    return F.concat(F.lit(prefix), F.replace(text, F.lit("\n"), F.lit(f"\n{prefix}")))


def looks_like_code(text: Column) -> Column:
    marks = [":=", "func ", "if ", "for ", "return ", "{", "}", "//", "import", "var ", "const "]
    return reduce(or_, (F.contains(text, F.lit(m)) for m in marks))


def digest(*parts: Column) -> Column:
    """SHA-256 over each part's length in bytes, a colon and the part."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p))), 256)
