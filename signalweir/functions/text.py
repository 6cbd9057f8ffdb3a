"""Column helpers for text: trimming, ASCII word edges, hashing, tokens, lexical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space the source systems trim, written for Java regexes.  Ranges, as
# a class inside the class (\s) is asked for every character by itself.
WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# ASCII word edges.  Java's \b also counts accented letters as word characters.
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"

# Words ignored when a query or a chunk is tokenised.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are",
    "was", "were", "be", "with", "as", "at", "by", "it", "this", "that", "from",
    "we", "you", "i", "if", "then", "than", "so", "but", "not", "no",
]


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column, also: str, to: str) -> Column:
    """Runs of white space and the characters of `also` as one `to`; a pattern replaces only where there are runs."""
    chars = WS_CHARS + also
    run = F.regexp_replace(c, f"[{also}{WS[1:]}+", to)
    return F.when(c.rlike(f"[{also}{WS[1:]}{{2}}"), run).otherwise(F.translate(c, chars, to * len(chars)))


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def tokens(c: Column) -> Column:
    """Lowercase terms of two or more characters, stop words removed, repeats kept."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_.\-]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def query_terms(c: Column) -> Column:
    """Distinct terms of a text, stop words removed by hash."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_.\-]+")
    return F.filter(F.array_except(parts, F.array(*[F.lit(w) for w in STOP_WORDS])), lambda t: F.length(t) > 1)


def lexical_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the distinct query terms that occur in the text."""
    q = F.array_distinct(query_tokens)
    hits = F.size(F.array_intersect(q, text_tokens))
    return F.when(F.size(q) > 0, hits / F.size(q)).otherwise(F.lit(0.0))


def token_set_similarity(a: Column, b: Column) -> Column:
    """Common terms over the geometric mean of both distinct term counts."""
    return term_set_similarity(F.array_distinct(a), F.array_distinct(b))


def term_set_similarity(left: Column, right: Column) -> Column:
    """The same for term arrays known to be distinct."""
    both = F.size(F.array_intersect(left, right))
    norm = F.sqrt(F.size(left).cast("double") * F.size(right))
    return F.when(norm > 0, both / norm).otherwise(F.lit(0.0))


def embedding_input(c: Column, max_chars: int = 8000) -> Column:
    return strip_ws(F.substring(c, 1, max_chars))


def valid_collection(c: Column) -> Column:
    """Normalised collection name, or null when it is not a safe slug."""
    name = strip_ws(F.lower(F.coalesce(c, F.lit("default"))))
    return F.when(name.rlike(r"^[a-z0-9][a-z0-9_-]{0,63}\z"), name)
