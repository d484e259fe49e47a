"""Vector and trigram similarity as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_WORD = r"[^\p{L}\p{M}\p{N}\p{Pc}]+"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, padded with two spaces before and one after.

    One pattern takes the trigrams of all words, which three spaces part, so
    that none reaches from one word into the next. It steps by UTF-16 units, so
    texts with letters beyond those take them word by word.
    """
    low = F.lower(c)
    parted = F.concat(F.lit("  "), F.regexp_replace(low, NO_WORD, "   "), F.lit(" "))
    at_once = F.regexp_extract_all(parted, F.lit("(?=(.[^ ].|  [^ ]))"), F.lit(1))
    words = F.filter(F.split(low, NO_WORD), lambda w: w != "")
    each = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.when(low.rlike(r"[\x{10000}-\x{10FFFF}]"), F.flatten(each)).otherwise(at_once))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; both given as trigram arrays."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)
