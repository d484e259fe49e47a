"""Text functions as columns: normalising, splitting, excerpts, classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions import fixed

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def without_accents(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Lower-case ASCII: accents go, other non-ASCII characters are deleted, spaces collapse."""
    ascii_only = F.regexp_replace(without_accents(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")
    return F.lower(F.trim(F.regexp_replace(ascii_only, r"\s+", " ")))


def normal_term(c: Column) -> Column:
    """Lower case without accents; punctuation and underscores become spaces, which collapse."""
    words = F.regexp_replace(F.lower(without_accents(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]|_", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def compact_term(c: Column) -> Column:
    return F.replace(normal_term(c), F.lit(" "), F.lit(""))


def query_terms(c: Column) -> Column:
    """Terms of a question: other characters deleted, short and frequent words dropped."""
    words = F.split(F.trim(F.regexp_replace(c, r"(?U)[^\w\s]", "")), r"\s+")
    short = F.array(*[F.lit(w) for w in fixed.SHORT_TERMS])
    stop = F.array(*[F.lit(w) for w in fixed.STOP_TERMS])

    def keep(t: Column) -> Column:
        two = (F.length(t) == 2) & t.rlike(r"(?U)^\p{L}+$") & ~F.array_contains(short, t)
        return (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~two

    return F.filter(words, keep)


def sentences(c: Column) -> Column:
    """Sentences: lines, cut also after . ! ? before a capital; trimmed, none empty."""
    lines = F.regexp_replace(F.regexp_replace(c, fixed.BLANK_LINES, "\n\n"), fixed.SENTENCE_END, "\n")
    return F.filter(F.transform(F.split(lines, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def chunk_tokens(c: Column) -> Column:
    """Token estimate of the chunker: a third of the length, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / fixed.CHUNK_CHARS).cast("int"))


def context_tokens(c: Column) -> Column:
    """Token estimate of the context builder."""
    return F.floor(F.length(c) / F.lit(fixed.CONTEXT_CHARS)).cast("int")


def heading(c: Column) -> Column:
    """Section: the first line in capitals, else the first line's start, else General."""
    found = F.regexp_extract(c, "(?m)" + fixed.HEADING, 1)
    first = F.substring(F.trim(F.split(c, "\n", 2)[0]), 1, 80)
    return F.when(found != "", F.initcap(found)).when(first != "", first).otherwise("General")


def excerpt(c: Column) -> Column:
    """The text itself up to 240 characters, else its first 237 and dots."""
    t = F.trim(c)
    return F.when(F.length(t) <= 240, t).otherwise(F.concat(F.substring(t, 1, 237), F.lit("...")))


def occurrences(c: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term as a substring."""
    gap = F.length(c) - F.length(F.replace(c, term, F.lit("")))
    return F.when(F.length(term) > 0, (gap / F.length(term)).cast("int")).otherwise(0)


def word_count_of(folded: Column, term: Column) -> Column:
    """Occurrences of a term between word boundaries in folded text."""
    return F.regexp_count(folded, F.concat(F.lit(r"\b\Q"), term, F.lit(r"\E\b")))


def snippet(c: Column, terms: Column, radius: int = 120) -> Column:
    """Text around the earliest term, dots where it is cut; without a hit the first 2 radius characters."""
    low = F.lower(c)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda p: p > 0))
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(c), at - 1 + radius)
    cut = F.substring(c, start, end - start + 1)
    body = F.concat(F.when(start > 1, F.lit("...")).otherwise(""), cut, F.when(end < F.length(c), F.lit("...")).otherwise(""))
    return F.when(at.isNull(), F.substring(c, 1, 2 * radius)).otherwise(body)


def is_small_talk(c: Column) -> Column:
    """Greetings and courtesies of a few words, without any clinical hint."""
    t = F.trim(F.regexp_replace(F.regexp_replace(without_accents(F.lower(F.trim(F.coalesce(c, F.lit(""))))), r"[^a-z0-9\s]", " "), r"\s+", " "))
    words = F.split(t, " ")
    known = F.array(*[F.lit(w) for w in fixed.SMALL_TALK])
    greeting = F.array(*[F.lit(w) for w in fixed.GREETINGS])
    lexical = (F.size(words) <= 5) & F.forall(words, lambda w: F.array_contains(known, w))
    greets = (F.size(words) <= 6) & F.exists(words, lambda w: F.array_contains(greeting, w))
    return (t != "") & ~t.rlike(fixed.CLINICAL) & (lexical | greets)


def is_refusal(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(fixed.REFUSAL), F.lit(False))


def citations(c: Column) -> Column:
    """Numbers of the sources cited as [n], distinct and ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def is_grounded(c: Column, sources: Column) -> Column:
    """Whether the text cites sources, and only those there are."""
    cited = citations(c)
    return (F.size(cited) > 0) & F.forall(cited, lambda n: (n >= 1) & (n <= sources))


def role(c: Column) -> Column:
    """A role by any of its names; assistant for all others."""
    r = F.lower(F.trim(c))
    names = {x: x for x in fixed.ROLES} | fixed.ROLE_NAMES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, r), F.lit("assistant"))


def literal(text: str) -> str:
    """A text as a pattern that matches only itself."""
    return re.escape(text)
