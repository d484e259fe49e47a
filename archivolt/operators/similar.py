"""The k texts most similar to each question by trigrams: one pass over the texts, which keeps k hits of a question in a task.

Nothing is stored and no text is shuffled. A batch's trigrams are numbers in
one array; sorting it gives each text's distinct trigrams and those it shares
with each question. What is dearer to decide of a text is asked only of texts
that are similar enough to be among the k so far.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as tx

MOST_QUESTIONS, SLICE_CHARS, SPACE = 1_000, 1 << 19, 32
HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("similarity", pa.float64()), ("density", pa.float64())])
HITS_DDL = "query_id long, chunk_id long, similarity double, density double"


@cache
def _in_words() -> np.ndarray:
    """Whether a code point belongs to a word: letters, marks, numbers and connecting punctuation."""
    return np.fromiter(((c := unicodedata.category(chr(n)))[0] in "LMN" or c == "Pc" for n in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of all distinct trigrams of lower-cased texts, in order; a trigram is three code points of 21 bits.

    Words are padded with two spaces before and one after.
    """
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _in_words()[codes]
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), int, len(texts)) + 1)
    kinds = np.zeros(0x110000, bool)
    kinds[codes], kinds[SPACE] = True, True
    alphabet = np.flatnonzero(kinds)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    bits = max(1, (len(alphabet) - 1).bit_length())
    now = np.where(word, place[codes], place[SPACE])
    one, two = (np.concatenate([np.full(n, place[SPACE]), now])[: len(now)] for n in (1, 2))
    two = np.where(one == place[SPACE], one, two)
    last = word & ~np.append(word[1:], False)
    key = np.concatenate([((two << bits | one) << bits | now)[word], ((one << bits | now) << bits | place[SPACE])[last]])
    of = np.concatenate([row[word], row[last]])
    if 3 * bits + len(texts).bit_length() > 63:  # some hundred thousand different letters
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[: len(key)]
        key, of = key[new], of[new]
    else:
        both = np.sort(of << 3 * bits | key)
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        key, of = both & (1 << 3 * bits) - 1, both >> 3 * bits
    part = lambda n: alphabet[key >> n * bits & (1 << bits) - 1]
    return of, (part(2) << 21 | part(1)) << 21 | part(0)


def _slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Best:
    """The k best hits of a question so far, by similarity, density and number of the text."""

    def __init__(self, k: int):
        self.k, self.hits = k, []

    def least(self) -> float:
        return -self.hits[-1][0] if len(self.hits) == self.k else -1.0

    def add(self, similarity: float, density: float, chunk_id: int) -> None:
        bisect.insort(self.hits, (-similarity, -density, chunk_id))
        del self.hits[self.k :]


def _scan(asked: list[tuple], k: int, judge: Callable[[tuple, str, int, int], float | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.unique(grams([low])[1]) for _, low, _ in asked]
        known = np.unique(np.concatenate(own))
        has = np.array([np.isin(known, g) for g in own])
        best = [Best(k) for _ in asked]
        for batch in batches:
            ids, whole = batch.column("chunk_id").to_numpy(), [t or "" for t in batch.column("low").to_pylist()]
            for start, end in _slices(whole):
                texts, at = whole[start:end], ids[start:end]
                of, found = grams(texts)
                size = np.bincount(of, minlength=len(texts))
                near = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                met = known[near] == found if len(known) else np.zeros(len(found), bool)
                near, of = near[met], of[met]
                for question, mine, g, kept in zip(asked, has, own, best, strict=True):
                    common = np.bincount(of[mine[near]], minlength=len(texts))
                    union = size + len(g) - common
                    similarity = np.divide(common, union, out=np.zeros(len(texts)), where=union > 0)
                    few = np.flatnonzero(similarity >= kept.least())
                    for i in few[np.lexsort((at[few], -similarity[few]))].tolist():
                        s = float(similarity[i])
                        if s < kept.least():
                            break
                        density = judge(question, texts[i], int(common[i]), len(g))
                        if density is not None:
                            kept.add(s, density, int(at[i]))
        rows = [(q[0], chunk_id, -s, -d) for q, kept in zip(asked, best, strict=True) for s, d, chunk_id in kept.hits]
        columns = zip(*rows, strict=True) if rows else [[]] * len(HITS)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)], schema=HITS)

    return run


def nearest(chunks: DataFrame, queries: DataFrame, k: int, judge: Callable[[tuple, str, int, int], float | None], most: int = MOST_QUESTIONS) -> DataFrame:
    """(query_id, chunk_id, similarity, density): at most k hits a task of each question, the k best of all among them.

    chunks: chunk_id (a whole number), content; queries: query_id (a whole
    number), query_text, a stated set. judge takes a question (query_id, text
    in lower case, terms), a text in lower case, and how many trigrams of how
    many of the question it has; it returns the density that ranks equally
    similar texts, or None for no hit. A pass is for `most` questions.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.lower("query_text").alias("low"), tx.query_terms(F.lower("query_text")).alias("terms")).where("low is not null").distinct()
    low = chunks.where("content is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("content").alias("low"))
    parts, out = max(1, math.ceil(q.count() / most)), None
    for part in range(parts):
        few = q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        asked = [(r.query_id, r.low, r.terms) for r in few.collect()]
        found = low.mapInArrow(_scan(asked, k, judge), HITS_DDL) if asked else queries.sparkSession.createDataFrame([], HITS_DDL)
        out = found if out is None else out.unionByName(found)
    kinds = {c: df.schema[c].dataType for c, df in (("query_id", queries), ("chunk_id", chunks))}
    return out.select(*[F.col(c).cast(kind) for c, kind in kinds.items()], "similarity", "density")


def holds_a_term(question: tuple, low: str, common: int, of: int) -> float | None:
    return 0.0 if any(t in low for t in question[2]) else None
