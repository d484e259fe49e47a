"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

The index is sharded by what an edit leaves alone. A word cut into three grams
keeps two of them through any one edit, so near words meet in the shard of two
grams and their places. In a shard, lists of positional bigrams are merged by a
heap; words that share enough bigrams for one edit are compared letter by
letter.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.common import drop, scratch, table

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLIP, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
Q, SHARD, HELD = 2, 4096, 200_000


def slipped(doc_id: int | None, run: str) -> str:
    """A run of letters as it is met in a document: one in 199 has lost a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            lowered = (text.as_py() or "").encode().translate(LOWER).decode()
            for run, n in Counter(RUN.findall(lowered)).items():
                word = slipped(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD:  # counts are added up again after the shuffle
                yield out()
    yield out()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least six letters met at least `least` times; counted in each task, then by word."""
    return docs.select("doc_id", "text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cuts(length: int) -> tuple[int, int]:
    """Lengths of the first and the second of the three grams of a word."""
    return length // 3, (length + 1) // 3


def shard_keys(words: DataFrame) -> DataFrame:
    """(word, n, longest, kind, key): the shards that a word is in, three for its own length and three for one letter more.

    Grams are cut by the length of the longer word of a pair. kind tells which
    of the three the edit may touch: the last (0), the middle (1) or the first (2).
    """
    length = F.char_length("word")
    longest = F.explode(F.array(length, length + 1)).alias("longest")
    w = words.select("word", "n", longest)
    size = F.char_length("word")
    a, b = F.floor(F.col("longest") / 3).cast("int"), F.floor((F.col("longest") + 1) / 3).cast("int")
    c = F.col("longest") - a - b
    word, one = F.col("word"), F.lit(1)
    head, tail = F.substring(word, one, a), F.substring(word, size - c + 1, c)
    keys = F.array(F.substring(word, one, a + b), F.concat(head, F.lit(" "), tail), F.substring(word, size - b - c + 1, b + c))
    return w.select("word", "n", "longest", F.posexplode(keys).alias("kind", "key"))


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    return a[n:] == b[n + 1 :] if len(a) < len(b) else a[n + 1 :] == b[n + 1 :]


def own_keys(word: str, longest: int) -> tuple[str, str, str]:
    """The keys of shard_keys, in the order of their kinds."""
    a, b = cuts(longest)
    c = longest - a - b
    return word[: a + b], word[:a] + " " + word[len(word) - c :], word[len(word) - b - c :]


def met_before(a: str, b: str, kind: int) -> bool:
    """Whether two near words also share a shard of an earlier kind, where they are paired."""
    longest = max(len(a), len(b))
    return any(x == y for x, y in zip(own_keys(a, longest)[:kind], own_keys(b, longest)[:kind], strict=True))


def grams(word: str) -> list[tuple[str, int]]:
    return [(word[i : i + Q], i) for i in range(len(word) - Q + 1)]


def near_pairs(words: list[str], longest: int, sides: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of words one edit apart of which the longer has `longest` letters.

    Postings (gram, place, length) name words in ascending order; each word
    merges the lists of its own grams at places one apart at most and lengths
    one apart at most, and compares itself with the words that are met at least
    longest - Q + 1 - Q times. With sides, only words of different sides pair.
    """
    if len(words) < 2:
        return
    postings: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    least = longest - 2 * Q + 1
    for j, word in enumerate(words):
        lengths = (longest - 1, longest) if len(word) == longest else (longest,)
        lists = [p for g, at in grams(word) for place in (at - 1, at, at + 1) for n in lengths if (p := postings.get((g, place, n)))]
        last, met = -1, 0
        for i in heapq.merge(*lists):
            last, met = (i, met + 1) if i == last else (i, 1)
            if met == least and (sides is None or sides[i] != sides[j]) and one_edit(words[i], word):
                yield i, j
        for g, at in grams(word):
            postings[g, at, len(word)].append(j)


PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each shard; a task's rows come sorted by shard, of which one is held at a time."""

    def found(shard: tuple, rows: list[tuple[str, int, int]]) -> list[tuple[str, int, str, int]]:
        longest, kind, _, first, second = shard
        words = [w for w, _, _ in rows]
        sides = None if first == second else [s for _, _, s in rows]
        return [(*rows[i][:2], *rows[j][:2]) for i, j in near_pairs(words, longest, sides) if not met_before(words[i], words[j], kind)]

    shard, rows, out = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("longest", "kind", "key", "first", "second", "word", "n", "side")]
        for *key, word, n, side in zip(*columns, strict=True):
            if key != shard:
                if len(rows) > 1:
                    out += found(tuple(shard), rows)
                shard, rows = key, []
            rows.append((word, n, side))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PAIRS, strict=True)], schema=PAIRS)
            out = []
    if len(rows) > 1 and (out := found(tuple(shard), rows)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PAIRS, strict=True)], schema=PAIRS)


def links(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once.

    A shard of more than `shard` words is dealt into parts, and each two of its
    parts are a shard of their own.
    """
    keys = shard_keys(words)
    by = ["longest", "kind", "key"]
    sizes = keys.groupBy(*by).agg(F.count("*").alias("size")).where("size > 1")
    met = keys.join(sizes, by).withColumn("parts", F.ceil(F.col("size") / shard).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = met.select(*by, "word", "n", "side", other).select(*by, "word", "n", "side", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"))
    group = [*by, "first", "second"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_pairs, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, twice as far in every round.

    A form is met at least five times as often as its word, so no chain has
    more than log5(most) steps, most being the greatest count.
    """
    out = forms.select("word", F.col("form").alias("root"))
    steps = max(1, math.floor(math.log(max(most, 1), RATIO)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        fresh = scratch(out.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        if hasattr(out, "scratch_path"):
            drop(out)
        out = fresh
    return out


def variants(docs: DataFrame) -> DataFrame:
    """Words of the texts, the commoner form that each is a variant of, and the root of its forms.

    Words are runs of letters in lower case, of six letters or more and met five
    times or more. form is the near word met most often (ties: the first in
    code-point order), if it is met five times as often as the word; else null.
    root is the last of the forms from the word on, the word itself without
    one. Null and empty texts have no words; a null doc_id counts as an empty
    one; a repeated row counts again. Other columns are not read; without words
    the result is empty.
    """
    words = scratch(vocabulary(docs), "words")
    pairs = scratch(links(words), "pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("k")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("k")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    own = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.k") >= RATIO * F.col("n"), F.struct((-F.col("best.k")).alias("n"), F.col("best.near").alias("near"))).alias("form")
    )
    own = scratch(own.select("word", "n", "n_near", F.col("form.near").alias("form"), F.col("form.n").alias("form_n")), "forms")
    most = own.agg(F.max("n")).first()[0] or 0
    end = roots(own.where("form is not null"), most)
    return own.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over whole `documents`; odd rows as in variants."""
    return variants(table(spark, sf_dir, "documents"))
