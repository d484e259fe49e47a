"""Substring dedup: repeated word windows found by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.common import drop, scratch

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
KEPT_WORDS = 400_000


class WordHashes(dict):
    """XXH64 of words, computed once for a frequent word; holds a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Rolling:
    """Hashes of word windows of any length from one array of prefix sums.

    The window w[i:i+k] has the hash sum(w[i+j] * BASE**j) modulo 2**64.
    """

    def __init__(self):
        self.words = WordHashes()
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, np.uint64))]) for b in (BASE, INVERSE)
            )

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        self._powers(n + 1)
        values = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        return (sums[starts + length] - sums[starts]) * self.down[starts]


def levels(length: int) -> list[int]:
    """Three window lengths, each at most twice the one before; the last is length."""
    half = -(-length // 2)
    return [-(-half // 2), half, length]


def anchors(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span of adjacent short windows the one of least hash, leftmost on ties.

    Returns the chosen positions and the first and last span that chose each.
    Spans of equal content choose alike, so two equal long windows, whose short
    windows make one span each, have an equal anchor at the same offset.
    """
    spans = np.lib.stride_tricks.sliding_window_view(hashes, span)
    chosen = np.concatenate([spans[i : i + 65536].argmin(axis=1) for i in range(0, len(spans), 65536)]) + np.arange(len(spans))
    cuts = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(chosen)]]) - 1
    return chosen[first], first, last


ROWS = "key long, th long, span long, next long"
LEFT = np.uint64(0xD6E8FEB86659FD93)  # told apart from windows to the right of an anchor


def _span(low: np.ndarray, high: np.ndarray, half: int) -> np.ndarray:
    """First and last start of a range and the side of its window, in one long."""
    return (low.astype(np.int64) << 32) | (high.astype(np.int64) << 1) | half


def _anchor_rows(length: int):
    """First level: a row for each anchor and each half of the spans that chose it.

    `next` is the hash of the window of twice the length that holds the anchor
    and lies within all long windows starting in the span: to the right of the
    anchor for those that start near it, to its left for the others.
    """
    short, double = levels(length)[0], min(length, 2 * levels(length)[0])
    reach = length - short + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            out: list[tuple] = []
            for text, th in zip(batch.column("text"), batch.column("th").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                if len(words) < length:
                    continue
                sums = roll.prefix(words)
                at, low, high = anchors(roll.windows(sums, np.arange(len(words) - short + 1), short), reach)
                key = roll.windows(sums, at, short)
                split = np.maximum(low, at - (length - double))  # starts from here on hold the right extension
                for half, lo, hi, start in ((0, split, high, at), (1, low, np.minimum(high, split - 1), at - (double - short))):
                    ok = lo <= hi
                    far = roll.windows(sums, start[ok], double)
                    out.append((key[ok], np.full(int(ok.sum()), th), _span(lo[ok], hi[ok], half), far ^ LEFT if half else far))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.record_batch([pa.array(c.view(np.int64)) for c in cols], names=["key", "th", "span", "next"])

    return run


def _window_rows(length: int):
    """A row for each start in the spans of a text: the hash of the window of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last = Rolling(), None
        for batch in batches:
            out: list[tuple] = []
            for text, th, spans in zip(batch.column("text"), batch.column("th").to_pylist(), batch.column("spans"), strict=True):
                if th == last:  # the join has brought equal texts together
                    continue
                last = th
                words = text.as_py().encode().split()
                sums = roll.prefix(words)
                span = np.asarray(spans.values)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, span >> 32, 1)
                np.add.at(mark, ((span & 0xFFFFFFFF) >> 1) + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[: len(words) - length + 1] > 0)
                out.append((roll.windows(sums, starts, length).view(np.int64), np.full(len(starts), th), starts))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["key", "th", "start"])

    return run


def repeated(rows: DataFrame, key: str, place: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns of those rows of a scratch table whose key occurs at more than one place; takes its place.

    A place is a text (th) and a place in it, so copies of one row do not count
    as two. Aggregates are partial before the shuffle; the keys found are a
    table of their own so that adaptive execution can split the rows of a
    frequent key.
    """
    at = F.xxhash64("th", place)
    often = scratch(rows.groupBy(key).agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select(key), "repeated")
    out = scratch(rows.join(often, key, "left_semi").select(*columns), "alive")
    drop(often, rows)
    return out


def repeated_starts(texts: DataFrame, length: int) -> DataFrame:
    """(th, starts): starts of the windows of length words that occur at another place in any different text, or in their own.

    texts has th (a hash of the text) and text; equal texts are one. Level one
    counts one anchor per span; only windows around repeated anchors are
    extended to twice the length and counted again, until the target length. In
    the last level every start left is a window of its own. What is collected
    for a text is bounded by its number of words, however often it is repeated.
    """
    rows = scratch(texts.mapInArrow(_anchor_rows(length), ROWS), "anchors")
    alive = repeated(repeated(rows, "key", "span", ("th", "span", "next")), "next", "span", ("th", "span"))
    spans = scratch(alive.groupBy("th").agg(F.collect_set("span").alias("spans")), "spans")
    windows = scratch(texts.join(spans, "th").select("th", "text", "spans").mapInArrow(_window_rows(length), "key long, th long, start long"), "windows")
    drop(alive, spans)
    left = repeated(windows, "key", "start", ("th", "start"))
    starts = scratch(left.groupBy("th").agg(F.collect_set("start").alias("starts")), "starts")
    drop(left)
    return starts


def keep(words: list[bytes], starts: list[int] | None, length: int) -> list[bytes]:
    """Words outside all windows of length words at the starts."""
    if not starts:
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.asarray(starts))
    mark[at] += 1
    mark[at + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, texts = [], [], [], []
            for text, starts, copied in zip(batch.column("text"), batch.column("starts"), batch.column("copied"), strict=True):
                words = (text.as_py() or "").encode().split()
                kept = [] if copied.as_py() and len(words) >= length else keep(words, starts.as_py(), length)
                joined = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(text.as_py() if len(kept) == len(words) else joined.decode())
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                columns["kept"] = pa.array(texts, pa.string())
                columns |= {c: batch.column(c) for c in batch.schema.names if c.startswith("__carried")}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


RESULT = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def remove_repeats(docs: DataFrame, length: int = 35, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove from each text the words inside windows of length words that occur elsewhere.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words joined
    by one space), and with_text also kept and the columns in carry; a text that
    loses nothing is kept as it is. A column in carry that is called like one
    of the results is left out. Null and empty texts have no words; texts of
    fewer than length words lose none. A text that several rows have loses all
    its windows, as each occurs in the others; its windows are formed once.
    Null doc_ids stay null. Texts and windows are compared by 64-bit hashes. An
    empty table gives an empty result.
    """
    held = {f"__carried{n}": c for n, c in enumerate(dict.fromkeys(carry)) if c not in RESULT}
    base = docs.select("doc_id", "text", *[F.col(c).alias(h) for h, c in held.items()]).withColumn("th", F.xxhash64("text"))
    copied = scratch(base.groupBy("th").count().where("count > 1").select("th", F.lit(True).alias("copied")), "copied")
    starts = repeated_starts(base.select("th", "text"), length).join(copied, "th", "left_anti")
    found = starts.select("th", "starts", F.lit(False).alias("copied")).unionByName(copied.select("th", F.lit(None).cast("array<long>").alias("starts"), "copied"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        types = dict(docs.dtypes)
        schema += ", kept string" + "".join(f", {h} {types[c]}" for h, c in held.items())
    cut = base.join(found, "th", "left").select("doc_id", "text", "starts", "copied", *held).mapInArrow(_cut(length, with_text), schema)
    return cut.withColumnsRenamed(held) if with_text else cut


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated 35-word windows of `documents` cover, removed; odd rows as in remove_repeats."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM p),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM h WHERE n > 1),
u AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
f AS (
  SELECT u.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN f USING (doc_id)
"""
