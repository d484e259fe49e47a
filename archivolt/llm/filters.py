"""Filter interaction audit: what each filter removes in every order of five.

Texts are scanned as Arrow buffers by NumPy; a document becomes a mask of the
filters that it fails. Masks are counted per part, and the counts alone tell
what every order of the filters keeps, removes and loses.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"
SPACE, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8
SLICE = 1 << 21  # bytes of text that are looked at together
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# The classes of each byte: white space, A-Z, a symbol, the start of a code point.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[32, *range(9, 14)]] |= SPACE
CLASSES[65:91] |= CAPITAL
CLASSES[[ord(c) for c in SYMBOLS]] |= SYMBOL
CLASSES[:128] |= POINT
CLASSES[192:] |= POINT


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier modulo 2^64 and their inverses."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    out = []
    for base in (MULTIPLIER, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


POWERS, INVERSES = _powers(SLICE + 1)


def word_places(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    edges = np.flatnonzero(np.diff(np.concatenate([[1], space, [1]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, from prefix sums over their bytes; words reach over at most SLICE bytes together."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    part = data[first : ends[-1]].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * POWERS[: len(part)], dtype=np.uint64)])
    h = (sums[ends - first] - sums[starts - first]) * INVERSES[starts - first]
    return (h ^ (h >> np.uint64(29))) * MULTIPLIER


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the words at places a and b, of equal sizes, hold the same bytes."""
    out, n = np.ones(len(a), bool), 0
    while n < len(a):
        total = np.cumsum(sizes[n:])
        stop = n + max(1, int(np.searchsorted(total, SLICE, "right")))
        if stop == n + 1 and sizes[n] > SLICE:
            out[n] = data[a[n] : a[n] + sizes[n]].tobytes() == data[b[n] : b[n] + sizes[n]].tobytes()
        else:
            k = sizes[n:stop]
            before = np.cumsum(k) - k
            step = np.arange(int(k.sum())) - np.repeat(before, k)
            differs = data[np.repeat(a[n:stop], k) + step] != data[np.repeat(b[n:stop], k) + step]
            out[n:stop] = np.add.reduceat(differs, before) == 0
        n = stop
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Distinct words of each owner: hashes sorted by owner; words of equal hashes are compared byte by byte.

    Where different words of one owner share a hash, its words are counted as a set.
    """
    sizes = ends - starts
    hashes, n = np.zeros(len(starts), np.uint64), 0
    while n < len(starts):
        stop = max(n + 1, int(np.searchsorted(ends, starts[n] + SLICE, "right")))
        if stop == n + 1 and sizes[n] > SLICE:  # a word of its own length: its bytes are compared all the same
            hashes[n] = hash(data[starts[n] : ends[n]].tobytes()) & 0xFFFFFFFFFFFFFFFF
        else:
            hashes[n:stop] = word_hashes(data, starts[n:stop], ends[n:stop])
        n = stop
    order = np.lexsort((sizes, hashes, owner))
    o, h, k = owner[order], hashes[order], sizes[order]
    again = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    pairs = np.flatnonzero(again)
    same = k[pairs] == k[pairs + 1]
    same[same] = _same(data, starts[order[pairs[same]]], starts[order[pairs[same] + 1]], k[pairs[same]])
    out = np.bincount(owner, minlength=owners) - np.bincount(o[pairs], minlength=owners)
    for doc in np.unique(o[pairs[~same]]):
        mine = np.flatnonzero(owner == doc)
        out[doc] = len({data[starts[i] : ends[i]].tobytes() for i in mine})
    return out


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    out = {k: np.zeros(len(column), np.int64) for k in ("words", "distinct", "capitals", "symbols", "points")}
    n = 0
    while n < len(column):
        stop = max(n + 1, int(np.searchsorted(offsets, offsets[n] + SLICE, "right")) - 1)
        at, upto = offsets[n], offsets[stop]
        part, bounds = data[at:upto], offsets[n : stop + 1] - at
        kinds = CLASSES[part]
        for name, kind in (("capitals", CAPITAL), ("symbols", SYMBOL), ("points", POINT)):
            sums = np.concatenate([[0], np.cumsum((kinds & kind) != 0, dtype=np.int64)])
            out[name][n:stop] = np.diff(sums[bounds])
        # A byte of space in front of each text keeps words from reaching into the next.
        spaced = np.insert(kinds & SPACE, bounds[:-1], 1)
        starts, ends = word_places(spaced)
        shift = bounds[:-1] + np.arange(1, stop - n + 1)  # where texts start among the spaced bytes
        owner = np.searchsorted(shift, starts, "right") - 1
        starts, ends = starts - owner - 1, ends - owner - 1
        out["words"][n:stop] = np.bincount(owner, minlength=stop - n)
        out["distinct"][n:stop] = distinct_words(part, starts, ends, owner, stop - n)
        n = stop
    return out


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Masks of the filters A to D that texts fail, the lowest bit for A."""
    conditions = (
        counts["words"] < LEAST_WORDS,
        100 * counts["distinct"] < LEAST_DISTINCT * counts["words"],
        100 * counts["capitals"] > MOST_CAPITALS * counts["points"],
        counts["symbols"] > 0,
    )
    return sum(c.astype(np.int32) << bit for bit, c in enumerate(conditions))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(failed(text_counts(batch.column("text"))), pa.int32())], names=["doc_id", "part", "digest", "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each document: its source, a hash of its text, the filters of A to D that it fails."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(_masks, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail just these filters, and the good and toxic ones.

    A document fails E if a smaller doc_id has its text. Copies of a text are
    added up before they are shuffled by it, so a group of copies comes as a
    row for each part and label. A row without doc_id is no copy, has no label
    and is nobody's original; rows of one doc_id are not each other's copies;
    of several labels of a doc_id the higher counts.
    """
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    each = masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # Rows without doc_id meet nothing: their own part of the key keeps them spread.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    marked = each.withColumn("_s", spread).join(marks.withColumn("_t", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_s") == F.col("_t")), "left")
    known = F.col("doc_id").isNotNull()
    groups = marked.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("first_n"), F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("nameless")
    )
    met = groups.withColumn("least", F.min("first").over(Window.partitionBy("digest")))  # a row for each part and label
    original = F.coalesce(F.when(F.col("first") == F.col("least"), F.col("first_n")), F.lit(0)) + F.col("nameless")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n")))).alias("s")
    return met.select("part", "good", "toxic", split).groupBy("part", "s.mask").agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic")
    )


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def effects() -> dict[str, np.ndarray]:
    """For each order and step (rows) and mask (columns): does a document of the mask count?"""
    mask = np.arange(1 << len(FILTERS))
    bits = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    prior = np.cumsum(1 << bits, axis=1) - (1 << bits)
    own, before = (1 << bits).reshape(-1, 1), prior.reshape(-1, 1)
    fails, gone = (mask & own) > 0, (mask & before) > 0
    return {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask[None] == own}


def audit(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of a part, a row for each order and step, from its counts by mask."""
    out = {k: v @ counts for k, v in held.items()}
    out |= {"good_lost": held["removed"] @ good, "toxic_lost": held["removed"] @ toxic}
    letters = np.array([[FILTERS.index(c) for c in order] for order in ORDERS]).ravel()
    out["shapley"] = np.array([out["removed"][letters == n].sum() for n in range(len(FILTERS))])[letters]
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {k: v.astype(np.int64) for k, v in effects().items()}
    steps = len(FILTERS)
    orders = pa.array([o for o in ORDERS for _ in FILTERS])
    numbers = pa.array(list(range(1, steps + 1)) * len(ORDERS), pa.int32())
    for batch in batches:
        for part, cells in zip(batch.column("part"), batch.column("cells"), strict=True):
            table = np.zeros((3, 1 << steps), np.int64)
            for c in cells.as_py():
                table[:, c["mask"]] = c["n"], c["good"], c["toxic"]
            found = audit(*table, held)
            columns = [pa.array([part.as_py()] * len(orders), pa.string()), orders, numbers, *[pa.array(found[c], pa.int64()) for c in COLUMNS]]
            yield pa.record_batch(columns, names=["part", "filter_order", "step", *COLUMNS])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter keeps, removes and loses at each step of all orders, per source.

    A: under 200 words; B: distinct words are under half of all; C: more than 2
    in 100 code points are A-Z; D: holds one of #$%&*|; E: a smaller doc_id has
    the same text. A null text is empty, a null source is ''. An empty table
    has no parts and gives no rows. Other columns are not read.
    """
    cells = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return cells.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over whole `documents`; odd rows as in interactions."""
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
   regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(seq, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, seq[step] AS own, seq[1:step - 1] AS prior FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS own_fails, len(list_filter(prior, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS failing FROM m, s),
t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT own_fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own_fails AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (own_fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (own_fails AND failing = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (own_fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own_fails AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t"""
