"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.common import scratch, unused

CELLS = 1 << 16


def ring_cell(key: str, cells: int = CELLS) -> Column:
    """The cell of the ring that a key falls into; a null key has one of its own."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(cells)).cast("int")


def ring(shards: int, virtual_nodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Points (cell, shard) of all virtual nodes in ring order.

    A point's place comes from its shard's and its own number only, so that
    another number of shards leaves the points of those that stay in place.
    """
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big") % cells, shard))
    return sorted(points)


def _walks(points: list[tuple[int, int]]) -> list[list[int]]:
    """For each point the distinct shards met going clockwise from it."""
    shards = len({s for _, s in points})
    walks = []
    for start in range(len(points)):
        walk: list[int] = []
        at = start
        while len(walk) < shards:
            shard = points[at % len(points)][1]
            if shard not in walk:
                walk.append(shard)
            at += 1
        walks.append(walk)
    return walks


def place(counts: dict[int, int], shards: int, virtual_nodes: int, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Share out the keys of each cell: rows (cell, from, to, shard, first slot).

    Keys ask the shard of the first point clockwise from their cell. A shard
    takes n // shards keys, and one more for the first n % shards shards; what
    it cannot take asks the next shard clockwise, round after round. Capacities
    add up to n, so after as many rounds as shards every key has a place and
    shard sizes differ by one at most. Keys number from..to-1 of their cell, in
    key order, go to the shard and take its slots from the first slot on.
    """
    points = ring(shards, virtual_nodes, cells)
    walks = _walks(points)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    waiting = []
    at = 0
    for cell in range(cells):
        while at < len(points) and points[at][0] < cell:
            at += 1
        if counts.get(cell):
            waiting.append((cell, 0, at % len(points)))
    rows = []
    for turn in range(shards):
        left = []
        for cell, start, point in waiting:
            shard = walks[point][turn]
            taken = min(room[shard], counts[cell] - start)
            if taken:
                rows.append((cell, start, start + taken, shard, slot[shard]))
                room[shard] -= taken
                slot[shard] += taken
            if start + taken < counts[cell]:
                left.append((cell, start + taken, point))
        waiting = left
    return rows


def bounded_ring(df: DataFrame, key: str, shards: int = 8, virtual_nodes: int = 128, cells: int = CELLS, hot_rows: int = 200_000) -> DataFrame:
    """Add shard and slot to df by consistent hashing with bounded loads.

    Shard sizes differ by one row at most (the law `rows`). Only the count of
    each ring cell, a table of `cells` rows however large df is, comes to the
    driver and goes back as a table for a broadcast join; rows are numbered
    within their cell, so the work spreads over all cells. Repeated keys fall
    into one cell: there they are told apart by all their columns' hash, and
    equal rows in any order. Rows with a null key share one cell. A cell of more
    than hot_rows rows and four times the average, as one key or null may make
    it, is numbered in parts (`_parts`). An empty df gives an empty result.
    df's own columns called shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    cell, low, high, first, at, start, row, part, salt = unused(df.columns, *(f"__ring_{x}" for x in ("cell", "from", "to", "slot", "at", "start", "row", "part", "salt")))
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    placed = df.withColumn(cell, ring_cell(key, cells))
    counts = {r[0]: r[1] for r in placed.groupBy(cell).count().collect()}
    limit = max(hot_rows, 4 * sum(counts.values()) // cells)
    hot = [(c, -(-n // limit)) for c, n in counts.items() if n > limit]
    within = [cell]
    if hot:
        placed, within = _parts(placed, hot, limit, content, cell, part, salt, row, start), [cell, part, salt]
    schema = T.StructType(
        [T.StructField(cell, T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in (low, high)]
        + [T.StructField("shard", T.IntegerType()), T.StructField(first, T.LongType())]
    )
    shares = spark.createDataFrame(place(counts, shards, virtual_nodes, cells), schema)
    number = F.row_number().over(Window.partitionBy(*within).orderBy(F.col(key), content)).cast("long") - 1
    numbered = placed.withColumn(at, number + F.col(start) if hot else number)
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    joined = numbered.join(F.broadcast(shares), cell).where(inside)
    return joined.select(*df.columns, "shard", (F.col(first) + F.col(at) - F.col(low)).alias("slot"))


def _parts(placed: DataFrame, hot: list[tuple[int, int]], limit: int, content: Column, cell: str, part: str, salt: str, row: str, start: str) -> DataFrame:
    """Rows with the part of their cell, a salt in it, and the number of rows in the parts before.

    Rows of a hot cell are dealt to parts by their content. A part that is
    still too large consists of equal rows but for a few; it is dealt further by
    a number of the row, which a scratch table fixes. There are at most
    cells / 4 hot cells, and as many parts and salts again, so the tables of
    them are bounded however large the input is; no task numbers more than
    about four times the limit.
    """
    spark = placed.sparkSession
    fixed = scratch(placed.withColumn(row, F.monotonically_increasing_id()), "ring")
    parts = spark.createDataFrame(hot, f"`{cell}` int, `{part}` long")
    dealt = fixed.join(F.broadcast(parts), cell, "left").withColumn(part, F.coalesce(F.pmod(content, F.col(part)), F.lit(0)))
    is_hot = F.col(cell).isin([c for c, _ in hot]) if len(hot) < 100 else F.lit(True)
    large = dealt.where(is_hot).groupBy(cell, part).count().where(F.col("count") > 4 * limit).collect()
    salts = spark.createDataFrame([(c, p, -(-n // limit)) for c, p, n in large], f"`{cell}` int, `{part}` long, `{salt}` long")
    dealt = dealt.join(F.broadcast(salts), [cell, part], "left").withColumn(salt, F.coalesce(F.pmod(F.col(row), F.col(salt)), F.lit(0)))
    sizes = dealt.join(F.broadcast(parts.select(cell)), cell, "left_semi").groupBy(cell, part, salt).count().orderBy(cell, part, salt).collect()
    rows, last, before = [], None, 0
    for c, p, s, n in sizes:
        before = before if c == last else 0
        rows.append((c, p, s, before))
        last, before = c, before + n
    starts = spark.createDataFrame(rows, f"`{cell}` int, `{part}` long, `{salt}` long, `{start}` long")
    return dealt.join(F.broadcast(starts), [cell, part, salt], "left").withColumn(start, F.coalesce(start, F.lit(0))).drop(row)


def shard_documents(docs: DataFrame, shards: int = 8, virtual_nodes: int = 128) -> DataFrame:
    """Shard documents by doc_id; null texts have no bytes, and size 1. Other columns are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return bounded_ring(rows, "doc_id", shards, virtual_nodes)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in eight shards by the law `rows`; null ids share a ring cell, an empty table gives none."""
    sharded = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
