"""Blocks of vectors: how the searches meet queries with all rows.

A search takes a stated set of queries against every row. Rows are dealt to
shards and queries to blocks, both of bounded size and by a number of the row,
and a kernel sees one shard with one block. Nothing is broadcast, no pair
becomes a row, and a group of equal vectors, or of rows of one id, is spread
over all shards like any others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.common import blocks, scratch


def finite(vector: str) -> Column:
    """True where the vector is there and has no null, NaN or infinite component."""
    big = float("inf")
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(big)))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of doubles; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.diff(np.asarray(column.offsets))
    width = int(lengths.max(initial=0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if n and (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), lengths), np.concatenate([np.arange(k) for k in lengths] or [[]]).astype(int)] = flat
    return out


def wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return (np.pad(a, ((0, 0), (0, width - a.shape[1]))), np.pad(b, ((0, 0), (0, width - b.shape[1]))))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """(id, vec, number): the rows that have an id, each with a number of its own, as a scratch table.

    Repeated ids are so told apart. The table fixes the numbers; a task that
    runs again reads the same ones.
    """
    return scratch(df.where("id is not null").select("id", "vec", F.monotonically_increasing_id().alias("number")), name)


def plan_blocks(rows: DataFrame, queries: DataFrame, shard_rows: int, block_rows: int) -> tuple[int, int]:
    """Numbers of shards and query blocks from the two counts."""
    return blocks(rows.count(), shard_rows), blocks(queries.count(), block_rows)


def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
    """Deal numbered rows to parts of one side, a copy for each part of the other side."""
    return df.withColumn(own, F.pmod("number", F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The k best hits of each query row over all shards; each shard sent k at most."""
    w = Window.partitionBy("query").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
