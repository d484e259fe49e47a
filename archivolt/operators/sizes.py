"""Joins without a key, chosen by the measured size of the smaller side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_BYTES = 10_000, 16 << 20


def meet(rows: DataFrame, few: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every row with every row of a stated set, such as questions or a dictionary.

    A set of up to `most` rows and most_bytes is broadcast; one job counts
    both. A larger one is dealt into blocks of about that size, and each block
    meets the rows in tasks of its own, so nothing larger than a block is held
    anywhere.
    """
    n, size = few.select(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    parts = max(math.ceil(n / most), math.ceil(size / most_bytes))
    if parts <= 1:
        return rows.crossJoin(F.broadcast(few))
    block = "__block"
    while block in rows.columns or block in few.columns:
        block += "_"
    right = few.withColumn(block, F.pmod(F.xxhash64(*few.columns), F.lit(parts)))
    left = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.join(right, block).drop(block)
