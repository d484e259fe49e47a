"""Terms of a dictionary in texts: one pass over each text, however many terms there are."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MOST, SLICE_ROWS = 10_000, 20_000
HITS = pa.list_(pa.struct([("owner", pa.int64()), ("n", pa.int32())]))
HITS_DDL = "array<struct<owner:bigint,n:int>>"


def _automaton(pairs: list[tuple[str, int]]) -> ahocorasick.Automaton:
    owners: dict[str, set[int]] = {}
    for term, owner in pairs:
        owners.setdefault(term, set()).add(owner)
    automaton = ahocorasick.Automaton()
    for term, of in owners.items():
        automaton.add_word(term, (term, tuple(of)))
    automaton.make_automaton()
    return automaton


def _found(batch: pa.RecordBatch, column: str, automaton: ahocorasick.Automaton) -> pa.RecordBatch:
    found = []
    for text in batch.column(column):
        n: dict[int, int] = {}
        last: dict[str, int] = {}
        for end, (term, owners) in automaton.iter(text.as_py() or ""):
            if end - len(term) >= last.get(term, -1):  # occurrences of one term do not overlap
                last[term] = end
                for owner in owners:
                    n[owner] = n.get(owner, 0) + 1
        found.append([{"owner": o, "n": k} for o, k in n.items()])
    rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, HITS)], names=[*batch.schema.names, "hits"])
    return rows.filter(pa.array([bool(f) for f in found], pa.bool_()))


def _scan(column: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            yield _found(batch, column, automaton)

    return run


def find_terms(rows: DataFrame, column: str, terms: DataFrame, most: int = MOST) -> DataFrame:
    """Rows whose text holds any term, with `hits`: the terms' owners and how often their terms occur.

    terms: owner (long) and term, compared as they are; occurrences of one term
    do not overlap. A worker scans for about `most` terms at a time with an
    automaton, so time grows with the texts and not with the dictionary. Only a
    dictionary of `most` different pairs passes the driver; a larger one is
    dealt into parts, which meet slices of the rows in tasks of their own, and a
    row then comes once for each part that it has hits of. Null and empty terms
    and texts have no hits.
    """
    spark = rows.sparkSession
    known = terms.select(F.col("owner").cast("long").alias("owner"), "term").where("term <> ''").distinct()
    parts = max(1, math.ceil(known.count() / most))
    schema = StructType([*rows.schema.fields, StructField("hits", StructType.fromDDL(f"h {HITS_DDL}")["h"].dataType)])
    if parts == 1:
        pairs = [(r.term, r.owner) for r in known.collect()]  # `most` at most
        return rows.mapInArrow(_scan(column, spark.sparkContext.broadcast(pairs)), schema) if pairs else spark.createDataFrame([], schema)
    slices = max(1, math.ceil(rows.count() / SLICE_ROWS))
    part, slice_ = (F.col(c) for c in ("__part", "__slice"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("__slice", F.pmod(F.xxhash64(column, F.monotonically_increasing_id()), F.lit(slices)).cast("int")).withColumn("__part", numbers(parts))
    each = known.withColumn("__part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).withColumn("__slice", numbers(slices))

    def meet(own: pa.Table, some: pa.Table) -> pa.Table:
        own = own.drop_columns(["__slice", "__part"])
        if not own.num_rows or not some.num_rows:
            return own.slice(0, 0).append_column("hits", pa.array([], HITS))
        automaton = _automaton(list(zip(some.column("term").to_pylist(), some.column("owner").to_pylist(), strict=True)))
        return pa.Table.from_batches([_found(batch, column, automaton) for batch in own.to_batches()])

    return dealt.groupBy(part, slice_).cogroup(each.groupBy(part, slice_)).applyInArrow(meet, schema)
