"""Connected components of a distributed edge table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import discard, scratch

EDGES_PER_TASK, KEPT_NODES, LEAST_TASKS = 1 << 20, 1 << 19, 4


def root(parent: dict[int, int] | list[int], x: int) -> int:
    """The representative of x in a forest of parents, halving the path to it."""
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join what those before them left apart; of nodes met a bounded number is remembered."""
    parent: dict[int, int] = {}
    for batch in batches:
        u, v = np.asarray(batch.column("u")), np.asarray(batch.column("v"))
        kept = []
        if len(parent) > KEPT_NODES:
            parent = {}
        for n, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            x, y = root(parent, parent.setdefault(a, a)), root(parent, parent.setdefault(b, b))
            if x != y:
                parent[x] = y
                kept.append(n)
        yield pa.record_batch([pa.array(u[kept], pa.int64()), pa.array(v[kept], pa.int64())], names=["u", "v"])


def thinned(edges: DataFrame) -> DataFrame:
    """A scratch table of fewer edges that connect the same nodes: a forest of each task's share.

    Links found many times over, as those of a large group in many grids, would
    else be read in every round. Forests of many tasks are thinned again by
    fewer, while that halves them, so what is left grows with the nodes and not
    with the tasks. Forgetting a node keeps edges, never loses one, so memory is
    bounded and the components are the same.
    """
    left = scratch(edges.where("u is not null and v is not null and u <> v").select("u", "v"), "edges")
    count = left.count()
    while True:
        tasks = max(LEAST_TASKS, math.ceil(count / EDGES_PER_TASK))
        out = scratch(left.coalesce(tasks).mapInArrow(_forest, "u long, v long"), "edges")
        discard(left)
        before, left, count = count, out, out.count()
        if tasks == LEAST_TASKS or 2 * count > before:
            return left


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (u, v); label is the component's smallest node.

    Each round a node takes the smallest label among its neighbours and then
    the label of its label, so paths shrink by half at least. Labels are a
    table in the shared folder after every round, both as the cut of the
    lineage and so that joins on a frequent node read plain shuffles, which
    adaptive execution splits; those of earlier rounds are removed. Null ends,
    loops and repeated edges do no harm; no edges give an empty result.
    """
    few = thinned(edges)
    pairs = scratch(few.union(few.select("v", "u")), "edges")
    discard(few)
    label = scratch(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels")
    while True:
        near = pairs.join(label.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "label")
        lower = scratch(near.union(label).groupBy("node").agg(F.min("label").alias("label")), "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch(lower.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        moved = new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        discard(lower, label)
        label = new
        if not moved:
            discard(pairs)
            return label
