"""Exact top-k by inner product: best-first search of M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.common import scratch
from archivolt.llm.vectors import best, dealt, finite, matrix, numbered, plan_blocks, same_width

PAGES = "shard int, page long, parent long, radius double, to_parent double, leaf boolean, pivot array<double>, ids array<long>, vectors array<double>, gaps array<double>"


class Page:
    """A node of the tree: its pivot, covering radius and distance to the parent's pivot.

    A leaf holds ids and vectors with their distances to the pivot (gaps); an
    inner node holds its children.
    """

    __slots__ = ("pivot", "radius", "to_parent", "ids", "vectors", "gaps", "children")

    def __init__(self, pivot, radius, to_parent):
        self.pivot, self.radius, self.to_parent = pivot, radius, to_parent
        self.ids = self.vectors = self.gaps = None
        self.children: list[Page] = []


def build(ids: np.ndarray, x: np.ndarray, capacity: int = 256, fan_out: int = 16, parent: np.ndarray | None = None) -> Page:
    """Bulk-load a tree over the rows of x, at most capacity of them to a leaf.

    Pivots are spread by farthest-first choice. Equal vectors that overfill a
    page are cut by position, as no distance can part them.
    """
    pivot = x.mean(axis=0)
    gaps = np.sqrt(((x - pivot) ** 2).sum(axis=1))
    page = Page(pivot, float(gaps.max(initial=0.0)), 0.0 if parent is None else float(np.sqrt(((pivot - parent) ** 2).sum())))
    if len(ids) <= capacity:
        order = np.argsort(gaps, kind="stable")
        page.ids, page.vectors, page.gaps = ids[order], x[order], gaps[order]
        return page
    chosen = [int(gaps.argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    group = np.zeros(len(ids), dtype=np.int64)
    for k in range(1, min(fan_out, -(-len(ids) // capacity))):
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
        d = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        group[d < near] = k
        near = np.minimum(near, d)
    if len(chosen) == 1 or np.bincount(group).max() == len(ids):
        group = np.arange(len(ids)) // capacity
    for k in np.unique(group):
        mine = group == k
        page.children.append(build(ids[mine], x[mine], capacity, fan_out, pivot))
    return page


def to_rows(root: Page, shard: int) -> Iterator[dict]:
    """The pages as rows; children point to their parent by number."""
    stack, number = [(root, -1)], 0
    while stack:
        page, parent = stack.pop()
        leaf = page.ids is not None
        yield {
            "shard": shard, "page": number, "parent": parent, "radius": page.radius, "to_parent": page.to_parent, "leaf": leaf, "pivot": page.pivot,
            "ids": page.ids if leaf else None, "vectors": page.vectors.ravel() if leaf else None, "gaps": page.gaps if leaf else None,
        }
        stack += [(c, number) for c in page.children]
        number += 1


def from_rows(table: pa.Table) -> Page:
    pages: dict[int, Page] = {}
    root = None
    rows = {c: table.column(c).combine_chunks() for c in table.column_names}
    order = np.argsort(np.asarray(rows["page"]))
    for i in map(int, order):
        pivot = np.asarray(rows["pivot"][i].values, dtype=np.float64)
        page = pages[rows["page"][i].as_py()] = Page(pivot, rows["radius"][i].as_py(), rows["to_parent"][i].as_py())
        if rows["leaf"][i].as_py():
            page.ids = np.asarray(rows["ids"][i].values)
            page.vectors = np.asarray(rows["vectors"][i].values, dtype=np.float64).reshape(len(page.ids), len(pivot))
            page.gaps = np.asarray(rows["gaps"][i].values)
        parent = rows["parent"][i].as_py()
        if parent < 0:
            root = page
        else:
            pages[parent].children.append(page)
    return root


def search(root: Page, q: np.ndarray, own: int, k: int, slack: float = 1e-9) -> list[tuple[int, int]]:
    """The k rows of greatest inner product with q, as (score, id), best first.

    For a pivot p with covering radius r, q.x = q.p + q.(x - p) <= q.p + |q| r:
    Cauchy's bound is the triangle inequality of the metric that the inner
    product has on the sphere to which vectors are lifted, without lifting
    them. Before q.p is computed for a child, the parent's product and the
    child's stored parent distance bound it: q.p <= q.parent + |q| d. Pages
    leave the queue best bound first; the search ends when the bound is below
    the k-th score. Bounds get a relative slack for rounding, so ties are kept.
    """
    length = float(np.sqrt(q @ q))
    hits: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first

    def cut(bound: float) -> bool:
        return len(hits) == k and bound + slack * (1.0 + abs(bound) + length) < hits[0][0]

    at_root = float(q @ root.pivot)
    queue = [(-(at_root + length * root.radius), 0, at_root, root)]
    ticket = 1
    while queue:
        bound, _, product, page = heapq.heappop(queue)
        if cut(-bound):
            break
        if page.ids is None:
            for child in page.children:
                if cut(product + length * (child.to_parent + child.radius)):
                    continue
                p = float(q @ child.pivot)
                if not cut(p + length * child.radius):
                    heapq.heappush(queue, (-(p + length * child.radius), ticket, p, child))
                    ticket += 1
            continue
        first = 0
        if len(hits) == k:  # gaps ascend: rows too near to the pivot cannot reach the k-th score
            need = (hits[0][0] - product - slack * (1.0 + abs(product) + length)) / length if length else -1.0
            first = int(np.searchsorted(page.gaps, need - slack)) if need > 0 else 0
        ids, scores = page.ids[first:], products(page.vectors[first:], q)
        mine = ids != own
        ids, scores = ids[mine], scores[mine]
        if len(hits) == k:
            mine = scores >= hits[0][0]
            ids, scores = ids[mine], scores[mine]
        if len(ids) > k:
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        for score, i in zip(scores.tolist(), ids.tolist(), strict=True):
            if len(hits) < k:
                heapq.heappush(hits, (score, -i))
            elif (score, -i) > hits[0]:
                heapq.heapreplace(hits, (score, -i))
    return [(s, -i) for s, i in sorted(hits, reverse=True)]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64, by doubles where they cannot round."""
    most = max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0))
    if most * most * max(1, len(q)) < 2.0**53:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def build_shard(key: tuple, table: pa.Table) -> pa.Table:
    root = build(np.asarray(table.column("id")), matrix(table.column("vec")))
    return pa.Table.from_pylist(list(to_rows(root, key[0].as_py())), schema=_PAGES)


_PAGES = pa.schema(
    [("shard", pa.int32()), ("page", pa.int64()), ("parent", pa.int64()), ("radius", pa.float64()), ("to_parent", pa.float64()), ("leaf", pa.bool_())]
    + [("pivot", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("gaps", pa.list_(pa.float64()))]
)


def search_shard(k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if len(pages) and len(queries):
            root = from_rows(pages.drop_columns(["block"]))
            q = matrix(queries.column("vec"))
            q, wide = same_width(q, root.pivot[None, :])
            if wide.shape[1] > len(root.pivot):
                widen(root, wide.shape[1])
            for number, own, vector in zip(queries.column("number").to_pylist(), queries.column("id").to_pylist(), q, strict=True):
                found += [(number, own, i, s) for s, i in search(root, vector, own, k)]
        cols = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query", "query_id", "vec_id", "score"])

    return run


def widen(page: Page, width: int) -> None:
    page.pivot = np.pad(page.pivot, (0, width - len(page.pivot)))
    if page.ids is not None:
        page.vectors = np.pad(page.vectors, ((0, 0), (0, width - page.vectors.shape[1])))
    for child in page.children:
        widen(child, width)


def inner_product_topk(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """The k rows of highest integer inner product for each query.

    rows and queries have id (long) and vec (array<double>, integers). Rows are
    dealt evenly to shards; each shard becomes an M-tree whose
    pages are rows of a table, and each block of queries searches each tree. A
    query's own id is no hit for it. Ties go to the smaller id; a query with
    fewer rows gets them all. Shorter vectors count as filled up with zeros.
    Rows without an id take no part. Rows of a repeated id are separate rows:
    each is a hit of its own, and as a query each gets k hits of its own, so
    that a query_id and rank may occur more than once. Other columns are not
    read. Empty tables give an empty result.
    """
    rows, queries = numbered(rows, "vectors"), numbered(queries, "queries")
    shards, parts = plan_blocks(rows, queries, shard_rows, block_rows)
    sharded = dealt(rows, "shard", shards, "block", 1).drop("block")
    pages = scratch(sharded.groupBy("shard").applyInArrow(build_shard, PAGES), "mtree")
    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = dealt(queries, "block", parts, "shard", shards)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search_shard(k), "query long, query_id long, vec_id long, score long")
    return best(found, k, [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of `embeddings` by inner product of floor(256 x)."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    rows = table.where(finite("embedding")).select(F.col("vec_id").alias("id"), scaled.alias("vec"))
    return inner_product_topk(rows, rows.where("id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
