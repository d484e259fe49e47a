"""A stored vector index: a layered navigable graph for each shard, built and searched on executors.

A shard is a bounded number of vectors, dealt by a hash. Its nodes are in layer
0, a sixteenth of them in layer 1 too, and so on. In a layer a node is linked
to near nodes in different directions, and to its nearest node of the next
layer and back, so whatever is in a shard can be reached from its top.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators.retrieval import top

LINKS, EF, SHARD_ROWS = 16, 64, 4096
NODES = "shard int, place int, chunk_id long, embedding array<float>, links array<array<int>>"
_NODES = pa.schema([("shard", pa.int32()), ("place", pa.int32()), ("chunk_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("links", pa.list_(pa.list_(pa.int32())))])
_HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("similarity", pa.float64()), ("computed", pa.int64())])


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def diverse(x: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of nearness those that are nearer to the node than to any one chosen before."""
    chosen: list[int] = []
    for j, s in zip(near.tolist(), score.tolist(), strict=True):
        if len(chosen) == most:
            break
        if not chosen or (x[chosen] @ x[j]).max() <= s:
            chosen.append(j)
    return chosen


def build_shard(x: np.ndarray, seed: int, links: int = LINKS, candidates: int = EF) -> list[list[list[int]]]:
    """Links of each node in each of its layers; x holds unit vectors."""
    n = len(x)
    u = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(links)).astype(int)
    out: list[list[set[int]]] = [[set() for _ in range(v + 1)] for v in level.tolist()]
    for layer in range(int(level.max(initial=0)) + 1):
        members = np.flatnonzero(level >= layer)
        above = np.flatnonzero(level > layer)
        for start in range(0, len(members), 512):
            own = members[start : start + 512]
            scores = x[own] @ x[members].T
            k = min(candidates + 1, len(members))
            picks = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            for row, i in enumerate(own.tolist()):
                p = picks[row][np.argsort(-scores[row, picks[row]], kind="stable")]
                near = members[p]
                keep = near != i
                for j in diverse(x, near[keep], scores[row, p][keep], links):
                    out[i][layer].add(j)
                    if len(out[j][layer]) < 2 * links:
                        out[j][layer].add(i)
            if len(above):
                parent = above[np.argmax(x[own] @ x[above].T, axis=1)]
                for i, p in zip(own.tolist(), parent.tolist(), strict=True):
                    if level[i] == layer:
                        out[i][layer].add(p)
                        out[p][layer].add(i)
    return [[sorted(s) for s in layers] for layers in out]


def search_shard(x: np.ndarray, links: list[list[list[int]]], q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None) -> tuple[list[tuple[float, int]], int]:
    """The k best nodes found (similarity, place), and how many similarities were computed.

    Nodes that are not allowed are passed through, and do not count among the
    ef that end the search, so a filter costs steps and no results.
    """
    height = max(map(len, links), default=0)
    start = [i for i, layers in enumerate(links) if len(layers) == height]
    seen_scores: dict[int, float] = {}

    def score(nodes: list[int]) -> None:
        fresh = [i for i in nodes if i not in seen_scores]
        if fresh:
            seen_scores.update(zip(fresh, (x[fresh] @ q).tolist(), strict=True))

    for layer in range(height - 1, -1, -1):
        ok = allowed if layer == 0 else None
        score(start)
        seen = set(start)
        open_ = [(-seen_scores[i], i) for i in start]
        heapq.heapify(open_)
        best = [(seen_scores[i], i) for i in start if ok is None or ok[i]]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) == ef and -s < best[0][0]:
                break
            fresh = [j for j in links[i][layer] if j not in seen]
            seen.update(fresh)
            score(fresh)
            for j in fresh:
                s = seen_scores[j]
                if len(best) < ef or s > best[0][0]:
                    heapq.heappush(open_, (-s, j))
                    if ok is None or ok[j]:
                        heapq.heappush(best, (s, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        start = [i for _, i in best] or start
    return sorted(best, key=lambda b: (-b[0], b[1]))[:k], len(seen_scores)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a vector in double precision, summed from the first component to the last, so that equal rows have equal ones."""
    out = np.zeros(len(x))
    for column, v in zip(x.T.astype(np.float64), q.astype(np.float64), strict=True):
        out += column * v
    return out


def complete(x: np.ndarray, raw: np.ndarray, q: np.ndarray, found: list[int], k: int, allowed: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """The k nearest nodes and their cosines, given what a search found: all that may be as near as its k-th hit are compared.

    x holds unit vectors in single precision, whose error the margin covers.
    Nodes as near as the k-th are all returned.
    """
    size = np.sqrt(products(q[None], q))[0]
    exact = lambda places: np.array([]) if not len(places) else np.array(products(raw[places], q) / (np.sqrt(sum(c * c for c in raw[places].T)) * size))
    known = np.sort(exact(found))[::-1]
    least = known[k - 1] - 1e-5 if len(known) >= k else -np.inf
    rough = x @ (q / size).astype(np.float32)
    places = np.flatnonzero((rough >= least) if allowed is None else (rough >= least) & allowed)
    scores = exact(places)
    if len(scores) > k:
        keep = scores >= np.sort(scores)[-k]
        places, scores = places[keep], scores[keep]
    return places.tolist(), scores


def _build(shard: tuple, rows: pa.Table) -> pa.Table:
    ids = rows.column("chunk_id").to_numpy()
    x = np.array(rows.column("embedding").to_pylist(), np.float32)
    links = build_shard(unit(x), int(shard[0].as_py()))
    columns = [[shard[0].as_py()] * len(ids), range(len(ids)), ids, x.tolist(), links]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)


def build(chunks: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Write the graphs of chunks (chunk_id, embedding), vectors of one length; null and zero vectors are left out.

    Shards hold about shard_rows vectors each, whatever these are, and are built
    each in its own task.
    """
    known = chunks.where("embedding is not null and exists(embedding, v -> v <> 0) and not exists(embedding, v -> v is null or isnan(v))").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    shards = max(1, math.ceil(known.count() / shard_rows))
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int"))
    dealt.groupBy("shard").applyInArrow(_build, NODES).write.mode("overwrite").partitionBy("shard").parquet(path)


def leg(spark: SparkSession, path: str, queries: DataFrame, k: int, ef: int = 2 * EF, allowed: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, similarity, rank, computed): the k nearest found of each question, by cosine.

    Every shard is searched for every question, and the k best of each are
    merged. `allowed` (chunk_id) filters before the cut. With `exact` a check
    follows in each shard that adds what its graph missed, so the hits are those
    of brute force, ties by chunk_id. computed is the number
    of similarities computed for a question in the shard that a hit is from.
    """
    nodes = spark.read.schema(NODES).parquet(path)
    nodes = nodes.withColumn("ok", F.lit(True)) if allowed is None else nodes.join(allowed.select("chunk_id").distinct().withColumn("_ok", F.lit(True)), "chunk_id", "left").withColumn("ok", F.col("_ok").isNotNull()).drop("_ok")
    shards = (spark.read.schema(NODES).parquet(path).agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.where("query_vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<float>").alias("query_vector"))
    each = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # every shard is asked

    def run(key: tuple, own: pa.Table, questions: pa.Table) -> pa.Table:
        order = np.argsort(own.column("place").to_numpy())
        raw = np.array(own.column("embedding").to_pylist(), np.float64).reshape(len(order), -1)[order]
        x = unit(raw).astype(np.float32)
        links, ids, ok = own.column("links").to_pylist(), own.column("chunk_id").to_numpy()[order], own.column("ok").to_numpy()[order]
        links = [links[i] for i in order.tolist()]
        rows: list[tuple] = []
        for query_id, vector in zip(questions.column("query_id").to_pylist(), questions.column("query_vector").to_pylist(), strict=True):
            q = unit(np.array([vector], np.float32))[0]
            if len(order) and q.any():
                hits, computed = search_shard(x, links, q, k, max(ef, k), None if ok.all() else ok)
                places, wide = [i for _, i in hits], np.array(vector, np.float64)
                if exact:
                    places, scores = complete(x, raw, wide, places, k, None if ok.all() else ok)
                else:
                    scores = unit(raw[places]) @ unit(wide[None])[0] if places else []
                rows += [(query_id, int(ids[i]), float(s), computed) for i, s in zip(places, scores, strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(_HITS)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

    found = nodes.groupBy("shard").cogroup(each.groupBy("shard")).applyInArrow(run, "query_id long, chunk_id long, similarity double, computed long")
    return top(found, k, F.desc("similarity"), F.asc("chunk_id"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (query_id, chunk_id) that were found."""
    both = exact.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").count()
    return both / max(1, exact.count())
