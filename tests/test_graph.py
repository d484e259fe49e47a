"""The stored vector graphs against brute force: recall, filters, copies, clusters, odd vectors."""

import numpy as np

from archivolt.operators import graph, retrieval


def recall_at(x, links, k, ef, allowed=None, every=20):
    hit = total = computed = 0
    for i in range(0, len(x), every):
        scores = x @ x[i]
        if allowed is not None:
            scores = np.where(allowed, scores, -2)
        least = np.sort(scores)[-k]
        got, n = graph.search_shard(x, links, x[i], k, ef, allowed)
        assert len({j for _, j in got}) == len(got) == k and (allowed is None or all(allowed[j] for _, j in got))
        hit, total, computed = hit + sum(s >= least - 1e-6 for s, _ in got), total + k, computed + n
    return hit / total, computed * every / len(x)


def test_recall_in_a_shard():
    r = np.random.default_rng(5)
    plain = graph.unit(r.normal(size=(1500, 48)).astype(np.float32))
    clusters = graph.unit((r.normal(size=(40, 48))[r.integers(0, 40, 1500)] + 0.3 * r.normal(size=(1500, 48))).astype(np.float32))
    copies = np.concatenate([plain[:700], np.repeat(plain[:1], 500, axis=0)])
    for x, share in ((plain, 1.0), (clusters, 0.5), (copies, 1.0)):
        links = graph.build_shard(x, 3)
        assert all(i in links[j][n] or len(links[j][n]) >= 2 * graph.LINKS for i, layers in enumerate(links) for n, of in enumerate(layers) for j in of)
        found, computed = recall_at(x, links, 10, 64)
        assert found >= 0.98 and computed <= share * len(x)
        assert recall_at(x, links, 10, 64, np.arange(len(x)) % 3 == 0)[0] >= 0.98
        assert recall_at(x, links, 5, 64, np.arange(len(x)) % 100 == 0)[0] >= 0.95
    assert graph.build_shard(plain[:0], 1) == [] and graph.build_shard(plain[:1], 1)[0][0] == []
    assert graph.search_shard(plain[:1], [[[]]], plain[0], 5, 64)[0][0][1] == 0


def test_stored_graphs_over_shards(spark, tmp_path):
    r = np.random.default_rng(7)
    x = r.normal(size=(900, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(n, [float(c) for c in x[n] + 0.1 * r.normal(size=24)]) for n in range(40)] + [(99, None)], "query_id int, query_vector array<double>")
    path = str(tmp_path / "graph")
    graph.build(chunks, path, shard_rows=200)
    assert spark.read.parquet(path).select("shard").distinct().count() == 5
    exact = retrieval.vector_leg(chunks.where("chunk_id < 2000"), queries, 10)
    found = graph.leg(spark, path, queries, 10)
    assert graph.recall(found, exact) >= 0.98 and found.groupBy("query_id").count().where("count <> 10").count() == 0
    allowed = chunks.where("chunk_id % 5 = 0")
    few = graph.leg(spark, path, queries, 10, allowed=allowed)
    assert few.where("chunk_id % 5 <> 0").count() == 0
    assert graph.recall(few, retrieval.vector_leg(allowed.where("chunk_id < 2000"), queries, 10)) >= 0.98


def test_checked_hits_are_those_of_brute_force(spark, tmp_path):
    """What a graph misses, among vectors without any structure and copies of one, the check adds."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(3000, 64)), np.repeat(r.normal(size=(1, 64)), 60, axis=0)]).astype(np.float32)
    chunks = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(n, [float(c) for c in x[n] + (0 if n > 2990 else r.normal(size=64))]) for n in (*range(60), 3030)], "query_id int, query_vector array<float>")
    path = str(tmp_path / "graph")
    graph.build(chunks, path, shard_rows=1600)
    rows = lambda df: {(h.query_id, h.rank): (h.chunk_id, round(h.similarity, 10)) for h in df.collect()}
    for allowed in (None, chunks.where("chunk_id % 7 = 0")):
        want = rows(retrieval.vector_leg(chunks if allowed is None else allowed, queries, 10))
        assert rows(graph.leg(spark, path, queries, 10, ef=4, allowed=allowed, exact=True)) == want
    assert rows(graph.leg(spark, path, queries, 10, ef=4)) != rows(retrieval.vector_leg(chunks, queries, 10))
