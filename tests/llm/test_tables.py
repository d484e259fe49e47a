"""Searches, sharding, dedup and the pipeline: against brute force and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from archivolt.llm import ann, components, langid, queries, sharding, simhash, substring, topk, toxicity

from .conftest import prose

SF = "/root/testdata/sf0.001"


def odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=5)]) for i in range(300)] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 5), (800, [float("inf")] * 5), (900, [0.0] * 5), (1000, [2.0, 1.0]), (None, [1.0] * 5), (100, [3.0] * 5)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS shard", "'x' AS block", "3 AS score")


def stored(spark, df, tmp_path, name="embeddings"):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def usable(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, np.pad(np.array(v, float), (0, 5 - len(v)))) for i, v in rows]


def test_op3_is_brute_force(spark, tmp_path):
    df = odd_vectors(spark)
    got = {}
    for r in topk.op3_exact_topk(spark, stored(spark, df, tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(i, np.floor(256 * v).astype(int)) for i, v in usable(df)]
    repeated = {i for i, n in Counter(i for i, _ in rows).items() if n > 1}
    for q, v in rows:
        if q % 50 == 0 and q not in repeated:
            best = sorted(((-int(v @ x), i) for i, x in rows if i != q))[:5]
            assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_a_small_tree_is_searched_exactly():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(3000, 8)) * r.choice([0.1, 1, 3], (3000, 1)))
    ids = r.permutation(3000)
    root = topk.build(ids, x, capacity=32, fan_out=4)
    table = topk.build_shard.__globals__["pa"].Table.from_pylist(list(topk.to_rows(root, 0)), schema=topk._PAGES)
    again = topk.from_rows(table)
    for n in range(40):
        want = sorted(zip((-(x @ x[n])).tolist(), ids.tolist()))
        want = [(int(-s), i) for s, i in want if i != ids[n]][:5]
        assert topk.search(root, x[n], ids[n], 5) == want == topk.search(again, x[n], ids[n], 5)


def test_op4_recall_and_order(spark, tmp_path):
    df = odd_vectors(spark)
    got = ann.op4_ann(spark, stored(spark, df, tmp_path)).collect()
    rows = [(i, v) for i, v in usable(df) if v.any()]
    repeated = {i for i, n in Counter(i for i, _ in rows).items() if n > 1}
    hits = total = 0
    for q, v in rows:
        if q % 100 == 0 and q not in repeated:
            want = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in rows if i != q)[:10]
            mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
            assert [n for n, _, _ in mine] == list(range(1, 11))
            assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
            hits += len({i for _, i in want} & {i for _, _, i in mine})
            total += 10
    assert hits / total >= 0.9


def test_probes_come_in_order_of_success():
    sets = ann.probe_order(6, 100)
    assert sets[0] == () and len(set(sets)) == 100 and all(2 * 6 - 1 - j not in s for s in sets for j in s)


def test_empty_searches(spark, tmp_path):
    path = stored(spark, odd_vectors(spark).limit(0), tmp_path)
    assert topk.op3_exact_topk(spark, path).count() == 0 and ann.op4_ann(spark, path).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<float>")
    few.write.mode("overwrite").parquet(path + "/few/embeddings.parquet")
    assert [r.vec_id for r in ann.op4_ann(spark, path + "/few").collect()] == [3]


def test_sharding_keeps_the_law(odd, none, spark):
    rows = sharding.shard_documents(odd.unionByName(odd)).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 30 and max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {1}
    assert sharding.shard_documents(none).count() == 0
    whole = sharding.bounded_ring(odd, "doc_id")
    assert whole.count() == 15 and dict(whole.dtypes)["shard"] == "int"


def test_sharding_is_a_plain_walk_round_the_ring(spark):
    """Keys one by one: round after round each asks the next shard clockwise from its place, in ring order."""
    keys = list(range(500))
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string")
    cell = {k: int(np.int64(np.uint64(xxhash.xxh64_intdigest(str(k), 42))) % 65536) for k in keys}
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{n}".encode()).digest()[:8], "big") % 65536, s) for s in range(8) for n in range(128))
    room = [500 // 8 + (s < 500 % 8) for s in range(8)]
    waiting, owner = sorted(keys, key=lambda k: (cell[k], k)), {}
    for turn in range(8):
        for k in list(waiting):
            first = next((i for i, (c, _) in enumerate(points) if c >= cell[k]), 0)
            met = list(dict.fromkeys(s for _, s in points[first:] + points[:first]))
            if room[met[turn]]:
                room[met[turn]] -= 1
                owner[k] = met[turn]
                waiting.remove(k)
    assert {r.doc_id: r.shard for r in sharding.shard_documents(df).collect()} == owner


def test_hot_keys_are_numbered_in_parts(spark):
    """A third of all rows without a key and equal, a third of one key with texts of their own: the same law, and clashing names."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
        F.lit(1).alias("__ring_cell"), F.lit("s").alias("slot"), F.lit(2).alias("__ring_part"),
    )
    cold = sharding.bounded_ring(df, "doc_id")
    for out in (cold, sharding.bounded_ring(df, "doc_id", hot_rows=50, cells=64)):
        rows = out.collect()
        assert sorted(out.columns) == sorted(["doc_id", "text", "__ring_cell", "__ring_part", "shard", "slot"]) and len(rows) == 3000
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(375))
    parted = sharding.bounded_ring(df, "doc_id", hot_rows=50)
    assert len(set(map(tuple, parted.where("doc_id is not null").select("doc_id", "text", "shard", "slot").collect()))) == 2000
    assert Counter((r.doc_id, r.text, r.shard) for r in parted.where("doc_id > 7").collect()) == Counter((r.doc_id, r.text, r.shard) for r in cold.where("doc_id > 7").collect())


def test_the_ring_moves_little():
    n = 20_000
    counts = {c: n // 1000 for c in range(0, 65536, 65) if c // 65 < 1000}
    total = sum(counts.values())

    def owner(shards):
        out = {}
        for cell, a, b, shard, _ in sharding.place(counts, shards, 128):
            for i in range(a, b):
                out[cell, i] = shard
        return out

    eight, nine = owner(8), owner(9)
    assert len(eight) == len(nine) == total
    moved = sum(eight[k] != nine[k] for k in eight) / total
    assert moved < 0.45  # a fresh deal would move 8 of 9


def brute_repeats(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    n = Counter(tuple(w[j : j + length]) for _, w in words for j in range(len(w) - length + 1))
    out = Counter()
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - length + 1):
            if n[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [35, 6, 1])
def test_op6_is_brute_force(spark, odd, none, length):
    made = [(100 + i, " ".join([prose(50 + i, 30), prose(7, 36 + i % 3), prose(90 + i, 20), prose(8 + i % 4, 34)] + ["loop"] * (i % 50))) for i in range(30)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = Counter(tuple(r) for r in substring.remove_repeats(df, length).collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in df.collect()], length)
    assert substring.remove_repeats(none).count() == 0


def test_op6_takes_rows_repeated_thousands_of_times(spark):
    """20,000 equal rows without an id, and texts that share a passage with them."""
    same = prose(31, 200)
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(same).alias("text"))
    others = [(1, prose(32, 40) + " " + " ".join(same.split()[50:100])), (2, prose(33, 90)), (3, prose(34, 40)), (3, prose(34, 40))]
    df = rows.unionByName(spark.createDataFrame(others, "doc_id long, text string"))
    got = Counter(tuple(r)[:3] for r in substring.remove_repeats(df).collect())
    assert got == {(None, 200, 200): 20_000, (1, 90, 50): 1, (2, 90, 0): 1, (3, 40, 40): 2}


def test_op6_keeps_carried_columns(odd):
    out = substring.remove_repeats(odd, with_text=True, carry=("th", "starts", "key"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "th", "starts", "key"] and out.count() == 15
    clash = substring.remove_repeats(odd.withColumn("kept", F.lit(1)), with_text=True, carry=("kept", "lang", "n_words"))
    assert clash.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "lang"] and dict(clash.dtypes)["kept"] == "string" and clash.count() == 15


def unite(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200), (50, 100), (7, 300)]
    df = spark.createDataFrame([*pairs, (None, 1)], "u long, v long")
    want = unite({x for p in pairs for x in p}, pairs)
    got = {r.node: r.label for r in components.components(df).collect()}
    assert got == {n: r for n, r in want.items() if n != 200}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [4, 7])
def test_grid_finds_every_link(spark, distance):
    r = np.random.default_rng(distance)
    fps = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = fps[r.integers(0, 300, 900)]
    for _ in range(distance):
        near = near ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near]))
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "fp long, node long")
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    signed = fps.view(np.int64).tolist()
    want = unite(signed, [(signed[a], signed[b]) for a, b in zip(*np.nonzero(linked)) if a < b])
    for block in (16384, 3):  # with blocks of three rows every cell is dealt out
        edges = [(r.u, r.v) for r in simhash.near_links(nodes, distance, block).collect()]
        assert unite(signed, edges) == want


@pytest.mark.parametrize("text", ["", "One", "a B c", "a b c d", "x x x x x x x x", "É\u00a0b  c\td\x1ce f\n" * 9, prose(77, 500)])
def test_fingerprints_are_majorities_of_shingle_bits(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want


def test_manhattan_distance_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()


def test_op10_on_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert len(got) == 15 and by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[9] == 9
    assert all(r.fp == 0 for r in got if r.doc_id in (4, 5, 6))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(ids)[7] == 1 and 1 in ids and not {2, 3, 5, 6} & set(ids) and ids.count(None) == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_near_copies_are_one_group(spark):
    r = np.random.default_rng(9)
    rows, group = [], {}
    for g in range(60):
        words = prose(1000 + g, 60 + 13 * g).split()
        for c in range(5):
            copy = list(words)
            for at in r.choice(len(copy), max(1, len(copy) // 120), replace=False) if c else []:
                copy[at] = f"new{r.integers(1000)}"
            rows.append((g * 10 + c, " ".join(copy)))
            group[g * 10 + c] = g
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (16384, 40):
        found = {}
        for x in simhash.similar_groups(df, block_rows=block).collect():
            found.setdefault(x.label, set()).add(group[x.doc_id])
        assert len(found) == 60 and all(len(g) == 1 for g in found.values())
    assert sorted(x.doc_id for x in simhash.keep_one(df).collect()) == [g * 10 for g in range(60)]


def test_op4_fills_up_queries_far_from_all_rows(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 5))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    far = 100 * x[:3]
    queries = spark.createDataFrame([(1000 + i, [float(c) for c in v]) for i, v in enumerate(far)], "id long, vec array<double>")
    got = {(g.query_id, g.rank): g.vec_id for g in ann.nearest_neighbours(rows, queries).collect()}
    for i, q in enumerate(far):
        want = np.argsort(np.sqrt(((x - q) ** 2).sum(axis=1)), kind="stable")[:10].tolist()
        assert [got.get((1000 + i, n)) for n in range(1, 11)] == want


def vectors(spark, x, first=0, ids=None):
    ids = range(first, first + len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, vec array<double>")


def test_every_query_gets_its_ten_over_several_shards(spark):
    """Unit vectors and queries of length 1, 10, 40 and 200; shards of 50 rows, blocks of 3 queries."""
    r = np.random.default_rng(12)
    x = r.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:8] * np.array([1, 10, 40, 200] * 2)[:, None]
    got = {}
    for g in ann.nearest_neighbours(vectors(spark, x), vectors(spark, q, 1000), shard_rows=50, block_rows=3).collect():
        got.setdefault(g.query_id - 1000, {})[g.rank] = (g.vec_id, g.score)
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        want = np.argsort(d, kind="stable")[:10].tolist()
        assert sorted(got[i]) == list(range(1, 11)) and all(abs(d[j] - s) < 1e-9 for j, s in got[i].values())
        if i % 4:
            assert [got[i][n][0] for n in range(1, 11)] == want
    few = vectors(spark, x[:14] * np.array([1] * 13 + [500])[:, None])
    assert Counter(g.query_id for g in ann.nearest_neighbours(few, few).collect()) == dict.fromkeys(range(14), 10)


def test_rows_of_one_id_are_queries_of_their_own(spark):
    r = np.random.default_rng(13)
    x = np.floor(256 * r.normal(size=(90, 4)))
    ids = [0] * 30 + list(range(1, 61))
    rows = vectors(spark, x, ids=ids)
    queries = rows.where("id in (0, 50)")
    exact, near = (Counter((g.query_id, g.rank, g.vec_id, round(g.score, 6)) for g in found.collect()) for found in (topk.inner_product_topk(rows, queries, 5, 20, 7), ann.nearest_neighbours(rows, queries, 100, shard_rows=20, block_rows=7)))
    want, want_near = Counter(), Counter()
    for i, v in zip(ids, x, strict=True):
        if i in (0, 50):
            others = [(j, w) for j, w in zip(ids, x, strict=True) if j != i]
            want.update((i, n, j, -s) for n, (s, j) in enumerate(sorted((-int(v @ w), j) for j, w in others)[:5], 1))
            want_near.update((i, n, j, round(s, 6)) for n, (s, j) in enumerate(sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in others), 1))
    assert exact == want and near == want_near


def test_groups_are_those_of_exact_similarity(spark):
    """Pairs around a Jaccard similarity of 0.8, short and long, with repeated lines: linked from 0.8 on and not below."""
    r = np.random.default_rng(3)
    rows, near = [], {}
    for g in range(240):
        words = prose(5000 + g, (6, 9, 12, 30, 80, 300)[g % 6] + g % 7).split()
        copy = list(words)
        for at in r.choice(len(copy), 1 + int(len(copy) * (0.002, 0.01, 0.02, 0.03)[g // 6 % 4]), replace=False):
            copy[at] = f"new{g}"
        if g % 5 == 0:
            copy += words[-len(words) // 2 :] * 3
        if g % 6 < 3:
            copy = words + ["more"] * (g % 2) + [f"end{g}"]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words, copy))
        near[g] = len(a & b) / len(a | b) >= 0.8
    assert 50 < sum(near.values()) < 190
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (131072, 40):
        label = {x.doc_id: x.label for x in simhash.similar_groups(df, block_rows=block).collect()}
        assert {g: label[2 * g] == label[2 * g + 1] for g in near} == near
        assert len(set(label.values())) == 480 - sum(near.values())


def test_sql_agrees(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, SF)
        want = c.sql(sql)
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline_of_empty_tables_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(empty.columns)
    some = docs.where("doc_id < 60").unionByName(docs.where("doc_id < 60").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars"))
    some.write.parquet(str(tmp_path / "few" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "few" / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "few")).collect()
    ids = [r.doc_id for r in packed if r.piece == 0]
    assert ids and len(set(ids)) == len(ids) and max(ids) < 5000


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_001, None, None, None, None), (10_002, "123 !", None, "s", 5), (10_003, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.limit(3))
    seen = docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = stage(spark, docs, SF)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= seen
        seen = docs.count()
        if name == "language_id":
            assert not docs.where("doc_id > 10000").count() and seen == before.count() - 3
        if name == "simhash_near_dedup":
            assert docs.count() == docs.select("doc_id").distinct().count()
            groups = simhash.similar_groups(docs)
            assert groups.count() == groups.select("label").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == seen
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def highest_marginal(field, text):
    """By plain forward and backward sums in logarithms."""
    words = toxicity.WORD.findall((text or "").lower())
    if not words:
        return 0.0
    u = [np.array([0.0, float(np.clip(sum(float(field.weights[f]) for f in toxicity.own_features(w)), -toxicity.MOST, toxicity.MOST))]) for w in words]
    forward, back = [u[0]], [np.zeros(2)]
    for x in u[1:]:
        forward.append(x + np.logaddexp(*(forward[-1][:, None] + field.moves)))
    for x in reversed(u[1:]):
        back.append(np.logaddexp(*(field.moves + x + back[-1]).T))
    joint = np.array(forward) + np.array(back[::-1])
    return float(np.exp(joint[:, 1] - np.logaddexp(joint[:, 0], joint[:, 1])).max())


def test_pipeline_is_brute_force(spark):
    """run() on 1,000 documents against plain loops over them, stage by stage."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(langid.labelled(docs)).with_background()
    rows = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "") and langid.mixture(model, r.text).get("und", 0) <= 0.5}
    field = toxicity.train(docs.where(F.col("doc_id").isin(list(rows))), toxicity.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    scores = {i: highest_marginal(field, t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if scores[i] < 0.5}
    assert sum(s >= 0.5 for s in scores.values()) > 3
    low = {i: t.encode().translate(simhash.LOWER).split() for i, t in rows.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in low.items()}
    ids = sorted(rows)
    alike = lambda a, b: not (a or b) or len(a & b) >= 0.8 * len(a | b)
    holds = {}
    for i in ids:
        for x in sets[i] or {()}:
            holds.setdefault(x, []).append(i)
    pairs = {(i, j) for some in holds.values() for n, i in enumerate(some) for j in some[n + 1 :]}  # others share no shingle
    group = unite(ids, [(i, j) for i, j in pairs if alike(sets[i], sets[j])])
    rows = {i: t for i, t in rows.items() if group[i] == i}
    assert len(rows) < len(ids)
    words = {i: t.encode().split() for i, t in rows.items()}
    n = Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    left = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if n[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        left[i] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if gone.any() else rows[i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in left.items():
        tokens = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        first = len(tokens) % 1024 or 1024
        for piece, start in enumerate([0, *range(first, len(tokens), 1024)]):
            part = tokens[start : first if not piece else start + 1024]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    used = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
