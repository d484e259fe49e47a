"""Searches by trigrams in one pass, without a stored index of the texts."""

import re

import pytest
from pyspark.sql import functions as F

from archivolt.operators import lexical, retrieval, similar
from archivolt.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(text):
    words = [w for w in re.split(r"[\W]+", text.lower()) if w]
    return {p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(w) + 1)}


@pytest.mark.parametrize("name", ["trigram_topk", "rrf_fusion", "rrf_fusion_asc_compat", "hybrid_search"])
def test_no_index_is_written(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("an index of all texts takes many times their size")

    monkeypatch.setattr(lexical, "build", refuse)
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_trigrams_of_a_batch():
    texts = ["", "a", "fiebre alta", "x_1 ²½", "中文 𝒳𝒴 aaaa aaaa", "..", "\n"]
    of, found = similar.grams(texts)
    got = [set() for _ in texts]
    for i, g in zip(of.tolist(), found.tolist(), strict=True):
        s = "".join(chr(g >> n & 0x1FFFFF) for n in (42, 21, 0))
        assert s not in got[i]
        got[i].add(s)
    assert got == [plain(t) for t in texts]
    many = [chr(n) * 2 for n in range(0x4E00, 0x4E00 + 20_000)]
    assert len(similar.grams(many)[0]) == 60_000 and len(similar.grams([])[0]) == 0


def test_best_of_all_tasks(spark):
    texts = [f"fiebre {'alta ' * (n % 5)}caso{n % 40}" for n in range(300)] + [None, "", "FIEBRE", "nada"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(5)
    queries = spark.createDataFrame([(1, "fiebre alta"), (2, "zzzz"), (3, None), (4, "caso7")], "query_id int, query_text string")
    got = {}
    for r in retrieval.lexical_leg(chunks, queries, 12).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, round(r.similarity, 12))
    want = {}
    for n, q in ((1, "fiebre alta"), (4, "caso7")):
        rows = [(-len(plain(t) & plain(q)) / len(plain(t) | plain(q)), i) for i, t in enumerate(texts) if t and any(w in t.lower() for w in q.split())]
        want[n] = {rank: (i, round(-s, 12)) for rank, (s, i) in enumerate(sorted(rows)[:12])}
    assert got == want


def test_full_text_without_postings_is_one_pass(spark):
    """The hits of the stored postings, without stemming or dealing out all texts."""
    from archivolt.operators import fts

    words = "fiebre fiebres tratamiento tratamientos alta dolor de cabeza license the".split()
    texts = [" ".join(words[(n * m) % 10] for m in range(1, 2 + n % 9)) for n in range(200)] + ["fiebr", "", None, "FIEBRE alta"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(3)
    queries = spark.createDataFrame([(1, "tratamiento de fiebre"), (2, "licens"), (3, "zzzz"), (4, "dolores de cabeza")], "query_id int, query_text string")
    rows = lambda df: {(r.query_id, r.rank): (r.chunk_id, round(r.similarity, 12), round(r.density, 12)) for r in df.collect()}
    scan = fts.text_leg(chunks, queries, 7)
    assert rows(scan) == rows(fts.text_leg(chunks.where("content is not null"), queries, 7, postings=fts.index(chunks))) != {}
    assert "Join" not in scan._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_hits_are_filtered_where_they_are_read(spark):
    """The contents of all chunks are not dealt out for a few hits."""
    plan = catalog.QUERIES["hybrid_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan


@pytest.mark.parametrize("name", ["rrf_fusion_asc_compat", "rrf_fusion", "cosine_topk", "trigram_topk"])
def test_k_rows_a_task_meet_in_the_window_of_a_query(spark, name):
    """All rows of a query are not sorted in one task."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == len(re.findall(r"Window \[row_number", plan)) > 0


def test_top_is_the_first_k_of_each(spark):
    rows = [(q, n, (n * 7) % 5) for q in (1, 2) for n in range(20)] + [(3, 0, 1), (None, 4, 2)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id long, s int").repartition(6)
    got = {(r.query_id, r.rank): r.chunk_id for r in retrieval.top(df, 3, F.desc("s"), F.asc("chunk_id")).collect()}
    want = {(q, i): n for q in (1, 2, 3, None) for i, (_, n) in enumerate(sorted((-s, n) for p, n, s in rows if p == q)[:3])}
    assert got == want
