"""The stored lexical index against scans of all texts, and word similarity against all runs."""

import random
import time

from pyspark.sql import functions as F

from archivolt.operators import fts, lexical, retrieval
from archivolt.plans.standins import Tables

WORDS = "la fiebre alta dolor de cabeza presión arterial glucosa ñandú the and of license apache 12 b2".split()


def rows(spark, n, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) + r.choice(["", "", "s", ",", "mente"]) for _ in range(r.choice([1, 2, 3, 5, 8, 40, 200]))) for _ in range(n)]
    texts += ["", None, "fiebre", "Fiebre", "xfiebrex", "..."]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")


def hits(df):
    return {(r.query_id, r.rank): (r.chunk_id, round(r.similarity, 12)) for r in df.collect()}


def test_index_gives_the_hits_of_a_scan(spark, tmp_path):
    chunks = rows(spark, 400, 3)
    queries = spark.createDataFrame([(1, "fiebre alta"), (2, "la license of apache"), (3, "zzzz"), (4, "dolor de cabeza fuerte y presión arterial"), (5, "b2")], "query_id int, query_text string")
    for part_rows, k in ((1_000_000, 10), (50, 3), (50, 1000)):
        path = str(tmp_path / f"{part_rows}-{k}")
        lexical.build(chunks, path, part_rows)
        assert hits(lexical.leg(spark, path, queries, k)) == hits(retrieval.lexical_leg(chunks.where("content is not null"), queries, k))
    read = lexical.blocks_read(spark, path, queries, 3).agg(F.sum("blocks"), F.sum(F.col("near") + F.col("rest"))).first()
    assert 0 < read[1] < 2 * read[0]


def test_index_of_the_tables(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert hits(t.lexical("vectors", t.queries, 15)) == hits(retrieval.lexical_leg(t.vectors, t.queries, 15))


def plain_similarity(query, text):
    q, t = set(fts._grams(query)), fts._grams(text)
    runs = [set(t[i : j + 1]) for i in range(len(t)) if t[i] in q for j in range(i, len(t)) if t[j] in q]
    return max((len(r & q) / len(r | q) for r in runs), default=0.0)


def test_word_similarity_of_all_runs():
    r = random.Random(4)
    for _ in range(300):
        query = " ".join(r.choice(["ab", "abc", "aaa", "ba", "c"]) for _ in range(r.randint(0, 3)))
        text = " ".join(r.choice(["ab", "abc", "aaaa", "bab", "c", "abca"]) for _ in range(r.randint(0, 12)))
        want = plain_similarity(query, text)
        got = fts.word_similarity(query, text)
        assert abs(got - want) < 1e-12 or want < 1 / 3 >= got
    start = time.time()
    fts.word_similarity("fiebre alta", "fiebre alta " + "a" * 1_000_000)
    fts.word_similarity("fiebre alta", "fiebre alta otra cosa " * 50_000)
    assert time.time() - start < 20  # a second or two on a machine with nothing else to do
