"""Operators on literal rows with pinned results."""

import zipfile

import pytest
from pyspark.sql import functions as F

from archivolt import schemas
from archivolt.operators import chunking, knowledge, lifecycle, ocr, retrieval, scorecard
from archivolt.sources import readers, sinks


def test_lights(spark):
    rows = [("gte", 85.0, 70.0, v) for v in (95.0, 85.0, 60.0, None)] + [("lte", 10.0, 5.0, v) for v in (4.0, 8.0, 20.0)]
    df = spark.createDataFrame(rows, "direction string, amber double, red double, value double")
    states = [r[0] for r in df.select(scorecard.state(F.col("value"), F.col("direction"), F.col("amber"), F.col("red"))).collect()]
    assert states == ["green", "green", "red", "gray", "green", "amber", "red"]


def test_score(spark):
    rows = [("rag", "gte", None, 85.0, 70.0, 90.0), ("rag", "lte", None, 10.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "perspective string, direction string, target double, amber double, red double, value double")
    assert scorecard.score(df).first().score == 60.0
    assert scorecard.score(df.limit(0)).first().score == 0.0


def test_support(spark):
    rows = [(10, 5, 0.9, 3), (0, 0, 0.1, 0), (2, 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "e int, k int, s double, p int").select(scorecard.support(*map(F.col, "eksp")).alias("i"))
    assert [tuple(r) for r in df.select("i", scorecard.support_level(F.col("i"))).collect()] == [(80.0, "Alto"), (2.0, "Bajo"), (24.0, "Bajo")]


def test_evidence_and_usage(spark):
    a = spark.createDataFrame([("u", "query", 3), ("u", "query", 0), ("v", "query", 2), ("u", "upload", None), ("v", "upload", None)], "username string, action string, n_sources int")
    assert tuple(scorecard.evidence_stats(a).first()) == (3, 2, 1, 66.67)
    assert tuple(scorecard.evidence_stats(a.limit(0)).first()) == (0, 0, 0, 0.0)
    assert tuple(scorecard.usage(a).first()) == (2, 3, 2, 1.5, 1.0)


def test_alerts(spark):
    states = spark.createDataFrame([("A", "amber"), ("B", "red"), ("C", "green")], "code string, state string")
    there = spark.createDataFrame([("A", "critical", "open"), ("B", "critical", "resolved")], "code string, severity string, status string")
    assert [tuple(r) for r in scorecard.new_alerts(states, there).collect()] == [("B", "critical")]
    assert scorecard.new_alerts(states, there, per_severity=True).count() == 2


def test_keyword_matches(spark):
    chunks = spark.createDataFrame([(1, "La Presión arterial; la presion ARTERIAL."), (2, "c++ y e-mail"), (3, ""), (4, None)], "chunk_id long, content string")
    keys = spark.createDataFrame([(1, "presión arterial"), (2, "la"), (3, "e-mail"), (4, "++"), (5, ""), (6, "art")], "keyword_id int, term string")
    got = {(r.chunk_id, r.keyword_id): r.match_count for r in knowledge.match_keywords(chunks, keys).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (2, 3): 1}


def test_coverage_of_an_empty_catalogue(spark):
    keys = spark.createDataFrame([], "keyword_id int, term string, category string, priority int, is_active boolean")
    hits = spark.createDataFrame([], "chunk_id long, keyword_id int, match_count long")
    assert tuple(knowledge.coverage(keys, hits).first()) == (0, 0, 100.0, 100.0)


def test_ocr_decisions(spark):
    pages = spark.createDataFrame([(1, 1, 90.0, "a"), (1, 2, 30.0, "b")], "document_id int, page int, score double, engine string")
    chunks = spark.createDataFrame([(7, 1, [1, 2]), (8, 1, [])], "chunk_id int, document_id int, page_numbers array<int>")
    assert {r.chunk_id: tuple(r)[1:] for r in ocr.worst_page(chunks, pages).collect()} == {7: (30.0, "b", True), 8: (None, None, False)}
    rows = [("x", 12.0, "y", 88.0), ("x", 92.0, "y", 99.0), ("x", 50.0, None, None), ("", 70.0, "y", 1.0)]
    df = spark.createDataFrame(rows, "a string, s double, b string, t double")
    assert [r[0] for r in df.select(ocr.cascade(*map(F.col, "asbt"))).collect()] == ["second", "first", "first", "second"]
    turn = spark.createDataFrame([(10.0, 60.0), (50.0, 50.0), (30.0, 41.0)], "u double, t double")
    assert [r[0] for r in turn.select(ocr.rotate(F.col("u"), F.col("t"))).collect()] == [True, False, False]


def test_chunks_keep_all_text_and_bounds():
    text = " ".join(f"Frase numero {i} con palabras de relleno." for i in range(400))
    got = list(chunking.pack(text, [1, 2, 3]))
    assert all(n <= chunking.MAX_TOKENS for _, _, n in got)
    for i in range(400):
        assert any(f"numero {i} " in c for c, _, _ in got)
    for (a, _, _), (b, _, _) in zip(got, got[1:]):
        first = b.split(". ")[0]
        assert first in a  # the overlap
    assert list(chunking.pack("x" * 3000, [4]))[0][2] == 1000  # an oversize sentence stays whole
    assert list(chunking.pack("", [1])) == []


def test_groups_carry_the_age_forward():
    pages = [(1, "a" * 2400, None), (2, "b" * 2400, 40), (3, " ", None), (4, "c" * 2400, 50)]
    assert [(n, age) for _, n, age in chunking.groups(pages)] == [([1], None), ([2], 40), ([4], 40)]


def test_context_packing(spark):
    rows = [(1, n, "d", [1, 2], 40 if n == 0 else None, "x" * 2000) for n in range(3)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, document_name string, page_numbers array<int>, edad int, content string")
    c = retrieval.pack_context(hits).first().context
    assert c.startswith("[1] Documento: d | Paginas: [1, 2] | Edad: 40 anios\n") and "[3]" not in c and c.endswith("...") and len(c) < 4000


def test_abstention_uses_the_fused_score_where_there_is_no_other(spark):
    hits = spark.createDataFrame([(1, 0.01, None), (2, 0.02, None), (3, 0.0, 0.9)], "query_id int, score double, rerank_score double")
    kept = retrieval.evidence(hits)
    assert sorted(r.query_id for r in kept.collect()) == [2, 3]
    assert {r.query_id: r.abstained for r in retrieval.abstentions(hits, kept).collect()} == {1: True, 2: False, 3: False}


def test_imports_and_edits(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", "x", 1, True), (2, "b", "x", 1, False)], "keyword_id int, term string, category string, priority int, is_active boolean")
    with pytest.raises(ValueError):
        lifecycle.upsert_keyword(stored, "a", "x")
    assert lifecycle.upsert_keyword(stored, "b", "x").where("is_active").count() == 2
    assert lifecycle.upsert_keyword(stored, "c", "y", 2).count() == 3
    assert lifecycle.delete_keyword(stored, 1).where("is_active").count() == 0
    assert lifecycle.patch_keyword(stored, 1, domain="z").where("category = 'z'").count() == 1
    path = tmp_path / "k.csv"
    path.write_text("﻿term,category\na,x\n new , y\n,\n", encoding="utf-8")
    rows = readers.keyword_csv(spark, str(path))
    assert [tuple(r) for r in lifecycle.import_keywords(stored, rows).collect()] == [("new", "y")]
    edges = spark.createDataFrame([(1, "a", "b", None), (2, "c", "d", None)], "edge_id int, canonical string, synonym string, category string")
    assert sorted(r.synonym for r in lifecycle.replace_synonyms(edges, "a", ["B ", "b", "e"], "k").where("canonical = 'a'").collect()) == ["B", "a", "e"]


def test_words_are_corrected_once(spark):
    c = spark.createDataFrame([(1, 1, [1], "it's it's", [1.0]), (2, 1, [2], "it's", [1.0])], "chunk_id int, document_id int, page_numbers array<int>, content string, embedding array<float>")
    out = {r.chunk_id: (r.content, r.embedding) for r in lifecycle.correct_word(c, 1, 1, "it's", "is").collect()}
    assert out == {1: ("is it's", None), 2: ("it's", [1.0])}


def test_files_are_checked_one_by_one(spark):
    rows = [(1, "a.pdf", b"%PDF-1"), (2, "b.txt", b"%PDF-1"), (3, "c.pdf", b"none"), (4, "d.pdf", b"%PDF-1")]
    got = {r.file_id: (r.ok, r.status_code) for r in lifecycle.validate_files(spark.createDataFrame(rows, "file_id int, filename string, content binary")).collect()}
    assert got == {1: (True, 200), 2: (False, 400), 3: (False, 400), 4: (False, 409)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "a<b")], "id int, l array<int>, s string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().l == "[1,2]"
    sinks.write_text(df, str(tmp_path / "txt"), "%s: %s", "id", "s")
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "1: a<b"
    book = tmp_path / "b.xlsx"
    book.write_bytes(sinks.workbook({"one": df}))
    assert "a&lt;b" in zipfile.ZipFile(book).read("xl/worksheets/sheet1.xml").decode()
    assert sinks.pdf("Informe", ["uno (1)"] * 60).startswith(b"%PDF")


def test_schemas(spark):
    schemas.check(spark.createDataFrame([], schemas.schema("chunks")), "chunks")
    with pytest.raises(ValueError):
        schemas.check(spark.createDataFrame([("x",)], "keyword_id string"), "keywords")
    assert all(schemas.schema(n) for n in schemas.SCHEMAS)


def test_a_large_set_meets_rows_in_blocks(spark):
    from archivolt.operators.sizes import meet

    rows, few = spark.range(7).toDF("a"), spark.range(25).select("id", F.array("id").alias("v"))
    for most in (100, 4):
        got = meet(rows, few, most)
        assert got.columns == ["a", "id", "v"] and got.count() == 175 and got.distinct().count() == 175


@pytest.mark.parametrize("most", [10_000, 2])
def test_terms_are_found_in_one_pass(spark, most):
    """All terms of a dictionary, in one part and in several; occurrences of a term do not overlap."""
    from archivolt.operators.terms import find_terms

    rows = spark.createDataFrame([(1, "aaaa bab"), (2, "nothing"), (3, None), (4, ""), (5, "bab aa 中文中文")], "id long, text string")
    terms = spark.createDataFrame([(7, "aa"), (7, "bab"), (8, "ba"), (9, "zz"), (9, ""), (9, None), (10, "中文"), (11, "aa")], "owner int, term string")
    got = {}
    for r in find_terms(rows, "text", terms, most).collect():
        for h in r.hits:
            got[r.id, h.owner] = got.get((r.id, h.owner), 0) + h.n
    assert got == {(1, 7): 3, (1, 8): 1, (1, 11): 2, (5, 7): 2, (5, 8): 1, (5, 10): 2, (5, 11): 1}
    assert find_terms(rows, "text", terms.limit(0)).count() == 0 and find_terms(rows.limit(0), "text", terms).count() == 0


def test_a_page_with_its_words_in_one_row(spark):
    """The same text and score as of single words, and nothing is dealt out."""
    from archivolt.operators import ocr

    words = [(1, [("a ", "90"), ("", "80"), (" b", "21"), ("c", "20"), ("d", "x"), (None, "50")]), (2, [("z", "3")]), (3, []), (4, None)]
    pages = spark.createDataFrame(words, "document_id int, words array<struct<text:string,conf:string>>")
    got = pages.select("document_id", F.inline(ocr.page_of(F.col("words"))))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    each = pages.select("document_id", F.lit(1).alias("page"), F.posexplode("words").alias("n", "w")).select("document_id", "page", "n", "w.*")
    want = ocr.page_text(ocr.words_of(each)).collect()
    assert [(r.document_id, r.n, r.text, r.score) for r in got.collect()] == [(r.document_id, 2, r.text, r.score) for r in want] == [(1, 2, "a b", 55.5)]


def test_ocr_words_shuffles_nothing(spark):
    from archivolt.plans import catalog

    assert "Exchange" not in catalog.QUERIES["ocr_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_dictionary_of_many_equal_terms_stays_off_the_driver(spark, monkeypatch):
    """Edges with the same sides are one term of the scan; what the driver collects does not grow with the edges."""
    from archivolt.operators import retrieval, terms

    sent = []
    automaton = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(len(v)) or automaton(self, v))
    edges = spark.range(3000).selectExpr("cast(id as int) edge_id", "concat('brand ', id % 3) canonical", "concat('Name ', id % 5) synonym")
    asked = spark.createDataFrame([(1, "a name 2 or brand 1"), (2, "none"), (3, None)], "query_id int, query_text string")
    got = {r.query_id: r.expanded for r in retrieval.expand_query(asked, edges).collect()}
    extra = [f"Name {i % 5}" if i % 3 == 1 else "brand " + str(i % 3) for i in range(3000) if i % 3 == 1 or i % 5 == 2]
    assert got == {1: " ".join(["a name 2 or brand 1", *extra]), 2: "none", 3: None} and max(sent) == 8
    sent.clear()
    found = terms.find_terms(asked, "query_text", spark.createDataFrame([(n, t) for n, t in enumerate(["name", "brand", "none", "or"])], "owner int, term string"), 2)
    assert sorted((r.query_id, h.owner) for r in found.collect() for h in r.hits) == [(1, 0), (1, 1), (1, 3), (2, 2)] and not sent


def test_forms_of_many_equal_edges_meet_once(spark):
    """Equal forms of a group are one before they meet the terms."""
    from archivolt.operators import retrieval

    edges = spark.range(20_000).selectExpr("'brand' canonical", "concat('Form ', id % 4) synonym")
    asked = spark.createDataFrame([("form1",), ("FORM 2",), ("x",)], "term string")
    out = retrieval.expand_term(asked, edges)
    assert {r.term: r.forms for r in out.collect()} == {t: ["brand", *(f"form {n}" for n in range(4))] for t in ("form1", "FORM 2")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") >= 6  # edges, forms (both for keys and for groups), keys, groups, terms
