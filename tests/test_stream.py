"""Incremental ingestion: repeated and changed input."""

import json

from archivolt.engine import Engine, User
from archivolt.models import HashEmbedder
from archivolt.streaming import ingest


def test_runs_again_without_change(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    keys = spark.createDataFrame([(1, "fiebre")], "keyword_id int, term string")
    page = lambda d, p, t: json.dumps({"document_id": d, "page": p, "text": t})
    (source / "a.json").write_text("\n".join([page(1, 2, "Tiene fiebre alta."), page(1, 1, "Nota. nacido: 14/03/1985"), page(2, 1, "Sin datos.")]))
    run = lambda: ingest.ingest(spark, str(source), root, keys, "2025-06-01", HashEmbedder(8), 2).awaitTermination()
    run()
    run()
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.count() == 2 and chunks.where("document_id = 1").first().edad == 40
    assert "1985" not in chunks.where("document_id = 1").first().content
    (source / "b.json").write_text(page(1, 1, "Ya no tiene fiebre, ni fiebre."))
    run()
    hits = spark.read.parquet(f"{root}/chunk_keywords")
    assert spark.read.parquet(f"{root}/chunks").count() == 2 and hits.count() == 1 and hits.first().match_count == 2


def test_questions_are_answered_or_declined(spark):
    e = HashEmbedder(16)
    rows = [(1, 1, "public", "La dosis de amoxicilina es cinco.", [1], None, "uno"), (2, 2, "restricted", "La dosis secreta es nueve.", [1], 40, "dos")]
    base = spark.createDataFrame(rows, "chunk_id long, document_id long, visibility string, content string, page_numbers array<int>, edad int, original_name string")
    from archivolt.models import embed

    chunks = embed(base.drop("original_name"), "content", e)
    tables = {
        "chunks": chunks, "documents": base.select("document_id", "original_name"), "acl": spark.createDataFrame([(2, "editor")], "document_id long, role string"),
        "synonyms": spark.createDataFrame([], "edge_id int, canonical string, synonym string, category string"),
    }
    q = embed(spark.createDataFrame([(1, "dosis amoxicilina"), (2, "zzzz yyyy")], "query_id int, query_text string"), "query_text", e).withColumnRenamed("embedding", "query_vector")
    engine = Engine(spark, tables)
    got = {a["query_id"]: a for a in engine.ask(q, User(1, "v", "viewer"))}
    assert got[1]["grounded"] and "cinco" in got[1]["answer"] and got[2]["abstained"]
    found = engine.search(q, User(1, "v", "viewer")).select("chunk_id").distinct().collect()
    assert [r[0] for r in found] == [1]
    assert engine.search(q, User(2, "e", "editor")).where("chunk_id = 2 and query_id = 1").count() == 1


def test_fields_follow_new_chunks(spark, tmp_path):
    from pyspark.sql import functions as F

    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    keys = spark.createDataFrame([(1, "x")], "keyword_id int, term string")
    (source / "a.json").write_text(json.dumps({"document_id": 1, "page": 1, "text": "Primera frase."}))
    fields = lambda d: d.select("document_id", F.substring("content", 1, 7).alias("nombre"))
    ingest.ingest(spark, str(source), root, keys, "2025-06-01", None, 2).awaitTermination()
    ingest.extract(spark, root, fields).awaitTermination()
    (source / "b.json").write_text(json.dumps({"document_id": 1, "page": 1, "text": "Segunda frase."}))
    ingest.ingest(spark, str(source), root, keys, "2025-06-01", None, 2).awaitTermination()
    ingest.extract(spark, root, fields).awaitTermination()
    assert [r.nombre for r in spark.read.parquet(f"{root}/patients").collect()] == ["Segunda"]


def test_a_day_has_one_snapshot(spark, tmp_path):
    from archivolt.plans.standins import Tables

    tables = Tables(spark, "/root/testdata/sf0.001").all()
    path = str(tmp_path / "snapshots")
    for at in ("2025-06-01 06:00:00", "2025-06-01 06:00:00", "2025-06-02 06:00:00"):
        got = ingest.daily_snapshot(spark, tables, at, path)
    assert got.count() == 30 and got.select("computed_at").distinct().count() == 2


class Poisoned(HashEmbedder):
    """An embedder that fails on some texts."""

    def __init__(self, word):
        super().__init__(4)
        self.word = word

    def embed(self, texts):
        if any(self.word in t for t in texts):
            raise ValueError(f"cannot embed {self.word}")
        return super().embed(texts)


class Folder:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.source, self.root = spark, tmp_path / "in", str(tmp_path / "out")
        self.source.mkdir()
        self.keys, self.options, self.n = spark.createDataFrame([(1, "fiebre")], "keyword_id int, term string"), options, 0

    def run(self, *rows, model=None):
        self.n += 1
        names = ("document_id", "page", "text", "page_count")
        (self.source / f"{self.n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=False))) for r in rows))
        ingest.ingest(self.spark, str(self.source), self.root, self.keys, "2025-06-01", model, 2, **self.options).awaitTermination()

    def table(self, name):
        return self.spark.read.parquet(f"{self.root}/{name}")

    def chunks(self):
        return {(r.document_id, r.chunk_index): (r.content, r.page_numbers, r.edad) for r in self.table("chunks").collect()}


def test_pages_over_three_batches(spark, tmp_path):
    pages = [(d, p, f"Hoja {p} del {d}. " + "Tiene fiebre hoy. " * 120 + ("nacido: 14/03/1985" if p == 2 else ""), 3) for d in (1, 2) for p in (1, 2, 3)]
    f = Folder(spark, tmp_path)
    f.run(pages[2], pages[3], (7, 1, "Sola, sin número de hojas."))
    assert set(f.chunks()) == {(7, 0)}  # of 1 and 2 pages are missing still
    f.run(pages[0], pages[5], (7, 2, "Y la segunda."), (8, 1, "Falta la otra.", 2))
    f.run(pages[1], pages[4])
    want = ingest.chunk_table(spark.createDataFrame([r[:3] for r in pages] + [(7, 1, "Sola, sin número de hojas."), (7, 2, "Y la segunda.")], "document_id long, page int, text string"), "2025-06-01")
    assert f.chunks() == {(r.document_id, r.chunk_index): (r.content, r.page_numbers, r.edad) for r in want.collect()}
    f.run((7, 1, "Otra primera."), pages[0][:3])  # a page with another text is a new upload; the same text changes nothing
    assert f.chunks()[7, 0][0] == "Otra primera." and f.table("pages").where("document_id = 1").count() == 3
    assert f.table("pages").where("document_id = 8").count() == 0


def test_pages_that_never_come(spark, tmp_path):
    f = Folder(spark, tmp_path, patience_ms=0)
    f.run((8, 1, "Falta la otra.", 2))
    f.run((9, 1, "Otra cosa."))
    assert f.chunks()[8, 0][0] == "Falta la otra."
    f.run((8, 2, "Llega tarde.", 2))
    f.run((9, 2, "Fin."))
    assert f.chunks()[8, 0] == ("Falta la otra. Llega tarde.", [1, 2], None) and f.chunks()[9, 0][0] == "Otra cosa. Fin."


def test_a_poisoned_page_is_put_aside(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.run(*[(d, 1, "Un veneno." if d == 5 else f"Nota {d}.") for d in range(1, 10)], model=Poisoned("veneno"))
    assert {d for d, _ in f.chunks()} == set(range(1, 10)) - {5}
    attempts = f.table("attempts").orderBy("attempt").collect()
    assert [(r.document_id, r.attempt) for r in attempts] == [(5, 1), (5, 2), (5, 3)] and "veneno" in attempts[0].error
    assert [(r.document_id, r.page, r.text) for r in f.table("quarantine").collect()] == [(5, 1, "Un veneno.")]
    assert [r.resource_id for r in f.table("audit_errors").collect()] == ["5"]
    ingest.requeue(spark, f.root, str(f.source))
    f.run((11, 1, "Sigue."), model=HashEmbedder(4))
    assert {d for d, _ in f.chunks()} == set(range(1, 10)) | {11}


def test_a_fault_of_all_is_nobodys(spark, tmp_path):
    import pytest

    f = Folder(spark, tmp_path, retries=0)
    with pytest.raises(Exception, match="cannot embed"):
        f.run(*[(d, 1, "Una nota.") for d in range(1, 4)], model=Poisoned("nota"))
    f.run((4, 1, "Otra."), model=HashEmbedder(4))
    assert {d for d, _ in f.chunks()} == {1, 2, 3, 4}
