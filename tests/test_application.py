"""The engine as an application: answers with sources and trace, chat, catalogue work, recognised pages, failures."""

import json

import pytest
from pyspark.sql import functions as F

from archivolt import schemas
from archivolt.engine import Engine, User
from archivolt.functions import fixed
from archivolt.models import HashEmbedder, embed
from archivolt.operators import chat, ocr, scorecard
from archivolt.plans.standins import Tables
from archivolt.streaming import ingest

EDITOR = User(2, "eva", "editor")


class Mute:
    """Answers without citing, and remembers what it was asked with."""

    def __init__(self, *answers: str):
        self.answers, self.contexts = list(answers), []

    def answer(self, question: str, context: str) -> str:
        self.contexts.append(context)
        return self.answers[min(len(self.contexts), len(self.answers)) - 1]


def questions(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, query_text string")
    return embed(rows, "query_text", HashEmbedder(16)).withColumnRenamed("embedding", "query_vector")


def engine(spark, generator):
    rows = [(1, 1, "public", "La dosis de amoxicilina es cinco.", [1], None, "uno"), (2, 2, "public", "La fiebre alta pide reposo.", [3], 40, "dos")]
    base = spark.createDataFrame(rows, "chunk_id long, document_id long, visibility string, content string, page_numbers array<int>, edad int, original_name string")
    tables = {n: spark.createDataFrame([], schemas.schema(n)) for n in ("synonyms", "acl", "conversations", "messages", "keywords", "keyword_candidates", "proposals", "action_plans", "audit", "chunk_keywords")}
    tables |= {"chunks": embed(base.drop("original_name"), "content", HashEmbedder(16)), "documents": base.select("document_id", "original_name")}
    return Engine(spark, tables, generator=generator)


def test_a_bad_citation_is_asked_for_again_and_then_sourced(spark):
    model = Mute("cinco, ana@mail.example.org")
    e = engine(spark, model)
    got = e.ask(questions(spark, "dosis amoxicilina", "zzzz yyyy xxxx wwww"), EDITOR)
    one, two = sorted(got, key=lambda a: a["query_id"])
    assert len(model.contexts) == 2 and model.contexts[1].endswith(fixed.CITE_AGAIN) and one["retried"] and not one["grounded"]
    assert "[EMAIL]" in one["answer"] and fixed.SOURCES_HEAD in one["answer"] and "- uno, pág. [1]" in one["answer"]
    assert two["abstained"] and two["answer"] == fixed.NO_EVIDENCE
    log = {json.loads(r.detail)["question"]: (json.loads(r.detail), r) for r in e.tables["audit"].collect()}
    detail, row = log["dosis amoxicilina"]
    assert row.action == "query" and row.username == "eva" and row.n_sources == len(detail["chunks"]) >= 1 and detail["answer"] == "cinco, ana@mail.example.org"
    assert log["zzzz yyyy xxxx wwww"][0]["abstained"] and log["zzzz yyyy xxxx wwww"][1].n_sources == 0
    assert scorecard.evidence_stats(e.tables["audit"]).first().with_evidence == 1
    again = Mute("nada", "cinco [1]")
    assert engine(spark, again).ask(questions(spark, "dosis amoxicilina"))[0]["grounded"]
    assert Engine(spark, e.tables, profile="fast").pools == (5, 5)


def test_conversations_remember_and_refuse(spark):
    model = Mute("hola", "cinco [1]", "reposo [1]")
    e = engine(spark, model)
    first = e.open_conversation(EDITOR)
    other = e.open_conversation(User(3, "leo", "viewer"), "suya")
    assert (first, other) == (1, 2) and [r.title for r in e.conversations(EDITOR).collect()] == [fixed.NEW_CONVERSATION]
    assert e.say(EDITOR, first, questions(spark, "hola buenas"))["sources"] == 0
    assert e.say(EDITOR, first, questions(spark, "dosis amoxicilina"))["answer"] == "cinco [1]"
    assert model.contexts[1].startswith(fixed.HISTORY_HEAD + "(user) hola buenas") and fixed.CONTEXT_HEAD in model.contexts[1]
    refused = e.say(EDITOR, first, questions(spark, "zzzz yyyy xxxx wwww"))
    assert refused["answer"] == fixed.NO_EVIDENCE_CHAT and refused["turn"] == 6
    assert [r.role for r in e.tables["messages"].orderBy("turn").collect()] == ["user", "assistant"] * 3
    assert e.conversations(EDITOR).first().title == "hola buenas"
    e.give_feedback(EDITOR, first, 2, "useful")
    assert e.tables["messages"].where("feedback = 'useful'").count() == 1
    with pytest.raises(LookupError):
        e.say(EDITOR, other, questions(spark, "hola"))
    with pytest.raises(ValueError):
        e.say(EDITOR, first, questions(spark, "  "))
    e.delete_conversation(EDITOR, other)
    assert e.tables["conversations"].count() == 2
    e.delete_conversation(EDITOR, first)
    assert e.tables["conversations"].count() == 1 and e.tables["messages"].count() == 0


def test_catalogue_work(spark):
    e = engine(spark, Mute("x"))
    e.tables["keyword_candidates"] = spark.createDataFrame([("dosis", 9, "uno", "proposed"), ("alta", 4, "dos", "proposed")], schemas.schema("keyword_candidates"))
    e.tables["keywords"] = e.tables["keywords"].select("keyword_id", "term", "category", "priority", "is_active")
    e.add_keyword(EDITOR, "fiebre", "clinical")
    e.approve_candidates(EDITOR, ["dosis", "unknown"])
    e.reject_candidates(EDITOR, ["alta"])
    assert [(r.keyword_id, r.term) for r in e.keyword_list(EDITOR).collect()] == [(1, "fiebre"), (2, "dosis")]
    assert {r.term: r.status for r in e.candidates(EDITOR, "all").collect()} == {"dosis": "approved", "alta": "rejected"}
    e.drop_keyword(EDITOR, 1)
    assert e.keyword_list().count() == 1 and e.keyword_list(inactive=True).count() == 2
    e.set_synonyms(EDITOR, "fiebre", ["calentura"])
    assert e.synonyms().first().variants == ["fiebre", "calentura"]
    with pytest.raises(PermissionError):
        e.propose(User(9, "v", "viewer"), 1, "text")
    with pytest.raises(ValueError):
        e.propose(EDITOR, 1, " ")
    e.propose(EDITOR, 1, "better")
    e.review(EDITOR, 1, "approved")
    assert tuple(e.tables["proposals"].select("chunk_id", "status", "reviewer").first()) == (1, "approved", 2)
    admin = User(1, "root", "admin")
    e.add_plan(admin, {"plan_id": 1, "title": "more", "code": "NONE", "description": None, "owner": "eva", "due_date": None, "status": "odd"})
    e.patch_plan(admin, 1, "wrong", "said")
    assert tuple(e.plans(admin).select("code", "status", "description").first()) == (None, "open", "said")


def test_pages_are_recognised_each_by_itself(spark):
    class Fake:
        def read(self, image: bytes) -> list[dict]:
            if image == b"bad":
                raise RuntimeError("no image")
            return [{"text": w, "conf": 90.0 - 40 * i, "x": i, "y": 1, "w": 2, "h": 3} for i, w in enumerate(image.decode().split(" "))]

    images = spark.createDataFrame([(1, 1, b"one two three"), (1, 2, b"bad"), (2, 1, b"solo")], "document_id long, page int, content binary")
    words = ocr.recognise(images, Fake(), 3)
    assert {(r.document_id, r.page) for r in words.where("conf < 0").collect()} == {(1, 2)}
    kept = ocr.page_text(ocr.words_of(words)).collect()
    assert {(r.document_id, r.page): (r.text, r.score) for r in kept} == {(1, 1): ("one two", 70.0), (2, 1): ("solo", 90.0)}
    assert ocr.recognise(images.limit(0), Fake()).count() == 0


def test_angles(spark):
    rows = [(90, 5.0, False, 0, 0, 90), (0, 0.5, False, 10, 60, 180), (0, 0.5, False, 50, 50, 0), (0, 2.0, False, 10, 90, 0), (0, None, False, 10, 90, 0), (0, None, True, 30, 41, 0), (None, None, True, 30, 80, 180)]
    df = spark.createDataFrame(rows, "found int, conf double, failed boolean, s0 int, s180 int, want int")
    assert [r.a for r in df.select(ocr.angle(*map(F.col, ("found", "conf", "failed", "s0", "s180"))).alias("a")).collect()] == [r[-1] for r in rows]


def test_one_failing_source_costs_its_own_indicators(spark, tmp_path):
    tables = Tables(spark, "/root/testdata/sf0.001").all()
    broken = {**tables, "messages": tables["messages"].select("turn")}
    values, errors = scorecard.kpi_values_isolated(spark, broken)
    assert list(errors) == ["feedback"]
    assert {r.code for r in values.where("value is null").collect()} == {"FEEDBACK_USEFUL", "FEEDBACK_UNUSEFUL"}
    with pytest.warns(UserWarning):
        assert ingest.daily_snapshot(spark, broken, "2025-06-01 06:00:00", str(tmp_path / "s")).count() == 13


def test_a_failed_batch_leaves_error_rows_and_runs_again(spark, tmp_path, monkeypatch):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"document_id": 7, "page": 1, "text": "Una nota."}))
    keys = spark.createDataFrame([(1, "nota")], "keyword_id int, term string")
    real = ingest.knowledge.match_keywords

    def fail(*_):
        raise RuntimeError("disk full")

    monkeypatch.setattr(ingest.knowledge, "match_keywords", fail)
    with pytest.raises(Exception, match="disk full"):
        ingest.ingest(spark, str(source), root, keys, "2025-06-01", None, 2).awaitTermination()
    rows = spark.read.parquet(f"{root}/audit_errors").collect()
    assert [(r.action, r.resource_id, json.loads(r.detail)["error"]) for r in rows] == [("error", "7", "disk full")]
    monkeypatch.setattr(ingest.knowledge, "match_keywords", real)
    ingest.ingest(spark, str(source), root, keys, "2025-06-01", None, 2).awaitTermination()
    assert spark.read.parquet(f"{root}/chunk_keywords").count() == 1


def test_a_refreshed_table_is_read_again_after_its_time(spark):
    now, loads = [0.0], []

    def load():
        loads.append(1)
        return spark.range(len(loads))

    kept = ingest.Refreshed(load, 300, lambda: now[0])
    assert kept.get().count() == kept.get().count() == 1
    now[0] = 301
    assert kept.get().count() == 2
    kept.forget()
    assert kept.get().count() == 3


def test_titles(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 200,)], "t string")
    assert [r[0] for r in df.select(chat.title(F.col("t"))).collect()] == [fixed.NEW_CONVERSATION] * 2 + ["x" * 120]


def test_accounts(spark):
    e = engine(spark, Mute("x"))
    e.tables |= {"users": spark.createDataFrame([], schemas.schema("users"))}
    e.tables["keywords"] = e.tables["keywords"].withColumn("created_by", F.lit(2).cast("long"))
    assert e.add_user(None, "root", "r@x.example", "viewer") == "admin"
    admin = User(1, "root", "admin")
    assert e.add_user(admin, "eva", "e@x.example", "editor") == "editor"
    for wrong in (("eva", "editor"), ("leo", "admin"), ("leo", "king")):
        with pytest.raises(ValueError):
            e.add_user(admin, wrong[0], "", wrong[1])
    with pytest.raises(PermissionError):
        e.add_user(EDITOR, "leo", "", "viewer")
    e.patch_user(admin, 2, role="auditor", is_active=False)
    assert [(r.username, r.role, r.is_active) for r in e.users(admin).collect()] == [("root", "admin", True), ("eva", "auditor", False)]
    with pytest.raises(ValueError):
        e.patch_user(admin, 2)
    e.delete_user(admin, 2)
    assert e.users(admin).count() == 1


def test_documents_and_reports(spark):
    e = engine(spark, Mute("x"))
    t = Tables(spark, "/root/testdata/sf0.001").all()
    admin = User(1, "root", "admin")
    e.tables |= t | {"word_boxes": spark.createDataFrame([(1, 1, 0, "dosis")], "document_id bigint, page int, box_index int, text string")}
    e.tables["chunks"] = spark.createDataFrame([(1, 1, "La dosis y la dosis.", [1]), (2, 1, "otra dosis", [2])], "chunk_id bigint, document_id bigint, content string, page_numbers array<int>")
    assert e.correct_word(EDITOR, 1, 1, 0, " DOSIS ") == "dosis"
    assert [r.content for r in e.tables["chunks"].orderBy("chunk_id").collect()] == ["La DOSIS y la dosis.", "otra dosis"] and e.tables["word_boxes"].first().text == "DOSIS"
    with pytest.raises(LookupError):
        e.correct_word(EDITOR, 1, 1, 9, "x")
    e.reprocess(EDITOR, [0, 1])
    assert [r.status for r in e.document(0).union(e.document(1)).collect()] == ["pending", "processing"]
    files = spark.createDataFrame([(1, "a.pdf", bytearray(b"%PDF-1 x")), (2, "b.txt", bytearray(b"x"))], "file_id int, filename string, content binary")
    assert {r.file_id: r.status_code for r in e.upload(EDITOR, files).collect()} == {1: 200, 2: 400}
    assert e.report(admin).startswith(b"%PDF") and e.report(admin, workbook=True)[:2] == b"PK"
    assert e.support(admin)["queries"] == 50 and set(e.knowledge(admin)) == {"coverage", "matches", "gaps", "heatmap"}
    assert e.knowledge(admin)["coverage"].first().total == 13 and e.keyword_domains(admin).count() > 3
    assert e.history(admin, 5).count() == 5 and e.audit_export(admin, 7, since="2024-01-01", action="query").count() == 7
    rows = spark.createDataFrame([("Nuevo ", "x"), ("the", "y"), ("", "z")], "term string, category string")
    assert e.import_keywords(admin, rows) == 1 and e.keyword_list(admin, "x").first().term == "Nuevo"
    pairs = spark.createDataFrame([("dolor", "pena", "c"), ("dolor", "Pena", "c"), ("solo", None, "c")], "canonical string, synonym string, category string")
    assert e.import_synonyms(admin, pairs) == 2 and e.expand_term("PENA") == ["dolor", "pena"]
    e.drop_synonyms(admin, "dolor")
    assert e.expand_term("pena") == []
    with pytest.raises(PermissionError):
        e.report(User(5, "v", "viewer"))
