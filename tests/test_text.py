"""Text, personal data and field functions on literal rows."""

from pyspark.sql import functions as F

from archivolt.functions import fields, pii, text, vector
from archivolt.models import ExtractiveGenerator, HashEmbedder, embed_missing, json_object
from archivolt.operators import fts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_masking_counts_and_clean_text(spark):
    dirty = "Paciente 12345678A con telefono 612 345 678"
    assert one(spark, dirty, pii.mask) == "Paciente [DNI] con telefono [TELEFONO]"
    assert one(spark, dirty, pii.masked_count) == 2
    assert one(spark, "un texto limpio", pii.masked_count) == 0
    assert one(spark, "un texto limpio", pii.mask) == "un texto limpio"
    assert one(spark, None, pii.mask) is None


def test_birth_dates(spark):
    day = F.lit("2025-06-01").cast("date")
    age = lambda s: one(spark, s, lambda c: pii.age(pii.birth_date(c), day))
    assert age("nacido: 14/03/1985") == 40
    assert age("nacida el 2-6-40") == 84
    assert age("nacido 99/99/9999") is None
    assert age("sin fecha") is None
    assert age("nacido 01/01/2030") is None


def test_terms_sentences_and_headings(spark):
    assert one(spark, "la dosis, de IV hr ab x", text.query_terms) == ["dosis", "hr"]
    assert one(spark, "Uno. Dos!\n\n\n\n tres\n", text.sentences) == ["Uno.", "Dos!", "tres"]
    assert one(spark, "DIAGNOSTICO PRINCIPAL", text.heading) == "Diagnostico Principal"
    assert one(spark, "", text.heading) == "General"
    assert len(one(spark, "x" * 400, text.excerpt)) == 240


def test_normal_forms(spark):
    assert one(spark, "  D.N.I_ñ ", text.normal_term) == "d n i n"
    assert one(spark, "D N I", text.compact_term) == "dni"
    assert one(spark, "Año  中ß", text.fold) == "ano"


def test_grounding_and_small_talk(spark):
    grounded = lambda s, n: one(spark, s, lambda c: text.is_grounded(c, F.lit(n)))
    assert grounded("dosis [1]", 1) and not grounded("dosis [2]", 1) and not grounded("dosis", 1)
    assert one(spark, "Hola, ¿qué tal?", text.is_small_talk)
    assert not one(spark, "hola, dosis del paciente", text.is_small_talk)
    assert one(spark, "No se encuentra en el contexto", text.is_refusal)


def test_fields(spark):
    assert one(spark, "210", fields.age) is None and one(spark, "45 a", fields.age) == "45"
    assert one(spark, "2024-03-14", fields.date) == "14/03/2024" and one(spark, "31/02/2024", fields.date) is None
    assert one(spark, "mujer", fields.sex) == "F" and one(spark, "hombre", fields.sex) == "M"
    assert one(spark, ["a", " A ", "b", ""], fields.short_list, "array<string>") == ["a", "b"]


def test_trigrams_and_cosine(spark):
    assert sorted(one(spark, "word", vector.trigrams)) == sorted(["  w", " wo", "wor", "ord", "rd "])
    assert one(spark, [0.0, 0.0], lambda c: vector.cosine(c, c), "array<double>") is None
    assert abs(one(spark, [3.0, 4.0], lambda c: vector.cosine(c, c), "array<double>") - 1) < 1e-12


def test_stems_and_cover_density():
    assert [fts.stem(w) for w in ("chicas", "chico", "tratamientos", "tratamiento")] == ["chic", "chic", "tratamient", "tratamient"]
    assert fts.stem("cheque") == "chequ"
    assert fts.cover_density({"a": [1, 10], "b": [3]}, ["a", "b"]) == 1 / 3 + 1 / 8
    assert fts.cover_density({}, ["a"]) == 0.0
    assert fts.word_similarity("word", "") == 0.0 and fts.word_similarity("word", "a word b") == 1.0


def test_models(spark):
    assert json_object('```json\n{"a": [1, {"b": "c') == {"a": [1, {"b": "c"}]}
    assert json_object("none") == {}
    df = spark.createDataFrame([(1, "uno dos", None), (2, "tres", [1.0])], "id int, content string, embedding array<float>")
    out = {r.id: r.embedding for r in embed_missing(df, "content", HashEmbedder(8)).collect()}
    assert out[2] == [1.0] and abs(sum(x * x for x in out[1]) - 1) < 1e-6
    assert ExtractiveGenerator().answer("la dosis", "[1] Documento: x\nLa dosis es 5. Otra cosa.").endswith("[1]")
