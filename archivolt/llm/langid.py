"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from archivolt.llm.common import remainder

UNKNOWN = "und"
BUCKETS = 1 << 16
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Hashed character trigrams of the lower-cased letters; other characters part words."""
    if not _LETTER:
        _LETTER.append(_letter_table())
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = _LETTER[0][points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    code = points[:-2] * _MIX[0] + points[1:-1] * _MIX[1] + points[2:] * _MIX[2]
    return ((code >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """languages, and for each bucket the likelihood in each language."""

    languages: list[str]
    likelihood: np.ndarray

    @staticmethod
    def fit(languages: list[str], counts: np.ndarray) -> Model:
        """From counts (language x bucket), with half a count added everywhere."""
        p = counts + np.float32(0.5)
        return Model(languages, np.ascontiguousarray((p / p.sum(axis=1, keepdims=True)).T.astype(np.float32)))


    def with_background(self) -> Model:
        """The model with UNKNOWN as one more language, in which all n-grams are equally likely."""
        if not self.languages:
            return self
        flat = np.full((BUCKETS, 1), 1 / BUCKETS, np.float32)
        return Model([*self.languages, UNKNOWN], np.ascontiguousarray(np.concatenate([self.likelihood, flat], axis=1)))


def expectation_maximisation(p: np.ndarray, n: np.ndarray, weight: np.ndarray, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of p, and the log-likelihood of n-grams met n times.

    Each round shares out every n-gram among the languages by weight times
    likelihood, and takes the shares' means as the new weights.
    """
    total = n.sum()
    for _ in range(rounds):
        new = weight * ((n / (p @ weight)) @ p) / total
        moved = np.abs(new - weight).max()
        weight = new
        if moved < tolerance:
            break
    return weight, float(n @ np.log(p @ weight))


def mixture(model: Model, text: str | None, penalty: float = 2.0) -> dict[str, float]:
    """Languages of a text and their proportions, largest first; empty without letters.

    Starting from all languages, the one of least weight goes as long as the
    penalised log-likelihood rises: each language costs penalty * ln(number of
    n-grams), so that a stray word does not count as a language.
    """
    codes = grams(text or "")
    if not len(codes) or not model.languages:
        return {}
    n = np.bincount(codes, minlength=BUCKETS)
    met = np.flatnonzero(n)
    p, n = model.likelihood[met], n[met].astype(np.float32)
    chosen = np.arange(len(model.languages))
    cost = penalty * np.log(len(codes))
    weight, fit = expectation_maximisation(p, n, np.full(len(chosen), 1 / len(chosen), np.float32))
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), weight.argmin())
        start = weight[rest] + np.float32(1e-3)
        w, f = expectation_maximisation(p[:, rest], n, (start / start.sum()).astype(np.float32))
        if f + cost < fit:
            break
        p, chosen, weight, fit = p[:, rest], chosen[rest], w, f
    order = np.argsort(-weight, kind="stable")
    return {model.languages[chosen[i]]: float(min(1.0, weight[i])) for i in order}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            own = totals.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            own += np.bincount(grams(text.as_py() or ""), minlength=BUCKETS)
    for lang, own in totals.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])


def train(rows: DataFrame, sample: int = 2000) -> Model:
    """Fit to labelled rows (doc_id, text, lang).

    The fit is on a sample of about `sample` rows of each language, chosen by a
    hash of doc_id; a language of fewer rows gives all of them. Every language
    with a label is learned. The table of n-gram counts that comes to the driver
    and the model have a row for each language and a column for each bucket,
    whatever the number of documents. No labelled rows give a model without
    languages, which predicts nothing.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = rows.where(drawn < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    got = few.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS), np.float32)
    counts[got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model.fit(languages, counts)


_OUT = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            found = [mixture(model, t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([next(iter(m), UNKNOWN) for m in found], pa.string()),
                    pa.array([next(iter(m.values()), 0.0) for m in found], pa.float64()),
                    pa.array([list(m) for m in found], pa.list_(pa.string())),
                    pa.array([list(m.values()) for m in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "lang_pred", "score", "languages", "proportions"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, and the languages with their proportions.

    A null text or one without a letter is `und` with score 0, and so is every
    text if the model has no languages. Texts are read whole. Only the text
    decides. Rows are independent: repeated rows give repeated results, a null
    doc_id stays null, other columns are not read, an empty table gives an
    empty result. The model is broadcast; its size is bounded by `train`.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood))
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), _OUT)


def main_language(model: Model, text: str | None) -> str:
    """The language of the largest share; UNKNOWN without letters, or if over half of the text is of no learned language.

    The latter needs a model with a background: what it explains better than
    any language, such as another script or random letters, is of none.
    """
    found = mixture(model, text)
    if found.get(UNKNOWN, 0.0) > 0.5:
        return UNKNOWN
    return next((x for x in found if x != UNKNOWN), UNKNOWN)


def with_language(docs: DataFrame, model: Model, background: bool = False) -> DataFrame:
    """All columns of docs and lang_pred; a column of that name is replaced.

    With a background a text that is mostly of no learned language is `und`.
    """
    known = model.with_background() if background else model
    shared = docs.sparkSession.sparkContext.broadcast((known.languages, known.likelihood))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = Model(*shared.value)
        for batch in batches:
            found = [main_language(used, t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "lang_pred"])

    docs = docs.drop("lang_pred")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType())]))


def labelled(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those with a language whose remainder is not the held-out one."""
    return docs.where(F.col("lang").isNotNull() & (F.coalesce(remainder("doc_id", 4), F.lit(2)) != 2)).select("doc_id", "text", "lang")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`, learned from the rows not held out; odd rows as in identify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(labelled(docs)))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "proportions")
