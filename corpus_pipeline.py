"""From raw documents to packed training sequences, stage by stage.

Each stage is a function of (spark, docs, sf_dir), works on all its
predecessor kept and is written as Parquet before the next one reads it. All
but the last return the columns of `documents`. In every stage an empty table
gives an empty result, other columns than those of `documents` are not read, a
null doc_id stays null, and very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import langid, packing, simhash, substring, toxicity
from archivolt.llm.common import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages; those in none (`und`) go.

    These are texts without a letter, and texts of which a background of
    equally likely n-grams explains more than half better than any language.

    The column lang keeps its label where there is one and takes the
    prediction where there is none. Null texts have no language, and without
    any label no text has. Repeated rows all stay.
    """
    model = langid.train(langid.labelled(docs))
    return langid.with_language(docs.select(*COLUMNS), model, background=True).where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below 0.5.

    Texts without letters score 0 and stay; without labels of both classes all
    stay. Repeated rows share their fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = toxicity.train(docs, toxicity.training_labels(labels))
    return toxicity.with_score(docs.select(*COLUMNS), field).where("score < 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one of smallest doc_id.

    Documents are near-duplicates if a chain of texts links them, each with the
    next at a Jaccard similarity of 0.8 or more of their five-word shingles;
    candidates come from SimHash fingerprints. Texts without words are alike.
    Of rows of one doc_id in a group one stays; a group without any doc_id
    keeps one row.
    """
    return simhash.keep_one(docs.select(*COLUMNS), words=5, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the words inside repeated 35-word windows; every document stays, if only with what is left.

    A null text becomes empty; a text that loses nothing stays as it is.
    """
    cut = substring.remove_repeats(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    return cut.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; an empty text is one token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
