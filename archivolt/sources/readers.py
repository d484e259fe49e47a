"""Sources: files by their bytes, CSV dictionaries, tables, page texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import fixed
from archivolt.models import Extractor
from archivolt.sources import workbook
from archivolt.sources.pdf import PdfExtractor


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder: file_id (path), filename, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


BATCH_CHARS = 1 << 22  # of texts sent on together: a batch costs as much as reading a small file
PAGES = pa.schema([("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])


def page_texts(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(file_id, page, text, error) by an extractor, that of PDF files by default; pages count from 0.

    A file it cannot read has one row with the error instead, and a null file
    is such a file. A file without pages has no rows.
    """
    reader = extractor or PdfExtractor()

    def table(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * (1 + len(PAGES))
        return pa.record_batch([pa.array(c, f) for c, f in zip(columns, [kind, *PAGES.types], strict=True)], names=["file_id", *PAGES.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, held, size = batch.column("file_id").type, [], 0
            for n in range(batch.num_rows):
                file = batch.column("file_id")[n].as_py()
                try:
                    content = batch.column("content")[n].as_py()
                    if content is None:
                        raise ValueError("no content")
                    rows = [(file, page, text, None) for page, text in sorted(reader.pages(content).items())]
                except Exception as e:  # one bad file must not fail the others
                    rows = [(file, None, None, str(e))]
                held += rows
                size += sum(len(text or "") for _, _, text, _ in rows)
                if size > BATCH_CHARS:
                    yield table(kind, held)
                    held, size = [], 0
            yield table(kind, held)

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, page int, text string, error string")


def keyword_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (term, category) of a CSV with or without a header and byte-order mark."""
    rows = spark.read.schema("term string, category string").option("encoding", "UTF-8").csv(path)
    return rows.select(F.trim(F.regexp_replace("term", "^﻿", "")).alias("term"), F.trim("category").alias("category")).where("term <> '' and lower(term) <> 'term'")


def synonym_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("canonical string, synonym string, category string").csv(path)
    return rows.withColumn("canonical", F.trim(F.regexp_replace("canonical", "^﻿", ""))).where("canonical <> '' and lower(canonical) <> 'canonical'")


def synonym_sheets(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Pairs (canonical, synonym, category) of workbooks: a sheet per category, after a header row each.

    A row without a synonym names its canonical form alone. Pairs among `known`
    are left out, and a pair comes once with the category of its first sheet
    and row.
    """
    rows = workbook.sheets(spark, path).where("row > 1").select("file", "place", "row", F.trim(F.try_element_at("cells", F.lit(1))).alias("canonical"), F.try_element_at("cells", F.lit(2)).alias("_s"), F.col("sheet").alias("category"))
    pairs = rows.where("canonical <> ''").withColumn("synonym", F.when(F.coalesce("_s", F.lit("")) == "", F.col("canonical")).otherwise(F.trim("_s")))
    once = pairs.groupBy("canonical", "synonym").agg(F.min_by("category", F.struct("file", "place", "row")).alias("category"))
    return once if known is None else once.join(known.select("canonical", "synonym"), ["canonical", "synonym"], "left_anti")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in fixed.PERMISSIONS.items() for p in ps], "role string, permission string")


def synthetic_forms(spark: SparkSession, n: int = 3, seed: int = 42) -> DataFrame:
    """Invented patient forms as page texts."""
    i = F.col("id")
    pick = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(i + seed, F.lit(salt)), F.lit(len(names))) + 1).cast("int"))
    name = F.concat_ws(" ", pick(["Ana", "Luis", "Marta", "Jorge"], 1), pick(["Rojas", "Silva", "Quispe", "Vega"], 2))
    year = (F.pmod(F.xxhash64(i + seed, F.lit(3)), F.lit(60)) + 1940).cast("string")
    text = F.concat(F.lit("FICHA DE ATENCION\nNombre: "), name, F.lit("\nNacido: 14/03/"), year, F.lit("\nHC "), (F.pmod(F.xxhash64(i + seed, F.lit(4)), F.lit(90000)) + 10000).cast("string"))
    return spark.range(n).select(F.col("id").alias("document_id"), F.lit(1).alias("page"), text.alias("text"))
