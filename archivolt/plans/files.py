"""Queries on files: documents written as PDF and XLSX and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.plans.catalog import query
from archivolt.plans.documents import Z
from archivolt.sources import readers, shared, sinks, workbook

ENDS = rf"^[{Z}]+|[{Z}]+$"


@query(
    f"""SELECT document_id, CAST(page AS INTEGER) AS page, sha256(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (line <> ''), ''), '{ENDS}', '', 'g')) AS text_sha256
FROM (SELECT document_id, pos // 45 AS page, pos, line FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM docs)) GROUP BY document_id, page""",
    "docs",
)
def pdf_pages(t):
    """The texts of all documents as PDF files, and the text of each of their pages."""
    pages = readers.page_texts(sinks.pdf_files(t.documents))
    return pages.select(F.col("file_id").alias("document_id"), "page", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CAST(document_id AS VARCHAR) AS document_id, original_name, lang, sha256(text) AS text_sha256 FROM docs", "docs")
def workbook_rows(t):
    """All documents as XLSX workbooks, a file per task, and their cells read again."""
    path = shared.folder(t.spark, "workbooks")
    sinks.write_workbooks(t.documents.select("document_id", "original_name", "lang", "text"), path)
    cells = workbook.sheets(t.spark, path).where("row > 1").select("cells")
    names = ["document_id", "original_name", "lang", "text"]
    return cells.select(*[F.col("cells")[n].alias(c) for n, c in enumerate(names)]).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(
    "SELECT DISTINCT trim(lang) AS canonical, trim(coalesce(nullif(source, ''), lang)) AS synonym, 'rows' AS category FROM documents WHERE trim(lang) <> ''",
)
def synonym_sheets(t):
    """Pairs of all documents' languages and sources, through workbooks and their reader."""
    path = shared.folder(t.spark, "synonyms")
    sinks.write_workbooks(t.raw("documents").select(F.col("lang").alias("canonical"), F.col("source").alias("synonym")), path)
    return readers.synonym_sheets(t.spark, path)
