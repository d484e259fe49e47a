"""Schemas of the engine's tables, as DDL, and a check of frames against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SCHEMAS = {
    "users": "user_id bigint, username string, email string, role string, is_active boolean, created_at timestamp",
    "documents": "document_id bigint, filename string, original_name string, file_hash string, mime_type string, file_size bigint, page_count int, status string, total_chunks int, visibility string, metadata struct<domains:array<string>,ocr_pages:array<int>,low_pages:array<int>,timings:struct<ocr_s:double,embed_s:double,total_s:double>>, created_at timestamp, processed_at timestamp",
    "pages": "document_id bigint, page int, text string, age int",
    "word_boxes": "document_id bigint, page int, box_index int, text string, x int, y int, w int, h int",
    "chunks": "chunk_id bigint, document_id bigint, chunk_index int, content string, page_numbers array<int>, token_count int, edad int, section string, fragment string, ocr_score double, ocr_engine string, low_confidence boolean, embedding array<float>",
    "synonyms": "edge_id int, canonical string, synonym string, category string",
    "keywords": "keyword_id int, term string, category string, description string, priority int, is_active boolean, created_by bigint, created_at timestamp",
    "chunk_keywords": "chunk_id bigint, keyword_id int, match_count bigint",
    "keyword_candidates": "term string, count bigint, sample_document string, status string",
    "conversations": "conversation_id bigint, user_id bigint, title string, created_at timestamp, updated_at timestamp",
    "messages": "conversation_id bigint, turn bigint, role string, content string, sources array<bigint>, feedback string, created_at timestamp",
    "proposals": "chunk_id bigint, proposer bigint, content string, status string, reviewer bigint, reviewed_at timestamp, comment string",
    "audit": "audit_id bigint, user_id bigint, username string, action string, resource_type string, resource_id string, detail string, n_sources int, ip string, created_at timestamp",
    "acl": "document_id bigint, role string",
    "kpis": "code string, perspective string, direction string, unit string, target double, amber double, red double, query_type string",
    "kpi_snapshots": "kpi string, period_start timestamp, period_end timestamp, value double, computed_at timestamp",
    "alerts": "code string, severity string, message string, status string, created_at timestamp, resolved_by string",
    "action_plans": "plan_id bigint, code string, title string, description string, owner string, due_date timestamp, status string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def check(df: DataFrame, name: str) -> DataFrame:
    """df itself, if it has the table's columns that it names with their types; else an error."""
    want = {f.name: f.dataType.simpleString() for f in schema(name)}
    wrong = {c: t for c, t in df.dtypes if c in want and want[c] != t}
    unknown = [c for c in df.columns if c not in want]
    if wrong or unknown:
        raise ValueError(f"{name}: wrong types {wrong}, unknown columns {unknown}")
    return df
