"""Work that people do on the engine's findings: candidates, proposals, action plans, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAN_STATES = ("open", "in_progress", "done", "cancelled")
MAY_PROPOSE = ("admin", "editor", "assistant")
HEAVY_KEYS = ("word_boxes", "extracted_data", "timings")


def candidates(stored: DataFrame, status: str | None = "proposed") -> DataFrame:
    """Keyword candidates of a status, or of all, the most frequent first."""
    rows = stored if status in (None, "", "all") else stored.where(F.col("status") == status)
    return rows.orderBy(F.desc("count"), F.asc("term"))


def approve(stored: DataFrame, keywords: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates approved, and the catalogue with their terms active: known ones again, others added.

    terms has the column term; those that are no candidates have no effect.
    """
    chosen = stored.join(terms.select("term").distinct(), "term", "left_semi").select("term").withColumn("_yes", F.lit(True))
    marked = stored.join(chosen, "term", "left").withColumn("status", F.when(F.col("_yes"), "approved").otherwise(F.col("status"))).drop("_yes")
    known = keywords.join(chosen, "term", "left").withColumn("is_active", F.coalesce("_yes", "is_active")).drop("_yes").select(*keywords.columns)
    top = keywords.agg(F.coalesce(F.max("keyword_id"), F.lit(0)).alias("_top"))
    fresh = chosen.join(keywords, "term", "left_anti").select("term").crossJoin(F.broadcast(top))
    w = Window.partitionBy(F.lit(0)).orderBy("term")  # the terms of one request
    values = {"keyword_id": (F.col("_top") + F.row_number().over(w)), "term": F.col("term"), "priority": F.lit(1), "is_active": F.lit(True)}
    added = fresh.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in keywords.schema])
    return marked, known.unionByName(added)


def reject(stored: DataFrame, terms: DataFrame) -> DataFrame:
    no = terms.select("term").distinct().withColumn("_no", F.lit(True))
    return stored.join(no, "term", "left").withColumn("status", F.when(F.col("_no"), "rejected").otherwise(F.col("status"))).drop("_no")


def propose(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Open proposals added (chunk_id, proposer, role, content): of roles that may, and with a text."""
    ok = new.where(F.col("role").isin(*MAY_PROPOSE) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    values = {"chunk_id": F.col("chunk_id"), "proposer": F.col("proposer"), "content": F.col("content"), "status": F.lit("proposed")}
    if "created_at" in new.columns:
        values["created_at"] = F.col("created_at")
    return stored.unionByName(ok.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema]))


def proposals(stored: DataFrame) -> DataFrame:
    """All proposals, the newest first."""
    return stored.orderBy(F.desc("created_at"), F.asc("chunk_id"))


def plan_state(c: Column) -> Column:
    return F.when(c.isin(*PLAN_STATES), c)


def add_plans(stored: DataFrame, new: DataFrame, kpis: DataFrame) -> DataFrame:
    """Plans added (plan_id, title, code, description, owner, due_date, status): unknown indicators and states fall back."""
    there = kpis.select("code", F.lit(True).alias("_there")).distinct()
    rows = new.join(there, "code", "left").withColumns({"code": F.when(F.col("_there"), F.col("code")), "status": F.coalesce(plan_state(F.col("status")), F.lit("open"))})
    return stored.unionByName(rows.select(*stored.columns))


def plans(stored: DataFrame, order: str = "plan_id") -> DataFrame:
    """All plans, the newest first."""
    return stored.orderBy(F.desc(order))


def patch_plans(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """Plans with the valid states and the descriptions of a patch (plan_id, status, description)."""
    p = patch.select("plan_id", plan_state(F.col("status")).alias("_s"), F.col("description").alias("_d"))
    return stored.join(p, "plan_id", "left").withColumns({"status": F.coalesce("_s", "status"), "description": F.coalesce("_d", "description")}).select(*stored.columns)


def light(metadata: Column) -> Column:
    """A document's metadata (a map) without its heavy keys; null if nothing is left."""
    left = F.map_filter(metadata, lambda k, _: ~k.isin(*HEAVY_KEYS))
    return F.when(F.size(left) > 0, left)


def catalogue(keywords: DataFrame, category: str | None = None, inactive: bool = False) -> DataFrame:
    """The catalogue by category and term; terms without a category come last."""
    k = keywords if inactive else keywords.where("is_active")
    if category is not None:
        k = k.where(F.col("category") == category)
    return k.orderBy(F.asc_nulls_last("category"), F.asc("term"))


def failures(rows: DataFrame, stage: str, error: str | Column, at: Column) -> DataFrame:
    """Audit rows of documents whose processing failed; the error's first 200 characters."""
    said = F.lit(error[:200]) if isinstance(error, str) else F.substring(error, 1, 200)
    detail = F.to_json(F.struct(F.lit(stage).alias("stage"), F.col("_e").alias("error")))
    failed = rows.select("document_id", said.alias("_e")).distinct()
    return failed.select(F.lit("error").alias("action"), F.lit("document").alias("resource_type"), F.col("document_id").cast("string").alias("resource_id"), detail.alias("detail"), at.alias("created_at"))
