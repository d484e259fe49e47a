"""Changes to tables: imports, upserts, cascades, corrections. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import fields, fixed, text


def dedupe_by_hash(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Files whose content is new: one per SHA-256, and none that is stored already."""
    hashed = files.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256))
    w = Window.partitionBy("file_hash").orderBy("file_id")
    new = hashed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return new if existing is None else new.join(existing.select("file_hash"), "file_hash", "left_anti")


def validate_files(files: DataFrame, existing: DataFrame | None = None, most: int = 100 * 1024 * 1024) -> DataFrame:
    """ok, status_code and error of each file instead of exceptions."""
    head = F.ltrim(F.decode(F.substring(F.col("content").cast("binary"), 1, 1024), "ISO-8859-1"))
    wrong = lambda code, error: F.struct(F.lit(code).alias("code"), F.lit(error).alias("error"))
    checks = F.when(~F.lower("filename").endswith(".pdf"), wrong(400, "not a PDF"))
    checks = checks.when(F.length("content") > most, wrong(413, "too large")).when(~head.startswith("%PDF"), wrong(400, "no PDF header"))
    out = files.withColumn("_c", checks).withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256))
    w = Window.partitionBy("file_hash").orderBy("file_id")
    repeat = F.row_number().over(w) > 1
    if existing is not None:
        out = out.join(existing.select("file_hash").distinct().withColumn("_there", F.lit(True)), "file_hash", "left")
        repeat = repeat | F.coalesce("_there", F.lit(False))
    code = F.coalesce("_c.code", F.when(repeat, 409), F.lit(200))
    error = F.coalesce("_c.error", F.when(repeat, F.lit("already stored")))
    return out.select("file_id", "filename", "file_hash", code.alias("status_code"), (code == 200).alias("ok"), error.alias("error"))


def import_keywords(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """New catalogue terms of an import (term, category): trimmed, not blank, not the header, not stored, each once."""
    t = rows.select(F.trim("term").alias("term"), F.trim("category").alias("category")).where("term is not null and term <> '' and lower(term) <> 'term'")
    return t.groupBy("term").agg(F.min("category").alias("category")).join(stored.select("term"), "term", "left_anti")


def import_synonyms(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """New pairs of an import; a missing synonym is the canonical form itself."""
    low = [F.lower("canonical").alias("_c"), F.lower("synonym").alias("_s")]
    r = rows.select(F.trim("canonical").alias("canonical"), F.coalesce(F.nullif(F.trim("synonym"), F.lit("")), F.trim("canonical")).alias("synonym"), "category").where("canonical <> ''")
    return r.select("*", *low).dropDuplicates(["_c", "_s"]).join(stored.select(*low), ["_c", "_s"], "left_anti").drop("_c", "_s")


def seed_edges(groups: DataFrame) -> DataFrame:
    """Forward and reverse edges of groups (group_id, canonical, forms, category), each once."""
    each = groups.select("group_id", "canonical", "category", F.posexplode("forms").alias("n", "form")).where("form <> canonical")
    forward = each.select("group_id", F.lit(0).alias("side"), "n", "canonical", F.col("form").alias("synonym"), "category")
    back = each.select("group_id", F.lit(1).alias("side"), "n", F.col("form").alias("canonical"), F.col("canonical").alias("synonym"), "category")
    w = Window.partitionBy("canonical", "synonym").orderBy("group_id", "side", "n")
    return forward.unionByName(back).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seed_missing(stored: DataFrame, seed: DataFrame, *key: str) -> DataFrame:
    """Rows of the seed whose key is not stored; running it again adds nothing."""
    return seed.join(stored.select(*key), list(key), "left_anti")


def upsert_keyword(stored: DataFrame, term: str, category: str | None, priority: int = 1) -> DataFrame:
    """Catalogue with the term active: an inactive one returns, a new one is added, an active one is an error."""
    row = stored.where(F.col("term") == term).select("is_active").first()
    if row and row[0]:
        raise ValueError(f"keyword exists: {term}")
    if row:
        return stored.withColumn("is_active", F.when(F.col("term") == term, True).otherwise(F.col("is_active")))
    number = stored.agg(F.coalesce(F.max("keyword_id"), F.lit(0)) + 1).first()[0]
    return stored.unionByName(stored.sparkSession.createDataFrame([(number, term, category, priority, True)], stored.select("keyword_id", "term", "category", "priority", "is_active").schema))


def patch_keyword(stored: DataFrame, keyword_id: int, **changes) -> DataFrame:
    """Change some columns of a keyword; `domain` is another name of category."""
    if "domain" in changes:
        changes["category"] = changes.pop("domain")
    hit = F.col("keyword_id") == keyword_id
    return stored.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(stored.schema[c].dataType) for c, v in changes.items()})


def delete_keyword(stored: DataFrame, keyword_id: int) -> DataFrame:
    return patch_keyword(stored, keyword_id, is_active=False)


def replace_synonyms(stored: DataFrame, canonical: str, variants: list[str], category: str | None) -> DataFrame:
    """All rows of a canonical form replaced: itself first, variants trimmed and distinct whatever their case."""
    seen: dict[str, str] = {}
    for v in [canonical, *variants]:
        if v.strip():
            seen.setdefault(v.strip().lower(), v.strip())
    start = stored.agg(F.coalesce(F.max("edge_id"), F.lit(0))).first()[0]
    new = stored.sparkSession.createDataFrame([(start + n, canonical, v, category) for n, v in enumerate(seen.values(), 1)], "edge_id int, canonical string, synonym string, category string")
    return stored.where(F.col("canonical") != canonical).select(*new.columns).unionByName(new)


def delete_documents(t: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without some documents (document_id); those being processed stay."""
    ids = t["documents"].where("status <> 'processing'").join(gone, "document_id", "left_semi").select("document_id")
    chunks = t["chunks"].join(ids, "document_id", "left_semi").select("chunk_id")
    out = dict(t)
    out["documents"] = t["documents"].join(ids, "document_id", "left_anti")
    out["chunk_keywords"] = t["chunk_keywords"].join(chunks, "chunk_id", "left_anti")
    if "proposals" in t:
        doomed = chunks.withColumn("_gone", F.lit(True))
        out["proposals"] = t["proposals"].join(doomed, "chunk_id", "left").where("_gone is null or status = 'approved'").drop("_gone")
    out["chunks"] = t["chunks"].join(ids, "document_id", "left_anti")
    return out


def delete_user(t: dict[str, DataFrame], user_id: int, admin_id: int) -> dict[str, DataFrame]:
    """Tables without a user: conversations go, authorship is blanked, proposals pass to the admin."""
    if user_id == admin_id:
        raise ValueError("users cannot delete themselves")
    out = dict(t)
    hit = lambda c: F.col(c) == user_id
    out["users"] = t["users"].where(~hit("user_id"))
    mine = t["conversations"].where(hit("user_id")).select("conversation_id")
    out["messages"] = t["messages"].join(mine, "conversation_id", "left_anti")
    out["conversations"] = t["conversations"].where(~hit("user_id"))
    out["keywords"] = t["keywords"].withColumn("created_by", F.when(hit("created_by"), None).otherwise(F.col("created_by")))
    p = t["proposals"].withColumn("reviewer", F.when(hit("reviewer"), None).otherwise(F.col("reviewer")))
    out["proposals"] = p.withColumn("proposer", F.when(hit("proposer"), F.lit(admin_id)).otherwise(F.col("proposer")))
    return out


def replace_by_document(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in place of all rows of their documents; running it again changes nothing."""
    return stored.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def correct_word(chunks: DataFrame, document_id: int, page: int, old: str, new: str) -> DataFrame:
    """First occurrence of old replaced in the chunks of a page; their embeddings become null."""
    at = F.instr("content", old)
    hit = (F.col("document_id") == document_id) & F.array_contains("page_numbers", page) & (at > 0)
    fixed_text = F.concat(F.expr("substring(content, 1, instr(content, %s) - 1)" % _sql(old)), F.lit(new), F.expr("substring(content, instr(content, %s) + %d)" % (_sql(old), len(old))))
    changes = {"content": F.when(hit, fixed_text).otherwise(F.col("content"))}
    if "embedding" in chunks.columns:
        changes["embedding"] = F.when(~hit, F.col("embedding"))
    return chunks.withColumns(changes)


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def patch_patient(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """Fields of a patch (document_id, ...) over the stored ones where they are valid; patched rows are manual."""
    check = {"nombre": fields.name, "edad": fields.age, "sexo": fields.sex, "dni": fields.national_id, "historia_clinica": fields.record_number, "fecha_atencion": fields.date}
    p = patch.select("document_id", *[F.col(c).alias("_" + c) for c in check], F.lit(True).alias("_patched"))
    j = stored.join(p, "document_id", "left")
    merged = {c: f(F.coalesce("_" + c, c)) for c, f in check.items()}
    return j.withColumns(merged).withColumn("manual", F.coalesce("_patched", "manual", F.lit(False))).drop("_patched", *["_" + c for c in check])


def append_audit(rows: DataFrame) -> DataFrame:
    """Rows that may enter the audit log: those of a known action."""
    return rows.where(F.col("action").isin(*fixed.AUDIT_ACTIONS))


def page_of(df: DataFrame, page: int, size: int, *order) -> DataFrame:
    """One page of a sorted table; pages count from 1."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def review(proposals: DataFrame, chunk_id: int, status: str, reviewer: int, comment: str | None = None) -> DataFrame:
    """Approve or reject an open proposal, with the reviewer's comment."""
    hit = (F.col("chunk_id") == chunk_id) & (F.col("status") == "proposed")
    return proposals.withColumns({"reviewer": F.when(hit, F.lit(reviewer)).otherwise(F.col("reviewer")), "comment": F.when(hit, F.lit(comment)).otherwise(F.col("comment")), "status": F.when(hit, F.lit(status)).otherwise(F.col("status"))})


def memory(messages: DataFrame, n: int = 4, clip: int = 140) -> DataFrame:
    """The newest n turns of each conversation in order, as one text."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    last = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    line = F.concat(F.lit("("), "role", F.lit(") "), F.substring("content", 1, clip))
    lines = last.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("_l"))
    return lines.select("conversation_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("history"))


def give_feedback(messages: DataFrame, conversations: DataFrame, user_id: int, conversation_id: int, turn: int, value: str) -> DataFrame:
    """Feedback on a message of the user's own conversation."""
    if value not in ("useful", "not_useful", "review"):
        raise ValueError(value)
    mine = conversations.where(F.col("user_id") == user_id).select("conversation_id").withColumn("_mine", F.lit(True))
    hit = F.col("_mine") & (F.col("conversation_id") == conversation_id) & (F.col("turn") == turn)
    return messages.join(mine, "conversation_id", "left").withColumn("feedback", F.when(hit, F.lit(value)).otherwise(F.col("feedback"))).drop("_mine")


def normalised_terms(df: DataFrame, column: str) -> DataFrame:
    return df.select(column, text.normal_term(F.col(column)).alias("normal"), text.compact_term(F.col(column)).alias("compact"), text.fold(F.col(column)).alias("folded"))
