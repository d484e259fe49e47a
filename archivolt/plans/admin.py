"""Queries on the audit log, listings, imports and deletions, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import fixed, variant
from archivolt.operators import lifecycle as l
from archivolt.plans.catalog import query


@query("SELECT audit_id, username, action FROM audit WHERE action = 'query' AND username = 'user7' ORDER BY created_at DESC, audit_id LIMIT 5 OFFSET 5", "audit")
def audit_filter_page(t):
    rows = t.audit.where("action = 'query' and username = 'user7'")
    return l.page_of(rows, 2, 5, F.desc("created_at"), F.asc("audit_id")).select("audit_id", "username", "action")


@query("SELECT action, count(*) AS n FROM audit WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-12 12:00:00' GROUP BY action", "audit")
def audit_time_range(t):
    at = F.col("created_at")
    return t.audit.where((at >= F.lit("2024-01-10").cast("timestamp")) & (at <= F.lit("2024-01-12 12:00:00").cast("timestamp"))).groupBy("action").agg(F.count("*").alias("n"))


KNOWN = ", ".join(f"'{a}'" for a in fixed.AUDIT_ACTIONS)


@query(f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN audit_id % 9 = 0 THEN 'other' ELSE action END AS action FROM audit) WHERE action IN ({KNOWN}) GROUP BY action", "audit")
def audit_append(t):
    rows = t.audit.withColumn("action", F.when(F.col("audit_id") % 9 == 0, "other").otherwise(F.col("action")))
    return l.append_audit(rows).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT audit_id, username, n_sources FROM audit WHERE action = 'query' ORDER BY created_at DESC, audit_id DESC LIMIT 100", "audit")
def history_export(t):
    return t.audit.where("action = 'query'").orderBy(F.desc("created_at"), F.desc("audit_id")).limit(100).select("audit_id", "username", "n_sources")


@query("SELECT document_id, original_name, status FROM docs WHERE status = 'completed' ORDER BY document_id DESC LIMIT 20 OFFSET 20", "docs")
def documents_page(t):
    return l.page_of(t.documents.where("status = 'completed'"), 2, 20, F.desc("document_id")).select("document_id", "original_name", "status")


@query("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM docs WHERE visibility = 'restricted'", "docs")
def documents_page_count(t):
    return l.page_count(t.documents.where("visibility = 'restricted'"), 20)


@query("SELECT document_id, original_name FROM docs WHERE original_name ILIKE '%SRC1%'", "docs")
def documents_ilike(t):
    return t.documents.where(F.col("original_name").ilike("%SRC1%")).select("document_id", "original_name")


@query("SELECT min(document_id) AS file_id, sha256(text) AS file_hash FROM docs GROUP BY text", "docs")
def dedupe_by_hash(t):
    files = t.documents.select(F.col("document_id").alias("file_id"), F.col("text").alias("content"))
    return l.dedupe_by_hash(files).select("file_id", "file_hash")


@query("SELECT term, category FROM catalogue WHERE keyword_id % 2 = 1", "catalogue")
def import_anti_join(t):
    names = t.catalogue.select(F.concat(F.lit(" "), "term", F.lit(" ")).alias("term"), "category")
    header = t.spark.sql("SELECT * FROM VALUES ('Term', 'category'), ('', 'x'), (NULL, 'y') AS t(term, category)")
    return l.import_keywords(t.catalogue.where("keyword_id % 2 = 0"), names.union(header)).select("term", "category")


@query("SELECT 'documents' AS name, count(*) AS n FROM docs WHERE NOT (document_id % 5 = 0 AND status <> 'processing') UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE NOT (document_id % 5 = 0 AND status <> 'processing')) UNION ALL SELECT 'chunk_keywords', count(*) FROM ck WHERE document_id IN (SELECT document_id FROM docs WHERE NOT (document_id % 5 = 0 AND status <> 'processing'))", "docs", "chunks", "ck")
def delete_cascade(t):
    tables = {"documents": t.documents, "chunks": t.chunks, "chunk_keywords": t.chunk_keywords}
    left = l.delete_documents(tables, t.documents.where("document_id % 5 = 0").select("document_id"))
    out = None
    for name in tables:
        n = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT chunk_id, content FROM (SELECT chunk_id, CASE WHEN document_id = 3 AND page = 1 AND instr(content, 'de') > 0 THEN substring(content, 1, instr(content, 'de') - 1) || 'DE!' || substring(content, instr(content, 'de') + 2) ELSE content END AS content FROM chunks)", "chunks")
def word_correction(t):
    return l.correct_word(t.chunks, 3, 1, "de", "DE!").select("chunk_id", "content")


@query("SELECT chunk_id, document_id, 'old' AS version FROM chunks WHERE document_id % 3 <> 0 UNION ALL SELECT document_id, document_id, 'new' FROM docs WHERE document_id % 3 = 0", "chunks", "docs")
def replace_by_document(t):
    old = t.chunks.select("chunk_id", "document_id", F.lit("old").alias("version"))
    new = t.documents.where("document_id % 3 = 0").select(F.col("document_id").alias("chunk_id"), "document_id", F.lit("new").alias("version"))
    return l.replace_by_document(old, new)


@query("""SELECT permission, roles, (SELECT count(DISTINCT user_id) FROM events WHERE list_contains(string_split(roles, ','), ['admin', 'editor', 'assistant', 'viewer', 'auditor'][user_id % 5 + 1])) AS users FROM (VALUES
('users:create', 'admin'), ('documents:delete', 'admin,editor'), ('documents:upload', 'admin,assistant,editor'), ('audit:read', 'admin,auditor'), ('keywords:write', 'admin,editor'),
('export', 'admin,assistant,editor'), ('bsc:read', 'admin'), ('chat:write', 'admin,assistant,auditor,editor,viewer'), ('admin:panel', 'admin'), ('search', 'admin,assistant,auditor,editor,viewer')) AS v(permission, roles)""")
def role_permissions(t):
    """For some permissions the roles that hold them, and how many users have such a role."""
    held = t.spark.createDataFrame([(r, p) for r, ps in fixed.PERMISSIONS.items() for p in ps], "role string, permission string")
    asked = held.where(F.col("permission").isin("users:create", "documents:delete", "documents:upload", "audit:read", "keywords:write", "export", "bsc:read", "chat:write", "admin:panel", "search"))
    roles = F.array(*map(F.lit, ("admin", "editor", "assistant", "viewer", "auditor")))
    users = t.raw("events").select("user_id", F.element_at(roles, (F.col("user_id") % 5 + 1).cast("int")).alias("role")).distinct()
    n = asked.join(F.broadcast(asked.select("role").distinct()), "role").join(users.groupBy("role").agg(F.count("*").alias("n")), "role", "left")
    return n.groupBy("permission").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.coalesce(F.sum("n"), F.lit(0)).alias("users"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def extra_hourly_windows(t):
    """Not a parity feature: event-time windows over the events."""
    return t.raw("events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path_projection(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.raw("events").select("event_id", k.alias("k")).where("k is not null")


@query("""SELECT event_id, CAST(json_extract_string(p, '$.k') AS INTEGER) AS k, json_extract_string(p, '$.of.user') AS user_text, CAST(json_array_length(p, '$.tags') AS INTEGER) AS tags, CAST(NULL AS INTEGER) AS none,
'{"of":' || json_extract_string(p, '$.of') || ',"tags":' || json_extract_string(p, '$.tags') || '}' AS light FROM (
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN '{"of":{"user":' || user_id || '},"tags":[' || repeat('1,', CAST(event_id % 3 AS INTEGER)) || '0],' || substr(props, 2) END AS p FROM events)""")
def variant_paths(t):
    """Typed paths of the events' properties as VARIANT, and what is left without a key; text that is no JSON is null."""
    user, ones = F.col("user_id").cast("string"), F.expr("repeat('1,', CAST(event_id % 3 AS INT))")
    whole = F.concat(F.lit('{"of":{"user":'), user, F.lit('},"tags":['), ones, F.lit("0],"), F.expr("substr(props, 2)"))
    v = t.raw("events").withColumn("v", variant.parsed(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(whole)))
    return v.select(
        "event_id", variant.path("v", "$.k", "int").alias("k"), variant.path("v", "$.of.user", "string").alias("user_text"),
        F.array_size(variant.path("v", "$.tags", "array<int>")).alias("tags"), variant.path("v", "$.of", "int").alias("none"), variant.light("v", "k").alias("light"),
    )


@query("SELECT keyword_id, term, CASE WHEN term = 'was' THEN true WHEN term = 'the' THEN false ELSE is_active END AS is_active, CASE WHEN keyword_id = 3 THEN 'words' ELSE category END AS category FROM catalogue UNION ALL SELECT (SELECT max(keyword_id) + 1 FROM catalogue), 'fresh', true, 'legal'", "catalogue")
def keyword_upsert(t):
    k = t.catalogue.withColumn("category", F.col("category").cast("string"))
    k = l.upsert_keyword(l.upsert_keyword(k, "was", None), "fresh", "legal")
    return l.patch_keyword(l.delete_keyword(k, 1), 3, domain="words").select("keyword_id", "term", "is_active", "category")


@query("SELECT canonical, synonym FROM edges WHERE canonical <> 'license' UNION ALL SELECT 'license', unnest(['license', 'permit', 'Grant'])", "edges")
def synonym_upsert(t):
    return l.replace_synonyms(t.edges, "license", ["permit ", "PERMIT", "Grant", ""], "legal").select("canonical", "synonym")


@query("SELECT DISTINCT p_brand AS canonical, p_name AS synonym FROM part UNION SELECT DISTINCT p_name, p_brand FROM part")
def synonym_seed_edges(t):
    """A group for each brand: its names, and the brand itself among them."""
    names = F.sort_array(F.collect_list("p_name"))
    groups = t.raw("part").groupBy(F.col("p_brand").alias("canonical")).agg(F.min("p_partkey").alias("group_id"), F.concat(F.array(F.first("p_brand")), names).alias("forms"), F.min("p_type").alias("category"))
    return l.seed_edges(groups).select("canonical", "synonym")


@query("SELECT keyword_id, term FROM catalogue WHERE keyword_id % 5 = 0", "catalogue")
def seed_missing(t):
    return l.seed_missing(t.catalogue.where("keyword_id % 5 <> 0"), t.catalogue, "term").select("keyword_id", "term")


@query("SELECT 'conversations' AS name, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 10 <> 3 UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id % 10 <> 3 UNION ALL SELECT 'keywords', count(*) FILTER (WHERE keyword_id % 2 = 0) FROM keywords UNION ALL SELECT 'proposals', count(*) FROM docs WHERE document_id % 10 = 3 OR document_id % 10 = 0", "keywords", "docs")
def user_delete_cascade(t):
    """Rows that are left, keywords that keep an author, proposals that are the admin's."""
    m = t.messages
    tables = {
        "users": t.spark.range(10).select(F.col("id").alias("user_id")),
        "messages": m.select("conversation_id", "turn"),
        "conversations": m.select("conversation_id", (F.col("conversation_id") % 10).alias("user_id")).distinct(),
        "keywords": t.keywords.withColumn("created_by", F.when(F.col("keyword_id") % 2 == 0, F.lit(1)).otherwise(3)),
        "proposals": t.documents.select(F.col("document_id").alias("chunk_id"), (F.col("document_id") % 10).alias("proposer"), F.lit(3).alias("reviewer")),
    }
    left = l.delete_user(tables, 3, 0)
    kept = {"conversations": left["conversations"], "messages": left["messages"], "keywords": left["keywords"].where("created_by is not null"), "proposals": left["proposals"].where("proposer = 0 and reviewer is null")}
    out = None
    for name, df in kept.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT document_id, CASE WHEN document_id % 2 = 0 THEN '45' ELSE '30' END AS edad, document_id % 2 = 0 AS manual FROM docs", "docs")
def patient_patch(t):
    d = t.documents.select("document_id", *[F.lit(v).alias(c) for c, v in {"nombre": "Ana Rojas", "edad": "30", "sexo": "F", "dni": "12345678", "historia_clinica": "HC-100", "fecha_atencion": "01/02/2024"}.items()], F.lit(False).alias("manual"))
    patch = t.documents.where("document_id % 2 = 0").select("document_id", F.lit("45 anios").alias("edad"), *[F.lit(None).cast("string").alias(c) for c in ("nombre", "sexo", "dni", "historia_clinica", "fecha_atencion")])
    return l.patch_patient(d, patch).select("document_id", "edad", "manual")


@query("SELECT chunk_id, CASE WHEN chunk_id = 8 AND status = 'proposed' THEN 'approved' ELSE status END AS status, CASE WHEN chunk_id = 8 AND status = 'proposed' THEN 'ok' END AS comment FROM (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'proposed' END AS status FROM documents)")
def proposal_review(t):
    p = t.raw("documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, "rejected").otherwise("proposed").alias("status"), F.lit(None).cast("int").alias("reviewer"), F.lit(None).cast("string").alias("comment"))
    return l.review(l.review(p, 8, "approved", 1, "ok"), 9, "approved", 1, "late").select("chunk_id", "status", "comment")


@query("SELECT conversation_id, turn, CASE WHEN conversation_id = 1 AND turn = 1 THEN 'useful' ELSE feedback END AS feedback FROM messages", "messages")
def message_feedback(t):
    own = t.messages.select("conversation_id").distinct().withColumn("user_id", F.lit(5))
    return l.give_feedback(t.messages, own, 5, 1, 1, "useful").select("conversation_id", "turn", "feedback")
