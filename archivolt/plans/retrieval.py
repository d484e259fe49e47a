"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import fixed, text
from archivolt.operators import retrieval as r
from archivolt.operators.terms import find_terms
from archivolt.plans.catalog import query

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
COS = f"{DOT.format(a='embedding', b='query_vector')} / (sqrt({DOT.format(a='embedding', b='embedding')}) * sqrt({DOT.format(a='query_vector', b='query_vector')}))"
STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(fixed.STOP_TERMS))
SHORT = ", ".join(f"'{w}'" for w in fixed.SHORT_TERMS)
TERMS = (
    "list_filter(string_split_regex(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), '\\s+'), lambda t: length(t) >= 2 AND t NOT IN ("
    + STOP + ") AND NOT (length(t) = 2 AND regexp_full_match(t, '\\p{{L}}+') AND t NOT IN (" + SHORT + ")))"
)
GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+'), lambda w: w <> ''), "
    "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
)
VECTOR_LEG = f"""v AS (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS rank
  FROM (SELECT query_id, chunk_id, {COS} AS similarity FROM vectors, qv) QUALIFY rank < {{k}})"""
LEXICAL_LEG = f"""g AS (SELECT query_id, query_text, {TERMS.format(c="lower(query_text)")} AS terms, {GRAMS.format(c="query_text")} AS qg FROM qs),
cg AS (SELECT chunk_id, lower(content) AS low, {GRAMS.format(c="content")} AS cg FROM @table),
l AS (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS rank FROM (
  SELECT query_id, chunk_id, len(list_intersect(cg, qg)) / CAST(len(cg) + len(qg) - len(list_intersect(cg, qg)) AS DOUBLE) AS similarity
  FROM cg, g WHERE len(list_filter(terms, lambda t: contains(low, t))) > 0) QUALIFY rank < @k)"""
FUSED = """f AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id, v.similarity AS cosine,
  coalesce(1.0 / CAST(61 + v.rank AS DOUBLE), 0) + coalesce(1.0 / CAST(61 + l.rank AS DOUBLE), 0) AS score
  FROM v FULL JOIN l ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id)"""
HYBRID = """m AS (SELECT f.*, content, list_filter(terms, lambda t: contains(lower(content), t)) AS met, terms FROM f JOIN vectors USING (chunk_id) JOIN g USING (query_id)),
h AS (SELECT query_id, chunk_id, score, met, content, CAST(floor(least(100.0, greatest(0.0, coalesce(cosine, 0)) * 60
  + least(40, 15 * len(met) + CASE WHEN len(met) > 0 AND len(met) = len(terms) THEN 12 ELSE 0 END))) AS INTEGER) AS relevance FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, chunk_id) - 1 AS rank FROM h WHERE relevance >= 12 QUALIFY rank < {k})"""


def _lexical(table: str, k: int) -> str:
    return LEXICAL_LEG.replace("@table", table).replace("@k", str(k))


def _hybrid_sql(k: int, order: str = "DESC") -> str:
    return ",\n".join(["", VECTOR_LEG.format(k=3 * k), _lexical("vectors", 3 * k), FUSED, HYBRID.format(order=order, k=k)])


@query(f", {VECTOR_LEG.format(k=10)}\nSELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM v", "vectors", "qv")
def cosine_topk(t):
    return r.vector_leg(t.vectors, t.query_vectors, 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f", vectors2 AS (SELECT * FROM vectors WHERE document_id % 3 = 0), {VECTOR_LEG.format(k=5).replace('FROM vectors', 'FROM vectors2')}\nSELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM v", "vectors", "qv")
def cosine_topk_by_doc_filter(t):
    return r.vector_leg(t.vectors.where("document_id % 3 = 0"), t.query_vectors, 5).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f", {VECTOR_LEG.format(k=10)}\nSELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM v", "vectors", "qv")
def vector_graph_topk(t):
    """The same hits by the stored graphs."""
    found = t.graph(t.query_vectors, 10)
    return found.select(F.col("query_id").cast("int").alias("query_id"), "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f", vectors2 AS (SELECT * FROM vectors WHERE document_id % 3 = 0), {VECTOR_LEG.format(k=5).replace('FROM vectors', 'FROM vectors2')}\nSELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM v", "vectors", "qv")
def vector_graph_by_doc_filter(t):
    found = t.graph(t.query_vectors, 5, t.vectors.where("document_id % 3 = 0"))
    return found.select(F.col("query_id").cast("int").alias("query_id"), "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f", {_lexical('chunks', 10)}\nSELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM l", "chunks", "qs")
def trigram_topk(t):
    return r.lexical_leg(t.chunks, t.queries, 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f", g AS (SELECT query_id, unnest({TERMS.format(c='lower(query_text)')}) AS term FROM qs)\nSELECT query_id, count(DISTINCT chunk_id) AS chunks FROM g JOIN chunks ON contains(lower(content), term) GROUP BY query_id", "chunks", "qs")
def keyword_or_match(t):
    q = t.queries.select("query_id", text.query_terms(F.lower("query_text")).alias("terms"))
    low = t.chunks.select("chunk_id", F.lower("content").alias("low"))
    found = find_terms(low, "low", q.select(F.col("query_id").alias("owner"), F.explode("terms").alias("term")))
    return found.select("chunk_id", F.explode(F.col("hits.owner").cast("array<int>")).alias("query_id")).distinct().groupBy("query_id").agg(F.count("*").alias("chunks"))


@query(", ".join(["", VECTOR_LEG.format(k=15), _lexical("vectors", 15), FUSED]) + "\nSELECT query_id, chunk_id, round(score, 8) AS score FROM f", "vectors", "qv")
def rrf_fusion(t):
    legs = r.vector_leg(t.vectors, t.query_vectors, 15), r.lexical_leg(t.vectors, t.queries, 15)
    return r.fuse(*legs).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query(_hybrid_sql(10) + "\nSELECT query_id, chunk_id, round(score, 8) AS score, relevance, array_to_string(met, ',') AS matched, CAST(rank AS INTEGER) AS rank FROM o", "vectors", "qv")
def hybrid_search(t):
    return r.hybrid(t.vectors, t.query_vectors, 10).select("query_id", "chunk_id", F.round("score", 8).alias("score"), "relevance", F.array_join("matched_terms", ",").alias("matched"), "rank")


@query(_hybrid_sql(10, "ASC") + "\nSELECT query_id, chunk_id, relevance, CAST(rank AS INTEGER) AS rank FROM o", "vectors", "qv")
def hybrid_search_asc_compat(t):
    return r.hybrid(t.vectors, t.query_vectors, 10, ascending=True).select("query_id", "chunk_id", "relevance", "rank")


@query(f"SELECT query_id, array_to_string({TERMS.format(c='query_text')}, ',') AS terms FROM asked", "asked")
def query_terms_filter(t):
    return t.asked.select("query_id", F.array_join(text.query_terms(F.col("query_text")), ",").alias("terms"))


EXPAND = """, x AS (SELECT query_id, edge_id, CASE WHEN contains(lower(query_text), lower(canonical)) THEN synonym WHEN contains(lower(query_text), lower(synonym)) THEN canonical END AS extra FROM asked, edges)
SELECT q.query_id, concat_ws(' ', query_text, e.extra) AS expanded FROM asked q LEFT JOIN (SELECT query_id, string_agg(extra, ' ' ORDER BY edge_id) AS extra FROM x WHERE extra IS NOT NULL GROUP BY query_id) e USING (query_id)"""


@query(EXPAND, "asked", "edges")
def synonym_expand_query(t):
    return r.expand_query(t.asked, t.edges).select("query_id", "expanded")


NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^\\w\\s]|_', ' ', 'g')), '\\s+', ' ', 'g'))"


@query(f""", fm AS (SELECT canonical, canonical AS form FROM edges UNION SELECT canonical, synonym FROM edges),
keyed AS (SELECT canonical, {NORM.format(c='form')} AS key FROM fm UNION SELECT canonical, replace({NORM.format(c='form')}, ' ', '') FROM fm),
asked AS (SELECT term, unnest([{NORM.format(c='term')}, replace({NORM.format(c='term')}, ' ', '')]) AS key FROM (SELECT DISTINCT upper(n_name) AS term FROM nation UNION SELECT DISTINCT p_name FROM part UNION SELECT unnest(['DNI', 'licence', 'Und', 'nada'])))
SELECT term, array_to_string(list_sort(list(DISTINCT {NORM.format(c='form')})), ',') AS forms FROM (SELECT DISTINCT term, canonical FROM asked JOIN keyed USING (key)) JOIN fm USING (canonical) GROUP BY term""", "edges")
def synonym_expand_term(t):
    more = t.spark.sql("SELECT * FROM VALUES ('DNI'), ('licence'), ('Und'), ('nada') AS t(term)")
    asked = t.raw("nation").select(F.upper("n_name").alias("term")).union(t.raw("part").select("p_name")).union(more).distinct()
    return r.expand_term(asked, t.edges).select("term", F.array_join("forms", ",").alias("forms"))


@query(f""", u AS (SELECT canonical, min(edge_id) AS edge_id, arg_min(synonym, edge_id) AS synonym FROM edges GROUP BY canonical, {NORM.format(c='synonym')})
SELECT canonical, c.category, string_agg(u.synonym, ',' ORDER BY u.edge_id) AS variants FROM u JOIN (SELECT canonical, arg_min(category, edge_id) AS category FROM edges GROUP BY canonical) c USING (canonical) GROUP BY canonical, c.category""", "edges")
def synonym_groups(t):
    return r.synonym_groups(t.edges).select("canonical", "category", F.array_join("variants", ",").alias("variants"))


@query(f""", fm AS (SELECT canonical, canonical AS form FROM edges UNION SELECT canonical, synonym FROM edges),
an AS (SELECT query_id, {NORM.format(c='query_text')} AS n FROM asked),
hit AS (SELECT DISTINCT query_id, n, canonical FROM an JOIN fm ON n = {NORM.format(c='form')} OR (length({NORM.format(c='form')}) >= 4 AND contains(n, {NORM.format(c='form')})))
SELECT query_id, canonical, form FROM hit JOIN fm USING (canonical) WHERE {NORM.format(c='form')} <> n""", "asked", "edges")
def synonym_expand_groups(t):
    return r.expand_by_groups(t.asked, t.edges)


@query("SELECT document_id, count(*) AS chunks FROM chunks c WHERE visibility <> 'restricted' OR document_id IN (SELECT document_id FROM acl WHERE role = 'viewer') GROUP BY document_id", "chunks", "acl")
def acl_visible_chunks(t):
    return r.visible(t.chunks, t.acl, "viewer").groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("SELECT chunk_id, chunk_index FROM chunks WHERE page = 2", "chunks")
def search_page_filter(t):
    return r.on_page(t.chunks, 2).select("chunk_id", "chunk_index")


@query("SELECT chunk_id, edad FROM chunks WHERE edad BETWEEN 18 AND 65", "chunks")
def search_age_filter(t):
    return r.in_age_range(t.chunks, 18, 65).select("chunk_id", "edad")


@query("SELECT chunk_id, document_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM ck JOIN keywords USING (keyword_id) WHERE category = 'verbs')", "chunks", "ck")
def search_domain_filter(t):
    return r.in_domain(t.chunks, t.chunk_keywords, t.keywords, "verbs").select("chunk_id", "document_id")


EVIDENCE = _hybrid_sql(15) + """, s AS (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN round(1 / (1 + exp(-(relevance / 10.0 - 4))), 4) END AS rr FROM o),
e AS (SELECT *, coalesce(rr, score * 10) AS evidence FROM s)"""


def _scored(t):
    hits = r.hybrid(t.vectors, t.query_vectors, 15)
    logit = F.when(F.col("chunk_id") % 2 == 0, F.col("relevance") / F.lit(10.0) - 4)
    return hits.withColumn("rerank_score", r.sigmoid(logit))


@query(EVIDENCE + "\nSELECT query_id, chunk_id, round(evidence, 6) AS evidence FROM e WHERE evidence >= 0.15", "vectors", "qv")
def evidence_threshold(t):
    return r.evidence(_scored(t)).select("query_id", "chunk_id", F.round("evidence", 6).alias("evidence"))


@query(EVIDENCE + "\nSELECT q.query_id, count(e.chunk_id) AS sources, count(e.chunk_id) < 1 AS abstained FROM qs q LEFT JOIN e ON e.query_id = q.query_id AND e.evidence >= 0.9 GROUP BY q.query_id", "vectors", "qv")
def evidence_abstention(t):
    return r.abstentions(t.queries, r.evidence(_scored(t), 0.9))


@query(_hybrid_sql(15) + """, s AS (SELECT query_id, chunk_id, rank AS prior_rank, round(1 / (1 + exp(-(relevance / 10.0 - 4))), 4) AS rerank_score FROM o)
SELECT query_id, chunk_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior_rank) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 10""", "vectors", "qv")
def rerank_sigmoid(t):
    hits = r.hybrid(t.vectors, t.query_vectors, 15).withColumn("logit", F.col("relevance") / F.lit(10.0) - 4)
    return r.rerank(hits, "logit", 10).select("query_id", "chunk_id", "rerank_score", "rank")


@query(""", p AS (SELECT chunk_id, content, list_min(list_filter(list_transform(['license', 'The', 'que'], lambda t: instr(lower(content), lower(t))), lambda p: p > 0)) AS pos FROM chunks),
q AS (SELECT *, greatest(1, pos - 120) AS a, least(length(content), pos - 1 + 120) AS b FROM p)
SELECT chunk_id, CASE WHEN pos IS NULL THEN substring(content, 1, 240) ELSE (CASE WHEN a > 1 THEN '...' ELSE '' END) || substring(content, a, b - a + 1) || (CASE WHEN b < length(content) THEN '...' ELSE '' END) END AS snippet FROM q""", "chunks")
def snippet(t):
    terms = F.array(*map(F.lit, ("license", "The", "que")))
    return t.chunks.select("chunk_id", text.snippet(F.col("content"), terms).alias("snippet"))


PACK = _hybrid_sql(10) + """, b AS (SELECT query_id, rank, '[' || (rank + 1) || '] Documento: ' || original_name || ' | Paginas: [' || 1 || ']' || CASE WHEN o.chunk_id % 3 = 0 THEN ' | Edad: ' || (o.chunk_id % 100) || ' anios' ELSE '' END || chr(10) || content AS block
  FROM o JOIN docs ON docs.document_id = o.chunk_id),
c AS (SELECT *, CAST(floor(length(block) / 2.2) AS INTEGER) AS tokens FROM b), d AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM c),
p AS (SELECT query_id, rank, CASE WHEN total <= 1333 THEN block WHEN total - tokens <= 1333 AND 1333 - (total - tokens) > 30 THEN substring(block, 1, CAST(floor((1333 - (total - tokens)) * 2.2) AS INTEGER)) || '...' END AS part FROM d)
SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS context FROM p WHERE part IS NOT NULL GROUP BY query_id"""


@query(PACK, "vectors", "qv")
def context_pack(t):
    hits = r.hybrid(t.vectors, t.query_vectors, 10)
    named = hits.join(t.documents.select(F.col("document_id").alias("chunk_id"), F.col("original_name").alias("document_name")), "chunk_id")
    ready = named.withColumns({"page_numbers": F.array(F.lit(1)), "edad": F.when(F.col("chunk_id") % 3 == 0, F.col("chunk_id") % 100)})
    return r.pack_context(ready)


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)))), ',') AS cited,
len(regexp_extract_all(a, '\\[(\\d+)\\]', 1)) > 0 AND len(list_filter(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER) < 1 OR CAST(x AS INTEGER) > 2)) = 0 AS grounded
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN text || ' [1] [2][1]' ELSE text || ' [3]' END AS a FROM conversations)""")
def grounding_flags(t):
    a = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" [1] [2][1]"))).otherwise(F.concat("text", F.lit(" [3]")))
    c = t.raw("conversations").select("conv_id", "turn", a.alias("a"))
    return c.select("conv_id", "turn", F.array_join(F.transform(text.citations(F.col("a")), lambda x: x.cast("string")), ",").alias("cited"), text.is_grounded(F.col("a"), F.lit(2)).alias("grounded"))


@query()
def fulltext_topk(t):
    """Stemmed prefix matches by trigram similarity and cover density; no SQL engine here has that stemmer."""
    from archivolt.operators import fts

    return fts.text_leg(t.chunks, t.queries, 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.round("density", 6).alias("density"), "rank")


@query("SELECT id, CAST(floor(least(100.0, greatest(0.0, coalesce(c, 0)) * 60 + least(40, 15 * h + CASE WHEN h > 0 AND h = n THEN 12 ELSE 0 END))) AS INTEGER) AS relevance FROM (SELECT doc_id AS id, (doc_id % 13 - 2) / 10.0 AS c, doc_id % 4 AS h, doc_id % 3 + 1 AS n FROM documents)")
def relevance_bonus(t):
    d = F.col("doc_id")
    return t.raw("documents").select(d.alias("id"), r.relevance((d % 13 - 2) / 10.0, d % 4, d % 3 + 1).alias("relevance"))


@query(f"SELECT a.vec_id AS vec_id, round({DOT.format(a='a.embedding', b='b.embedding')}, 6) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.embedding IS NOT NULL")
def vector_products(t):
    from archivolt.functions import vector

    e = t.raw("embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("b")), 6).alias("product"))


@query(", ".join(["", VECTOR_LEG.format(k=15), _lexical("vectors", 15), FUSED]) + "\nSELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS INTEGER) AS rank FROM f QUALIFY rank < 10", "vectors", "qv")
def rrf_fusion_asc_compat(t):
    legs = r.vector_leg(t.vectors, t.query_vectors, 15), r.lexical_leg(t.vectors, t.queries, 15)
    return r.top(r.fuse(*legs), 10, F.asc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "rank")
