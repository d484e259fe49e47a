"""Queries on the keyword catalogue and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import fixed
from archivolt.operators import knowledge as k
from archivolt.plans.catalog import query

STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(fixed.STOP_CANDIDATES))
WORDS = f"unnest(regexp_extract_all(lower(content), '{fixed.WORD_PATTERN}'))"
PCT = "CASE WHEN {b} = 0 THEN 100.0 ELSE round({a} * 100.0 / {b}, 2) END"
COVER = f"""SELECT count(*) AS total, count(f.keyword_id) AS found, CAST({PCT.format(a='count(f.keyword_id)', b='count(*)')} AS DOUBLE) AS coverage,
CAST({PCT.format(a='coalesce(sum(CASE WHEN f.keyword_id IS NOT NULL THEN priority END), 0)', b='coalesce(sum(priority), 0)')} AS DOUBLE) AS weighted_coverage
FROM keywords k LEFT JOIN (SELECT DISTINCT keyword_id FROM ck) f ON f.keyword_id = k.keyword_id WHERE is_active"""


@query("SELECT chunk_id, keyword_id, match_count FROM ck", "ck")
def chunk_keyword_counts(t):
    """The tagging itself; other queries read its stored result."""
    return k.match_keywords(t.chunks, t.keywords)


@query(COVER, "ck")
def coverage(t):
    return k.coverage(t.keywords, t.chunk_keywords)


@query("SELECT keyword_id, term, coalesce(category, 'Sin dominio') AS domain, priority FROM keywords WHERE is_active AND keyword_id NOT IN (SELECT keyword_id FROM ck)", "ck")
def keyword_gaps(t):
    return k.gaps(t.keywords, t.chunk_keywords)


@query("SELECT coalesce(category, 'Sin dominio') AS domain, string_agg(term, ',' ORDER BY term) AS terms, count(*) AS n FROM keywords WHERE is_active AND keyword_id NOT IN (SELECT keyword_id FROM ck) GROUP BY 1", "ck")
def gaps_by_domain(t):
    return k.gaps_by_domain(t.keywords, t.chunk_keywords)


@query("SELECT term, coalesce(category, 'Sin dominio') AS domain, CAST(sum(match_count) AS BIGINT) AS matches FROM ck JOIN keywords USING (keyword_id) WHERE is_active GROUP BY term, category", "ck")
def keyword_match_counts(t):
    return k.match_counts(t.keywords, t.chunk_keywords)


@query("SELECT original_name, term, CAST(sum(match_count) AS BIGINT) AS matches FROM ck JOIN keywords USING (keyword_id) JOIN docs USING (document_id) WHERE is_active GROUP BY original_name, term", "ck", "docs")
def doc_term_heatmap(t):
    return k.heatmap(t.keywords, t.chunk_keywords, t.chunks, t.documents)


@query("SELECT original_name, term, CAST(sum(match_count) AS BIGINT) AS matches FROM ck JOIN keywords USING (keyword_id) JOIN docs USING (document_id) WHERE is_active AND category = 'legal' GROUP BY original_name, term", "ck", "docs")
def doc_term_heatmap_by_domain(t):
    return k.heatmap(t.keywords, t.chunk_keywords, t.chunks, t.documents, "legal")


SUB = "(SELECT DISTINCT lower(synonym) AS term FROM synonyms)"


@query(f"SELECT count(*) AS total, count(f) AS found, CAST(CASE WHEN count(*) = 0 THEN 100.0 ELSE round(count(f) * 100.0 / count(*), 2) END AS DOUBLE) AS coverage FROM (SELECT term, (SELECT 1 FROM chunks WHERE contains(lower(content), term) LIMIT 1) AS f FROM {SUB})", "chunks", "synonyms")
def coverage_substring(t):
    return k.substring_coverage(t.synonyms.select(F.col("synonym").alias("term")), t.chunks)


@query(f"SELECT original_name, term, CAST(sum(n) AS BIGINT) AS matches FROM (SELECT document_id, term, (length(c) - length(replace(c, term, ''))) // length(term) AS n FROM (SELECT document_id, lower(content) AS c FROM chunks), {SUB}) JOIN docs USING (document_id) WHERE n > 0 GROUP BY original_name, term", "chunks", "synonyms")
def heatmap_substring(t):
    return k.substring_heatmap(t.synonyms.select(F.col("synonym").alias("term")), t.chunks, t.documents)


@query("SELECT document_id, string_agg(category, ',' ORDER BY category) AS domains FROM (SELECT DISTINCT document_id, category FROM ck JOIN keywords USING (keyword_id) WHERE category IS NOT NULL) GROUP BY document_id", "ck")
def document_domains(t):
    return k.document_domains(t.keywords, t.chunk_keywords, t.chunks)


@query("SELECT chunk_id, string_agg(category, ',' ORDER BY category) AS domains FROM (SELECT DISTINCT chunk_id, category FROM ck JOIN keywords USING (keyword_id) WHERE category IS NOT NULL) GROUP BY chunk_id", "ck")
def chunk_domains(t):
    return k.chunk_domains(t.keywords, t.chunk_keywords)


@query("SELECT category, CAST(sum(match_count) AS BIGINT) AS matches, count(DISTINCT chunk_id) AS chunks FROM ck JOIN keywords USING (keyword_id) WHERE category IS NOT NULL GROUP BY category", "ck")
def corpus_domains(t):
    return k.corpus_domains(t.keywords, t.chunk_keywords)


@query("SELECT category, count(*) AS terms FROM catalogue WHERE is_active AND category IS NOT NULL GROUP BY category", "catalogue")
def catalogue_domains(t):
    return k.catalogue_domains(t.catalogue)


KNOWN = "(SELECT lower(term) FROM keywords UNION SELECT lower(canonical) FROM synonyms UNION SELECT lower(synonym) FROM synonyms)"


def _known(t):
    s = t.synonyms
    return t.keywords.select("term").union(s.select("canonical")).union(s.select("synonym"))


@query(f"SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT {WORDS} AS term FROM chunks) GROUP BY term ORDER BY n DESC, term LIMIT 50) WHERE term NOT IN {KNOWN} ORDER BY n DESC, term LIMIT 10", "chunks", "keywords", "synonyms")
def emerging_terms(t):
    return k.emerging_terms(t.chunks, _known(t))


CAND = f"""SELECT document_id, term, n FROM (SELECT document_id, term, count(*) AS n FROM (SELECT document_id, {WORDS} AS term FROM chunks) WHERE term NOT IN ({STOP}) AND term NOT IN {KNOWN} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, term) <= 10 AND n >= 2"""


@query(CAND, "chunks", "keywords", "synonyms")
def candidate_terms_per_doc(t):
    return k.candidates(t.chunks, _known(t))


@query(f""", cand AS ({CAND}), new AS (SELECT term, sum(n) AS n, min(original_name) AS sample FROM cand JOIN docs USING (document_id) GROUP BY term),
old AS (SELECT * FROM (VALUES ('tion', 5, 'a', 'proposed'), ('this', 7, 'b', 'rejected'), ('zzzz', 1, 'c', 'proposed')) AS t(term, count, sample_document, status))
SELECT coalesce(old.term, new.term) AS term, CAST(coalesce(count + CASE WHEN status = 'proposed' THEN coalesce(n, 0) ELSE 0 END, n) AS BIGINT) AS count, coalesce(sample_document, sample) AS sample_document, coalesce(status, 'proposed') AS status FROM old FULL JOIN new ON old.term = new.term""", "chunks", "keywords", "synonyms", "docs")
def candidate_upsert(t):
    old = t.spark.sql("SELECT * FROM VALUES ('tion', 5, 'a', 'proposed'), ('this', 7, 'b', 'rejected'), ('zzzz', 1, 'c', 'proposed') AS t(term, count, sample_document, status)")
    names = t.documents.select("document_id", F.col("original_name").alias("sample_document"))
    new = k.candidates(t.chunks, _known(t)).join(names, "document_id")
    return k.accumulate_candidates(old, new)


@query("SELECT original_name, chunk_id, CAST(page AS VARCHAR) AS pages, CASE WHEN length(content) <= 240 THEN content ELSE substring(content, 1, 237) || '...' END AS fragment, match_count FROM ck JOIN keywords USING (keyword_id) JOIN chunks USING (chunk_id) JOIN docs ON docs.document_id = chunks.document_id WHERE lower(term) = 'license' AND is_active", "ck", "docs")
def keyword_exact_search(t):
    return k.search_keyword("License", t.keywords, t.chunk_keywords, t.chunks, t.documents).drop("section")


@query(f"SELECT coverage, weighted_coverage FROM ({COVER.replace('FROM keywords k', 'FROM (SELECT * FROM keywords WHERE keyword_id <> 1) k')})", "ck")
def coverage_weighted(t):
    return k.coverage(t.keywords.where("keyword_id <> 1"), t.chunk_keywords).select("coverage", "weighted_coverage")
