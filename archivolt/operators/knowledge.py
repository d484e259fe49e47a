"""Keyword catalogue and what the corpus knows about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import fixed, text
from archivolt.operators.sizes import meet
from archivolt.operators.terms import find_terms

NO_DOMAIN = "Sin dominio"


def match_keywords(chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """(chunk_id, keyword_id, match_count) for keywords between word boundaries.

    Chunks meet the catalogue by hash: every word of a folded chunk joins the
    terms whose longest word it is. For a term of one word the hits are its
    count; other terms are counted by pattern in the chunks they may occur in.
    Terms without any word are compared with every chunk.
    """
    norm = text.fold(F.col("term"))
    words = F.regexp_extract_all("norm", F.lit(r"\w+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    terms = keywords.select("keyword_id", norm.alias("norm")).where("norm <> ''").withColumn("word", longest)
    folded = chunks.select("chunk_id", text.fold(F.col("content")).alias("_f"))
    each = folded.select("chunk_id", F.explode(F.regexp_extract_all("_f", F.lit(r"\w+"), F.lit(0))).alias("word"))
    hits = each.join(terms, "word").groupBy("chunk_id", "keyword_id", "norm", (F.col("word") == F.col("norm")).alias("whole")).agg(F.count("*").alias("match_count"))
    exact = hits.where("whole").select("chunk_id", "keyword_id", "match_count")
    counted = text.word_count_of(F.col("_f"), F.col("norm")).cast("long")
    parts = hits.where("not whole").select("chunk_id", "keyword_id", "norm").join(folded, "chunk_id").select("chunk_id", "keyword_id", counted.alias("match_count"))
    rest = meet(folded, terms.where("word is null")).select("chunk_id", "keyword_id", counted.alias("match_count"))
    return exact.unionByName(parts.unionByName(rest).where("match_count > 0"))


def coverage(keywords: DataFrame, chunk_keywords: DataFrame) -> DataFrame:
    """Active keywords with evidence in percent, plain and weighted by priority; 100 for none."""
    found = chunk_keywords.select("keyword_id").distinct().withColumn("_found", F.lit(1))
    k = keywords.where("is_active").join(found, "keyword_id", "left")
    sums = k.agg(
        F.count("*").alias("total"), F.count("_found").alias("found"),
        F.coalesce(F.sum("priority"), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(F.col("_found") == 1, F.col("priority"))), F.lit(0)).alias("found_weight"),
    )
    pct = lambda a, b: F.when(F.col(b) == 0, 100.0).otherwise(F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 2))
    return sums.select("total", "found", pct("found", "total").alias("coverage"), pct("found_weight", "weight").alias("weighted_coverage"))


def substring_coverage(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct terms found anywhere in the corpus, whatever their case, in percent."""
    t = terms.select(F.lower("term").alias("term")).distinct()
    low = chunks.select(F.lower("content").alias("_c"))
    hits = find_terms(low, "_c", t.select(F.xxhash64("term").alias("owner"), "term")).select(F.explode("hits.owner").alias("owner")).distinct()
    found = t.join(hits, F.xxhash64("term") == F.col("owner"), "left_semi").withColumn("_found", F.lit(1))
    sums = t.join(found, "term", "left").agg(F.count("*").alias("total"), F.count("_found").alias("found"))
    return sums.select("total", "found", F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.try_divide(F.col("found") * 100.0, F.col("total")), 2)).alias("coverage"))


def gaps(keywords: DataFrame, chunk_keywords: DataFrame) -> DataFrame:
    """Active keywords without evidence."""
    return keywords.where("is_active").join(chunk_keywords, "keyword_id", "left_anti").select("keyword_id", "term", F.coalesce("category", F.lit(NO_DOMAIN)).alias("domain"), "priority")


def gaps_by_domain(keywords: DataFrame, chunk_keywords: DataFrame) -> DataFrame:
    return gaps(keywords, chunk_keywords).groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("terms"), F.count("*").alias("n"))


def match_counts(keywords: DataFrame, chunk_keywords: DataFrame) -> DataFrame:
    """Matches per active term and category, most first."""
    k = keywords.where("is_active").select("keyword_id", "term", "category")
    n = chunk_keywords.groupBy("keyword_id").agg(F.sum("match_count").alias("n"))
    return n.join(k, "keyword_id").groupBy("term", "category").agg(F.sum("n").alias("matches")).select("term", F.coalesce("category", F.lit(NO_DOMAIN)).alias("domain"), "matches")


def heatmap(keywords: DataFrame, chunk_keywords: DataFrame, chunks: DataFrame, documents: DataFrame, domain: str | None = None) -> DataFrame:
    """Matches per document and term, in long form; sums are made before names are joined."""
    k = keywords.where("is_active")
    if domain is not None:
        k = k.where(F.col("category") == domain)
    n = chunk_keywords.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("document_id", "keyword_id").agg(F.sum("match_count").alias("n"))
    named = n.join(k.select("keyword_id", "term"), "keyword_id").join(documents.select("document_id", "original_name"), "document_id")
    return named.groupBy("original_name", "term").agg(F.sum("n").alias("matches"))


def substring_heatmap(terms: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Non-overlapping substring counts per document and term."""
    t = terms.select(F.lower("term").alias("term")).distinct()
    known = t.withColumn("owner", F.xxhash64("term"))
    n = find_terms(chunks.select("document_id", F.lower("content").alias("_c")), "_c", known).select("document_id", F.explode("hits").alias("h"))
    sums = n.groupBy("document_id", F.col("h.owner").alias("owner")).agg(F.sum("h.n").alias("matches")).join(known, "owner").select("document_id", "term", "matches")
    names = documents.select("document_id", "original_name")
    return sums.join(names, "document_id", "left").select(F.coalesce("original_name", F.lit("sin_documento")).alias("original_name"), "term", "matches")


def document_domains(keywords: DataFrame, chunk_keywords: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sorted distinct categories of the keywords met in each document."""
    pairs = chunk_keywords.join(keywords.where("category is not null").select("keyword_id", "category"), "keyword_id")
    return pairs.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id", "category").distinct().groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list("category")), ",").alias("domains"))


def chunk_domains(keywords: DataFrame, chunk_keywords: DataFrame) -> DataFrame:
    pairs = chunk_keywords.join(keywords.where("category is not null").select("keyword_id", "category"), "keyword_id")
    return pairs.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("domains"))


def corpus_domains(keywords: DataFrame, chunk_keywords: DataFrame) -> DataFrame:
    """Categories with evidence and the number of chunks and matches behind them."""
    pairs = chunk_keywords.join(keywords.where("category is not null").select("keyword_id", "category"), "keyword_id")
    return pairs.groupBy("category").agg(F.sum("match_count").alias("matches"), F.countDistinct("chunk_id").alias("chunks"))


def catalogue_domains(keywords: DataFrame) -> DataFrame:
    return keywords.where("is_active and category is not null").groupBy("category").agg(F.count("*").alias("terms"))


def words(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.select(*keys, F.explode(F.regexp_extract_all(F.lower("content"), F.lit(fixed.WORD_PATTERN), F.lit(0))).alias("term"))


def emerging_terms(chunks: DataFrame, known: DataFrame, pool: int = 50, k: int = 10) -> DataFrame:
    """Frequent words not yet in the catalogue: of the pool most frequent, the first k unknown ones."""
    counted = words(chunks).groupBy("term").agg(F.count("*").alias("n"))
    pooled = counted.orderBy(F.desc("n"), F.asc("term")).limit(pool)
    return pooled.join(known.select(F.lower("term").alias("term")).distinct(), "term", "left_anti").orderBy(F.desc("n"), F.asc("term")).limit(k)


def candidates(chunks: DataFrame, known: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """Per document its k most frequent unknown words, if met at least twice."""
    stop = known.select(F.lower("term").alias("term")).union(chunks.sparkSession.createDataFrame([(w,) for w in fixed.STOP_CANDIDATES], "term string"))
    counted = words(chunks, "document_id").groupBy("document_id", "term").agg(F.count("*").alias("n"))
    new = counted.join(stop.distinct(), "term", "left_anti")
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), F.asc("term"))
    return new.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("n") >= least)).select("document_id", "term", "n")


def accumulate_candidates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New state of the candidate table: proposed ones add up, decided ones stay, others enter.

    stored: term, count, sample_document, status; new: term, n, sample_document.
    """
    n = new.groupBy("term").agg(F.sum("n").alias("n"), F.min("sample_document").alias("_sample"))
    j = stored.join(n, "term", "full_outer")
    grown = F.col("count") + F.when(F.col("status") == "proposed", F.coalesce("n", F.lit(0))).otherwise(0)
    return j.select("term", F.coalesce(grown, "n").alias("count"), F.coalesce("sample_document", "_sample").alias("sample_document"), F.coalesce("status", F.lit("proposed")).alias("status"))


def search_keyword(term: str, keywords: DataFrame, chunk_keywords: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Where a catalogue term occurs: document, pages, section, fragment and count."""
    k = keywords.where(F.lower("term") == term.strip().lower()).where("is_active").select("keyword_id")
    c = chunks.select("chunk_id", "document_id", "page_numbers", "content")
    j = chunk_keywords.join(k, "keyword_id").join(c, "chunk_id").join(documents.select("document_id", "original_name"), "document_id")
    return j.select("original_name", "chunk_id", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"), text.heading(F.col("content")).alias("section"), text.excerpt(F.col("content")).alias("fragment"), "match_count")
