"""A stored lexical index: postings in blocks by size of text, and exact top-k that leaves out blocks that cannot count.

A block holds entries (chunk_id, size) of one term, size being the number of
the text's trigrams. The similarity of a question of n trigrams with a text of
m is min(n, m) / max(n, m) at most, so the least and the greatest size in a
block bound the score of everything in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import text, vector
from archivolt.operators.retrieval import top
from archivolt.operators.terms import find_terms
from archivolt.sources import shared

BUCKETS, BAND, PART_ROWS, FIRST = 16, 1.5, 1_000_000, 0.3
GRAM, WORD = "g", "w"


def build(chunks: DataFrame, path: str, part_rows: int = PART_ROWS, buckets: int = BUCKETS) -> None:
    """Write the index of chunks (chunk_id, content): postings of trigrams and words, and the words.

    A block has the entries of a term in texts of sizes within a factor of
    BAND and of one part of the chunks, dealt by a hash, so that no term, however
    frequent, has to fit into one task.
    """
    parts = max(1, math.ceil(chunks.count() / part_rows))
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)\w+"), F.lit(0)))
    rows = chunks.where("content is not null").select("chunk_id", words.alias("w"), vector.trigrams(F.col("content")).alias("g")).withColumn("size", F.size("g"))
    tagged = lambda c, kind: F.transform(c, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    posted = rows.select("chunk_id", "size", F.explode(F.concat(tagged("g", GRAM), tagged("w", WORD))).alias("t"))
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(BAND)).cast("int")
    block = posted.groupBy("t.kind", "t.term", band.alias("band"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"))
    blocks = block.agg(F.collect_list(F.struct("chunk_id", "size")).alias("entries"), F.min("size").alias("low"), F.max("size").alias("high"))
    keyed = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    keyed.repartition("bucket", "band").sortWithinPartitions("bucket", "kind", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.parquet(f"{path}/postings")
    stored.where(F.col("kind") == WORD).select("term").distinct().write.mode("overwrite").parquet(f"{path}/words")


def bound(asked: Column, low: Column, high: Column) -> Column:
    """The greatest similarity of a question of `asked` trigrams with texts of low to high."""
    return F.when(high < asked, high / asked).when(low > asked, asked / low).otherwise(F.lit(1.0))


def _wanted(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, n, kind, term): trigrams of the questions, and words of the index that hold a term of theirs."""
    q = queries.select("query_id", text.query_terms(F.lower("query_text")).alias("terms"), vector.trigrams(F.col("query_text")).alias("g"))
    kind = q.schema["query_id"].dataType.simpleString()
    asked = q.select(F.col("query_id").alias("owner"), F.explode("terms").alias("term"))
    found = find_terms(spark.read.parquet(f"{path}/words"), "term", asked)
    words = found.select(F.explode(F.col("hits.owner").cast(f"array<{kind}>")).alias("query_id"), F.lit(WORD).alias("kind"), "term").distinct()
    grams = q.select("query_id", F.lit(GRAM).alias("kind"), F.explode("g").alias("term"))
    return grams.unionByName(words).join(q.select("query_id", F.size("g").alias("n")), "query_id")


def _met(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of the terms wanted that can hold something of the similarity `least`."""
    keyed = wanted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    return postings.join(keyed, ["bucket", "kind", "term"]).where(bound(F.col("n"), F.col("low"), F.col("high")) >= F.col("least"))


def _scored(met: DataFrame, k: int) -> DataFrame:
    """The k best of the texts that hold a term, by similarity; of texts that can reach `least` all entries are there."""
    fits = lambda e: bound(F.col("n"), e["size"], e["size"]) >= F.col("least")
    each = met.select("query_id", "n", "kind", F.explode(F.filter("entries", fits)).alias("e"))
    shared_ = F.count(F.when(F.col("kind") == GRAM, 1))
    counted = each.groupBy("query_id", "n", "e.chunk_id", "e.size").agg(shared_.alias("_k"), F.max((F.col("kind") == WORD).cast("int")).alias("_w")).where("_w = 1")
    union = F.col("n") + F.col("size") - F.col("_k")
    scored = counted.select("query_id", "chunk_id", F.when(union > 0, F.col("_k") / union).otherwise(0.0).alias("similarity"))
    return top(scored, k, F.desc("similarity"), F.asc("chunk_id"))


def leg(spark: SparkSession, path: str, queries: DataFrame, k: int, first: float = FIRST) -> DataFrame:
    """Chunks that contain any query term, the k of the greatest trigram similarity, as `retrieval.lexical_leg` finds them.

    First only blocks that can hold a similarity of `first` are read. Where the
    k-th hit is that similar, nothing else can be among the k; for the other
    questions the blocks that can reach their k-th hit are read.
    """
    postings = spark.read.parquet(f"{path}/postings")
    wanted = _wanted(spark, path, queries)
    near = shared.stored(_scored(_met(postings, wanted.withColumn("least", F.lit(first))), k), "lexical")
    reached = near.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_s")).where(F.col("_n") == k).select("query_id", "_s")
    least = F.coalesce("_s", F.lit(0.0))
    open_ = wanted.join(reached, "query_id", "left").withColumn("least", least).where(F.col("least") < first).drop("_s")
    done = near.join(reached.where(F.col("_s") >= first).select("query_id"), "query_id", "left_semi")
    return done.unionByName(_scored(_met(postings, open_), k))


def blocks_read(spark: SparkSession, path: str, queries: DataFrame, k: int, first: float = FIRST) -> DataFrame:
    """(query_id, blocks, near, rest): blocks of a question's terms, those read at first, and those read then."""
    postings, wanted = spark.read.parquet(f"{path}/postings"), _wanted(spark, path, queries)
    near = shared.stored(_scored(_met(postings, wanted.withColumn("least", F.lit(first))), k), "lexical")
    reached = near.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_s")).where(F.col("_n") == k)
    count = lambda least, name: _met(postings, wanted.join(reached, "query_id", "left").withColumn("least", least)).groupBy("query_id").agg(F.count("*").alias(name))
    rest = F.when(F.coalesce("_s", F.lit(0.0)) >= first, F.lit(2.0)).otherwise(F.coalesce("_s", F.lit(0.0)))
    return count(F.lit(0.0), "blocks").join(count(F.lit(first), "near"), "query_id", "left").join(count(rest, "rest"), "query_id", "left").na.fill(0)
