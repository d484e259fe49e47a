"""Incremental ingestion: files in, pages, masked text, chunks and keyword hits out.

A stream reads new page files and holds the pages of a document until all have
come (`pages.buffered`). Each micro-batch adds them to the stored pages and
replaces the chunks of their documents by those of all their pages, so a batch
that is run again after a failure leaves the same tables, and a document whose
pages come in several batches has them all. The checkpoint is the
acknowledgement.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from archivolt.functions import pii, text
from archivolt.models import Embedder, embed
from archivolt.operators import chunking, knowledge, scorecard, workflow
from archivolt.streaming.pages import buffered, use_state_store

PAGES = "document_id bigint, page int, text string, page_count int"
RETRIES, MOST_FAILED, PATIENCE_MS = 2, 0.5, 3_600_000


def masked_pages(pages: DataFrame, today: str) -> DataFrame:
    """Pages with the age found on them, taken before birth dates are masked.

    An age counts from its page on, as chunks closed before it was met do not
    know it.
    """
    aged = pages.withColumn("_age", pii.age(pii.birth_date(F.col("text")), F.lit(today).cast("date")))
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return aged.withColumn("age", F.first("_age", ignorenulls=True).over(w)).select("document_id", "page", pii.mask(F.col("text")).alias("text"), "age")


def chunk_table(pages: DataFrame, today: str, model: Embedder | None = None) -> DataFrame:
    """Chunks with ids that depend on document and position only."""
    c = chunking.chunk_pages(masked_pages(pages, today))
    c = c.withColumn("chunk_id", F.xxhash64("document_id", "chunk_index"))
    c = c.withColumns({"section": text.heading(F.col("content")), "fragment": text.excerpt(F.col("content"))})
    return embed(c, "content", model) if model else c


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """A table, or None if nothing has been written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)  # an empty table has no file to tell its schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def of_same_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows in the buckets that new has rows of: what is not read need not be written."""
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # bounded by the number of buckets
    return old.where(F.col("bucket").isin(touched))


def merge_buckets(df: DataFrame, path: str, buckets: int, replaced: DataFrame | None = None) -> None:
    """Put df's documents in place of their old rows, rewriting only their buckets.

    `replaced` (document_id) names the documents whose old rows go; without it
    those of df. A document without new rows loses its old ones.
    """
    spark = df.sparkSession
    new = df.withColumn("bucket", bucket_of(buckets))
    old = stored(spark, path, new.schema)
    if old is not None:
        ids = (df if replaced is None else replaced).select("document_id").distinct().withColumn("bucket", bucket_of(buckets))
        kept = of_same_buckets(old, ids).join(ids.select("document_id"), "document_id", "left_anti")
        staged = f"{path}__staging"
        new.unionByName(kept.select(*new.columns)).write.mode("overwrite").parquet(staged)
        new = spark.read.schema(new.schema).parquet(staged)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def with_stored_pages(pages: DataFrame, path: str, buckets: int) -> DataFrame:
    """All pages of the documents that pages has some of: the new ones, and stored ones of other numbers.

    A page that comes again with another text opens the document anew: what is
    stored of it goes.
    """
    new = pages.select("document_id", "page", "text", bucket_of(buckets).alias("bucket"))
    old = stored(pages.sparkSession, path, new.schema)
    if old is None:
        return new.drop("bucket")
    old = of_same_buckets(old, new).select("document_id", "page", F.col("text").alias("_old"))
    met = old.join(new.select("document_id", "page", "text"), ["document_id", "page"], "left")
    changed = met.where("text is not null and text <> _old").select("document_id").distinct()
    others = met.where("text is null").join(changed, "document_id", "left_anti").join(new.select("document_id").distinct(), "document_id", "left_semi")
    return new.drop("bucket").unionByName(others.select("document_id", "page", F.col("_old").alias("text")))


def isolated(pages: DataFrame, work: Callable[[DataFrame], None], retries: int, most: float, pause: float, failed: Callable[[DataFrame, int, str], None]) -> None:
    """Do work on pages; where it fails, on halves of their documents, until those that fail stand alone.

    A document that fails alone is tried `retries` times more; `failed` is
    told each attempt. If more than `most` of the documents fail, the fault is
    not theirs: the error is raised and nothing counts as done.
    """
    total = pages.select("document_id").distinct().count()
    lost: list[str] = []

    def attempt(part: DataFrame, depth: int) -> None:
        try:
            work(part)
            return
        except Exception as e:
            error = str(e)
        if part.select("document_id").distinct().limit(2).count() > 1:
            side = F.pmod(F.xxhash64("document_id", F.lit(depth)), F.lit(2))
            for half in (0, 1):
                some = part.where(side == half)
                if not some.isEmpty():
                    attempt(some, depth + 1)
            return
        for n in range(1, retries + 1):
            failed(part, n, error)
            time.sleep(pause)
            try:
                work(part)
                return
            except Exception as e:
                error = str(e)
        failed(part, retries + 1, error)
        lost.append(error)
        if len(lost) > max(1, most * total):
            raise RuntimeError(error)

    attempt(pages, 0)


def ingest(
    spark: SparkSession, source: str, root: str, keywords: DataFrame, today: str, model: Embedder | None = None, buckets: int = 16,
    patience_ms: int = PATIENCE_MS, retries: int = RETRIES, pause: float = 0.0, most_failed: float = MOST_FAILED,
) -> StreamingQuery:
    """Process all page files that are new since the last run, then stop.

    A document that cannot be processed is tried `retries` times more and then
    put aside in `quarantine`, with its pages and the error; all attempts are in
    `attempts`, and the others go on. A batch in which most documents fail
    stays open and runs again.
    """
    use_state_store(spark)

    def batch(ready: DataFrame, number: int) -> None:
        pages = ready.persist()
        if pages.isEmpty():
            pages.unpersist()
            return
        run, now = uuid.uuid4().hex, F.current_timestamp()
        staging = f"{root}/_staging/batch={number}-{run}"
        aside: list[tuple[int, str]] = []

        def failed(part: DataFrame, attempt: int, error: str) -> None:
            ids = part.select("document_id").distinct()
            ids.select("document_id", F.lit(number).alias("batch"), F.lit(attempt).alias("attempt"), F.lit(error[:2000]).alias("error"), now.alias("at")).write.mode("append").parquet(f"{root}/attempts")
            if attempt > retries:
                aside.extend((r[0], error[:2000]) for r in ids.collect())  # one document

        def work(part: DataFrame) -> None:
            whole = with_stored_pages(part, f"{root}/pages", buckets)
            chunk_table(whole, today, model).write.mode("append").parquet(f"{staging}/chunks")

        try:
            isolated(pages, work, retries, most_failed, pause, failed)
            bad = spark.createDataFrame(aside, "document_id bigint, error string")
            good = pages.join(bad, "document_id", "left_anti")
            ids = good.select("document_id").distinct()
            done = stored(spark, f"{staging}/chunks")
            if done is not None:
                chunks = done.join(ids, "document_id", "left_semi").persist()
                merge_buckets(chunks, f"{root}/chunks", buckets, ids)
                hits = knowledge.match_keywords(chunks, keywords).join(chunks.select("chunk_id", "document_id"), "chunk_id")
                merge_buckets(hits, f"{root}/chunk_keywords", buckets, ids)
                log_first(chunks, f"{root}/changes", number)
                merge_buckets(with_stored_pages(good, f"{root}/pages", buckets), f"{root}/pages", buckets)
                chunks.unpersist()
            if aside:
                marked = pages.join(F.broadcast(bad), "document_id").withColumns({"batch": F.lit(number), "at": now})
                marked.write.mode("overwrite").parquet(f"{root}/quarantine/run={number}")
                workflow.failures(bad, "ingest", F.col("error"), now).write.mode("overwrite").parquet(f"{root}/audit_errors/batch={number}")
        except Exception as e:
            # The batch stays open and runs again; its documents are in the log with the error.
            workflow.failures(pages, "ingest", str(e), now).write.mode("append").parquet(f"{root}/audit_errors/batch={number}")
            raise
        finally:
            pages.unpersist()
            remove(spark, staging)

    stream = buffered(spark.readStream.schema(PAGES).json(source), patience_ms)
    return available(stream, batch, f"{root}/_checkpoints/ingest")


def requeue(spark: SparkSession, root: str, source: str) -> None:
    """Send the pages put aside once more, as files of the source, and empty the quarantine."""
    held = stored(spark, f"{root}/quarantine")
    if held is not None:
        held.select("document_id", "page", "text").write.mode("append").json(source)
        remove(spark, f"{root}/quarantine")


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def log_first(chunks: DataFrame, path: str, number: int) -> None:
    """Append the first chunk of each document to a log that only grows: files of a batch that was logged stay as they are."""
    if not there(chunks.sparkSession, f"{path}/batch={number}/_SUCCESS"):
        chunks.where("chunk_index = 0").select("document_id", "content").write.mode("overwrite").parquet(f"{path}/batch={number}")


def extract(spark: SparkSession, root: str, fields: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Second stage with a checkpoint of its own: fields of documents from the log of their first chunks; the last entry counts."""
    stream = spark.readStream.schema("document_id bigint, content string, batch bigint").parquet(f"{root}/changes")

    def batch(changes: DataFrame, _: int) -> None:
        first = changes.groupBy("document_id").agg(F.max_by("content", "batch").alias("content"))
        merge_buckets(fields(first), f"{root}/patients", 16)

    return available(stream, batch, f"{root}/_checkpoints/extract")


def available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_snapshot(spark: SparkSession, tables: dict[str, DataFrame], at: str, path: str) -> DataFrame:
    """One snapshot of all indicators, appended; the day's rows of an earlier run are replaced.

    A source that fails costs its own indicators only: they get no row.
    """
    v, errors = scorecard.kpi_values_isolated(spark, tables)
    if errors:
        warnings.warn(f"indicators without a value: {errors}", stacklevel=2)
        v = v.where("value is not null")
    end = F.lit(at).cast("timestamp")
    rows = v.select(F.col("code").alias("kpi"), "value", F.expr(f"timestamp '{at}' - interval 30 days").alias("period_start"), end.alias("period_end"), end.alias("computed_at"), F.to_date(end).alias("day"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An extra: event counts per tumbling window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


class Refreshed:
    """A small table kept in memory and read again after `ttl` seconds, such as the synonyms."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self._table: DataFrame | None = None
        self._until = 0.0

    def get(self) -> DataFrame:
        if self._table is None or self.clock() >= self._until:
            self.forget()
            self._table = self.load().persist()
            self._until = self.clock() + self.ttl
        return self._table

    def forget(self) -> None:
        """After a change: the next reader loads anew."""
        if self._table is not None:
            self._table.unpersist()
        self._table = None
