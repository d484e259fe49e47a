"""Decisions about recognised pages: engines themselves are pluggable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.models import OcrEngine

WORD_CONFIDENCE, LINE_CONFIDENCE = 20, 0.4
LOW, CASCADE, ROTATE, MARGIN = 45.0, 60.0, 60.0, 1.15


def is_empty_page(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 20


def mean_confidence(conf: str) -> Column:
    """Aggregate: mean of positive confidences, 0 without any."""
    return F.coalesce(F.avg(F.when(F.col(conf) > 0, F.col(conf))), F.lit(0.0))


def cascade(first_text: Column, first_score: Column, second_text: Column, second_score: Column) -> Column:
    """Which engine's page to keep: `first` if it has text and scores 60, else the better one."""
    has = lambda t: F.length(F.trim(F.coalesce(t, F.lit("")))) > 0
    second = has(second_text) & ((F.coalesce(second_score, F.lit(0.0)) >= F.coalesce(first_score, F.lit(0.0))) | ~has(first_text))
    return F.when(has(first_text) & (first_score >= CASCADE), "first").when(second, "second").otherwise("first")


def words_of(found: DataFrame) -> DataFrame:
    """Words that an engine of words is sure enough of: document_id, page, n (their order), text, conf 0 to 100, x, y, w, h."""
    t = F.trim("text")
    return found.withColumn("text", t).where((t != "") & (F.coalesce(F.col("conf").try_cast("int"), F.lit(-1)) > WORD_CONFIDENCE)).withColumn("conf", F.col("conf").cast("int").cast("double"))


def words_of_lines(found: DataFrame) -> DataFrame:
    """The same of an engine of lines, whose conf is 0 to 1 and whose place is a polygon of (x, y) points.

    A box is the polygon's whole-number extent, 1 wide and high at least; lines
    without text, confidence or polygon go.
    """
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    low_x, low_y, high_x, high_y = (f(c).cast("int") for f, c in ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys)))
    kept = found.where((F.coalesce("text", F.lit("")) != "") & (F.col("conf") >= LINE_CONFIDENCE) & F.col("polygon").isNotNull())
    box = {"text": F.trim("text"), "conf": F.col("conf") * 100, "x": low_x, "y": low_y, "w": F.greatest(F.lit(1), high_x - low_x), "h": F.greatest(F.lit(1), high_y - low_y)}
    return kept.withColumns(box).drop("polygon")


def page_text(words: DataFrame) -> DataFrame:
    """Text and mean confidence of each page from the words kept, in their order."""
    g = words.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("_w"), F.avg("conf").alias("score"))
    return g.select("document_id", "page", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"), "score")


def page_of(words: Column) -> Column:
    """The same of one page whose words are an array of structs (text, conf) in their order, for `inline`: n, text and score, nothing without words.

    A page's words then stay in its row, and nothing has to be dealt out.
    """
    named = F.transform(words, lambda w: F.struct(F.trim(w["text"]).alias("text"), w["conf"].try_cast("int").alias("conf")))
    kept = F.filter(named, lambda w: (w["text"] != "") & (F.coalesce(w["conf"], F.lit(-1)) > WORD_CONFIDENCE))
    score = lambda k: F.aggregate(k, F.lit(0.0), lambda s, w: s + w["conf"]) / F.size(k)
    page = lambda k: F.struct(F.size(k).cast("long").alias("n"), F.array_join(F.transform(k, lambda w: w["text"]), " ").alias("text"), score(k).alias("score"))
    return F.transform(F.filter(F.array(kept), lambda k: F.size(k) > 0), page)


def angle(found: Column, confidence: Column, failed: Column, upright: Column, turned: Column) -> Column:
    """The angle to turn a page by: that of the orientation test, unless it failed or saw 0 without confidence.

    Then the page is turned by 180 if it reads clearly better that way; the
    scores of both readings are needed in this case only.
    """
    unsure = failed | ((found % 360 == 0) & confidence.isNotNull() & (confidence < 1.0))
    return F.when(unsure, F.when(rotate(upright, turned), 180).otherwise(0)).otherwise(F.pmod(found, F.lit(360)))


def recognise(images: DataFrame, engine: OcrEngine, partitions: int | None = None) -> DataFrame:
    """Words of page images (document_id, page, content): document_id, page, n, text, conf, x, y, w, h.

    Pages are recognised in parallel and in any order, each by itself; n keeps
    the order within a page. A page whose recognition fails gives one row with
    the error as text and a confidence of -1, which `words_of` drops.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, page, content in zip(part["document_id"], part["page"], part["content"], strict=True):
                try:
                    words = engine.read(bytes(content))
                except Exception as e:  # one bad page must not lose the others
                    words = [{"text": f"error: {e}"[:200], "conf": -1.0}]
                out += [(doc, page, n, str(w.get("text", "")), float(w.get("conf", 0.0)), *(int(w.get(k, 0)) for k in "xywh")) for n, w in enumerate(words)]
            yield pd.DataFrame(out, columns=["document_id", "page", "n", "text", "conf", "x", "y", "w", "h"])

    pages = images.select("document_id", "page", "content")
    if partitions:
        pages = pages.repartition(partitions, "document_id", "page")
    return pages.mapInPandas(run, "document_id long, page int, n int, text string, conf double, x int, y int, w int, h int")


def correct_box(boxes: DataFrame, document_id: int, page: int, index: int, new: str) -> DataFrame:
    """Word boxes with one word's text replaced; an empty text changes nothing."""
    hit = (F.col("document_id") == document_id) & (F.col("page") == page) & (F.col("box_index") == index) & F.lit(bool(new.strip()))
    return boxes.withColumn("text", F.when(hit, F.lit(new.strip())).otherwise(F.col("text")))


def rotate(upright: Column, turned: Column) -> Column:
    """Whether a page stands on its head."""
    return (turned >= ROTATE) & (turned > MARGIN * upright)


def remap(box: dict[str, Column], angle: Column, width: Column, height: Column) -> dict[str, Column]:
    """A word's box on a page turned by 0, 90, 180 or 270 degrees, at least 1 wide and high."""
    x0, y0, x1, y1 = box["x"], box["y"], box["x"] + box["w"], box["y"] + box["h"]

    def turned(x: Column, y: Column) -> tuple[Column, Column]:
        return (
            F.when(angle == 90, y).when(angle == 180, width - x).when(angle == 270, width - y).otherwise(x),
            F.when(angle == 90, height - x).when(angle == 180, height - y).when(angle == 270, x).otherwise(y),
        )

    (ax, ay), (bx, by) = turned(x0, y0), turned(x1, y1)
    return {"x": F.least(ax, bx), "y": F.least(ay, by), "w": F.greatest(F.lit(1), F.abs(bx - ax)), "h": F.greatest(F.lit(1), F.abs(by - ay))}


def worst_page(chunks: DataFrame, pages: DataFrame, threshold: float = LOW) -> DataFrame:
    """Per chunk the lowest page score, that page's engine, and whether it is low.

    pages: document_id, page, score, engine. Pages without a score do not count.
    """
    each = chunks.select("chunk_id", "document_id", F.explode_outer("page_numbers").alias("page"))
    met = each.join(pages.where("score is not null"), ["document_id", "page"], "left")
    worst = met.groupBy("chunk_id").agg(F.min("score").alias("ocr_score"), F.min(F.when(F.col("score").isNotNull(), F.struct("score", "page", "engine"))).alias("_m"))
    return worst.select("chunk_id", "ocr_score", F.col("_m.engine").alias("ocr_engine"), F.coalesce(F.col("ocr_score") < threshold, F.lit(False)).alias("low_confidence"))


def low_pages(pages: DataFrame, threshold: float = LOW) -> DataFrame:
    return pages.where(F.col("score") < threshold).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


def find_words(boxes: DataFrame, term: str) -> DataFrame:
    """Word boxes whose text holds the term, whatever the case."""
    return boxes.where(F.contains(F.lower("text"), F.lit(term.lower())))
