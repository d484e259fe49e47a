"""Pages to overlapping chunks: an order-dependent fold per document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions import fixed

MAX_TOKENS, OVERLAP, GROUP = fixed.CHUNK_TOKENS, fixed.CHUNK_OVERLAP, fixed.PAGE_GROUP
OUT = "document_id long, chunk_index int, content string, page_numbers array<int>, token_count int, edad int"


def tokens(text: str) -> int:
    return max(1, len(text) // fixed.CHUNK_CHARS)


def split(text: str) -> list[str]:
    lines = re.sub(fixed.SENTENCE_END, "\n", re.sub(fixed.BLANK_LINES, "\n\n", text)).split("\n")
    return [s for line in lines if (s := line.strip())]


def pack(text: str, pages: list[int], most: int = MAX_TOKENS, overlap: int = OVERLAP) -> Iterator[tuple[str, list[int], int]]:
    """Chunks (content, pages, tokens) of whole sentences, each new one opening with the end of the last.

    A sentence over the limit stays whole. The n-th sentence counts for the
    n-th page of the group, those beyond for the last page.
    """
    held: list[tuple[str, int]] = []
    seen: set[int] = set()
    total = 0
    for n, sentence in enumerate(split(text)):
        size = tokens(sentence)
        if held and total + size > most:
            yield " ".join(s for s, _ in held), sorted(seen) or pages[:1], total
            room, start = overlap, len(held)
            while start and held[start - 1][1] <= room:
                start -= 1
                room -= held[start][1]
            held, seen = held[start:], set()
            total = sum(k for _, k in held)
        held.append((sentence, size))
        total += size
        if pages:
            seen.add(pages[min(n, len(pages) - 1)])
    if held:
        yield " ".join(s for s, _ in held), sorted(seen) or pages[:1], total


def groups(pages: list[tuple[int, str, int | None]], limit: int = GROUP) -> Iterator[tuple[str, list[int], int | None]]:
    """Runs of pages of limit tokens at most, with the first age met so far."""
    texts, numbers, size, age = [], [], 0, None
    for number, text, found in pages:
        text = (text or "").strip()
        if not text:
            continue
        n = tokens(text)
        if texts and size + n > limit:
            yield "\n\n".join(texts), numbers, age
            texts, numbers, size = [], [], 0
        age = found if age is None else age
        texts.append(text)
        numbers.append(number)
        size += n
    if texts:
        yield "\n\n".join(texts), numbers, age


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, pages in zip(batch.column("document_id").to_pylist(), batch.column("pages").to_pylist(), strict=True):
            index = 0
            for text, numbers, age in groups([(p["page"], p["text"], p["age"]) for p in pages]):
                for content, on, n in pack(text, numbers):
                    rows.append((doc, index, content, on, n, age))
                    index += 1
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32())
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["document_id", "chunk_index", "content", "page_numbers", "token_count", "edad"])


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of documents given as pages (document_id, page, text, age).

    One shuffle by document; pages are put in order inside their document, so
    arrival order is free. Blank pages are skipped.
    """
    docs = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "text", "age"))).alias("pages"))
    return docs.mapInArrow(_fold, OUT)
