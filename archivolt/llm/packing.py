"""Packing of token sequences by bounded-space online best fit."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.bpe import ranks
from archivolt.llm.common import blocks, scratch

SPECIAL, SPECIAL_ID, END_ID = "<|endoftext|>", 50256, 2
KEPT_CHUNKS = 150_000
CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Tokens(dict):
    """Token ids of a text, as little-endian unsigned 32-bit integers.

    The ranks hold the same vocabulary as the tokenizer's JSON file, and give
    its ids. No match of the splitting pattern reaches from a character that is
    not white space into white space, so a chunk of white space and what
    follows up to the next white space has the same ids wherever it stands.
    Ids of chunks are kept in two generations of bounded size: when the young
    one is full it becomes the old one, from which chunks met again return.
    """

    def __init__(self, path: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.old = dict(self)
            self.clear()
        value = self.old.get(chunk)
        if value is None:
            word = chunk[1:]
            if chunk[0] == " " and word.isalpha() and max(word) < "\u0250":  # a space and letters are one match
                value = array("I", self.encoding._core_bpe.encode_single_piece(chunk.encode())).tobytes()
            else:
                value = self._plain(chunk)
        self[chunk] = value
        return value

    def _plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:  # the tokenizer takes the string of its special token for that token
            return np.array([SPECIAL_ID], dtype="<u4").tobytes().join(self.ids(part) for part in text.split(SPECIAL))
        if RARE_SPACE.search(text):
            return self._plain(text)
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first, which takes the rest."""
    first = total % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, total, limit)]


def _pieces(path: str, limit: int):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens(path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(table.ids(text.as_py() or "") + end)
                for n, (s, size) in enumerate(cut(len(ids) // 4, limit)):
                    doc.append(d)
                    piece.append(n)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + size)]))
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class BestFit:
    """Bounded-space online best fit.

    At most `most` bins are open. Bit f of the set is on while a bin with f
    free places is open; the smallest bit at or above an item's size names the
    bin it fits best. If no bin has room and all are open, the fullest closes.
    """

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits, self.open, self.count, self.closed = 0, {}, 0, 0

    def place(self, size: int) -> tuple[int, int] | tuple[None, int]:
        """(bin, offset); a bin of None is a new one, at offset 0."""
        fits = self.bits >> size
        if not fits:
            return None, 0
        free = size + (fits & -fits).bit_length() - 1
        return self._take(free), self.limit - free

    def _take(self, free: int) -> int:
        bins = self.open[free]
        bin_ = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return bin_

    def put(self, bin_: int, free: int) -> None:
        """Open a bin, or open it again with what is left."""
        if free <= 0:
            return
        if self.count >= self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)
            self.closed += 1
        self.open.setdefault(free, []).append(bin_)
        self.bits |= 1 << free
        self.count += 1


class Packer:
    """Bins and offsets of items as they arrive, `ahead` of them at a time and there the longest first."""

    def __init__(self, limit: int, most: int, ahead: int = 1, first: int = 0):
        self.fit, self.ahead, self.new = BestFit(limit, most), ahead, first

    def place(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for start in range(0, len(sizes), self.ahead):
            for i in (start + np.argsort(-sizes[start : start + self.ahead], kind="stable")).tolist():
                size = int(sizes[i])
                bin_, offset = self.fit.place(size)
                if bin_ is None:
                    bin_, self.new = self.new, self.new + 1
                self.fit.put(bin_, self.fit.limit - offset - size)
                bins[i], offsets[i] = bin_, offset
        return bins, offsets


def pack(sizes: list[int], limit: int, most: int, ahead: int = 1) -> tuple[list[int], list[int]]:
    """Bins and offsets of items in the order given."""
    bins, offsets = Packer(limit, most, ahead).place(np.asarray(sizes, dtype=np.int64))
    return bins.tolist(), offsets.tolist()


def _pack(limit: int, most: int, ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limit, most, ahead, TaskContext.get().partitionId() << 40)
        for batch in batches:
            bins, offsets = packer.place(np.asarray(batch.column("length")))
            yield pa.record_batch([*batch.columns, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, path: str, limit: int = 1024, open_bins: int = 512, ahead: int = 2048, task_pieces: int = 50_000) -> DataFrame:
    """Cut documents into pieces of at most limit tokens and pack these into sequences.

    A document is its ids and then id 2, so null and empty texts are one token.
    Longer documents are cut into full pieces, which fill sequences alone, and
    a first piece of the rest. Pieces are dealt by a hash to tasks of about
    task_pieces and arrive there in the order of that hash, so the result does
    not depend on the input's order, and a task run again gives the same
    sequences. A task looks at `ahead` pieces at a time, takes the longest
    first, and keeps at most open_bins sequences open: where all are and none
    has room, the fullest closes. Repeated rows are packed each on its own; a
    null doc_id stays null; other columns are not read. An empty table gives an
    empty result.
    """
    pieces = scratch(docs.select("doc_id", "text").mapInArrow(_pieces(path, limit), PIECES), "pieces")
    tasks = blocks(pieces.count(), task_pieces)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(tasks, order).sortWithinPartitions(order, *pieces.columns)
    return dealt.mapInArrow(_pack(limit, open_bins, ahead), PIECES + ", sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` packed into sequences of 1024 tokens; odd rows as in pack_documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
