"""Byte-level BPE encoding and decoding by monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

LEAF = 48
REACH = 4096  # characters on either side up to which a join inside one match is tried again
WHITE = frozenset(" \t\n\r")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = frozenset("0123456789")
ASCII = frozenset(map(chr, range(128)))
# Long runs of one class, by characters whose class no Unicode version disputes.
RUN = re.compile(r"[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+|[\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3]+")


def is_cut(before: str, after: str) -> bool:
    """Whether no match of the pattern can hold both of two neighbouring characters.

    White space opens a match and never follows another character in it; a
    letter or a digit is followed by its own class only.
    """
    return (
        (after in WHITE and not before.isspace())
        or (before in LETTERS and after in ASCII and after not in LETTERS)
        or (before in DIGITS and after in ASCII and after not in DIGITS)
    )


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes by one file of ranks.

    A text is an element of a monoid whose product joins the tokens of two
    neighbours. Halves are encoded on their own, down to leaves of `leaf`
    characters, and joined up the tree. A join encodes a window around the seam
    anew that grows until the tokens outside cannot change:

    The pattern parts a text into matches from left to right, and tokens never
    cross a match. At a cut (`is_cut`) one match ends and the next begins,
    whatever stands further off: the pattern can neither run over those two
    characters nor look beyond them. So the matches left of a cut are those of
    the left part alone, those right of it those of the right part alone, and
    the tokens of the whole are the two parts' tokens, one after the other. The
    left half's text up to the last cut before the seam is hence encoded as in
    the whole text, likewise the right half's from the first cut on, and only
    what lies between is encoded anew (`_join`).

    Inside one match merges go by rank alone. The tokens of a piece are those
    of the whole exactly if each two neighbours, taken alone, stay as they are:
    a merge across two tokens would have to happen between those two first. In
    each half all neighbours stay; so if the new tokens' ends stay with their
    old neighbours outside the window, all do (`_join_run`).
    """

    def __init__(self, path: str, leaf: int = LEAF):
        table = ranks(path)
        self.leaf, self.reaches = leaf, (leaf, REACH)
        self.joins = self.run_joins = 0
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.encoding.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b].

        The window around m grows on both sides to a cut or to the end of the
        text. Where it gets long without one, the join is tried inside the run
        of characters around m.
        """
        self.joins += 1
        start, end = m - 1, m + 1
        while start > a and not is_cut(text[start - 1], text[start]):
            start -= 1
            if m - start in self.reaches and (joined := self._join_run(text, a, m, b, left, right, m - start)) is not None:
                return joined
        while end < b and not is_cut(text[end - 1], text[end]):
            end += 1
            if end - m in self.reaches and (joined := self._join_run(text, a, m, b, left, right, end - m)) is not None:
                return joined
        keep_left = self._tokens_for(left, len(text[start:m].encode()), True)
        keep_right = self._tokens_for(right, len(text[m:end].encode()), False)
        return left[: len(left) - keep_left] + self.encoding.encode_ordinary(text[start:end]) + right[keep_right:]

    def _tokens_for(self, tokens: list[int], size: int, from_end: bool) -> int:
        """How many tokens at one end make up size bytes."""
        n = 0
        for token in reversed(tokens) if from_end else tokens:
            if size <= 0:
                break
            size -= len(self.bytes_of[token])
            n += 1
        return n

    def _join_run(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int], reach: int) -> list[int] | None:
        """Join inside one long match, where all characters around m are of one class.

        The last k tokens on the left and the first k on the right are encoded
        anew for growing k, until the new tokens' ends agree with their old
        neighbours outside. None: no such window within reach.
        """
        if m - a < reach or b - m < reach or not RUN.fullmatch(text, m - reach, m + reach):
            return None
        piece, of = self.encoding._encode_single_piece, self.bytes_of
        k = 4
        while True:
            l_part, r_part = left[-k:], right[:k]
            if k >= min(len(left), len(right)) or sum(len(of[t]) for t in l_part) >= reach or sum(len(of[t]) for t in r_part) >= reach:
                return None  # the window would leave the run
            middle = piece(b"".join(of[t] for t in l_part + r_part))
            before, after = left[-k - 1], right[k]
            if piece(of[before] + of[middle[0]]) == [before, middle[0]] and piece(of[middle[-1]] + of[after]) == [middle[-1], after]:
                self.run_joins += 1
                return left[:-k] + middle + right[k:]
            k *= 2

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of the tokens, concatenated up the tree."""
        n = len(ids)
        if n <= 16 * self.leaf:
            of = self.bytes_of
            return b"".join([of[i] for i in ids])
        return self.decode(ids[: n // 2]) + self.decode(ids[n // 2 :])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids again; with_ids returns the ids too.

    Null and empty texts have no tokens. Texts of any length are encoded whole.
    Rows are independent: repeated rows give repeated results, a null doc_id
    stays null, other columns are not read, an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_digests(path, with_ids), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of `documents`; odd rows as in encode_documents."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
