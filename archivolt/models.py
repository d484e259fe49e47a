"""Pluggable models, with deterministic defaults that need no files.

An engine takes any object with the same method; the defaults stand in for
neural models and make no claim to their quality.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def logits(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class OcrEngine(Protocol):
    """Words of a page image: text, box and confidence of each."""

    def read(self, image: bytes) -> list[dict]: ...


class Extractor(Protocol):
    """Text of each page of a file."""

    def pages(self, content: bytes) -> dict[int, str]: ...


class HashEmbedder:
    """Signed hash of words, scaled to length 1; a zero vector for no words."""

    def __init__(self, size: int = 384):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1.0 if h & 0x80000000 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


class OverlapReranker:
    """Log-odds of the share of question words that the text holds."""

    def logits(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for question, text in pairs:
            q, t = set(re.findall(r"\w+", question.lower())), set(re.findall(r"\w+", (text or "").lower()))
            share = (len(q & t) + 0.5) / (len(q) + 1)
            out.append(math.log(share / (1 - share)))
        return out


class ExtractiveGenerator:
    """The context sentence that shares most words with the question, with its source."""

    def answer(self, question: str, context: str) -> str:
        q = set(re.findall(r"\w+", question.lower()))
        best, source, current = (0, ""), 0, 0
        for line in context.split("\n"):
            head = re.match(r"\[(\d+)\] Documento:", line)
            if head:
                current = int(head[1])
                continue
            for sentence in re.split(r"(?<=[.!?])\s+", line):
                n = len(q & set(re.findall(r"\w+", sentence.lower())))
                if n > best[0]:
                    best, source = (n, sentence), current
        return f"{best[1]} [{source}]" if source else "No se encuentra en los documentos."


def embed(df: DataFrame, text: str, model: Embedder, batch: int = 32) -> DataFrame:
    """df with a column embedding; the model is loaded once per worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model.embed(texts[i : i + batch])])

    return df.withColumn("embedding", run(F.col(text)))


def embed_missing(df: DataFrame, text: str, model: Embedder) -> DataFrame:
    """Vectors for the rows that have none, in one pass over those rows only."""
    there = df.where("embedding is not null")
    return there.unionByName(embed(df.where("embedding is null").drop("embedding"), text, model).select(*df.columns))


def rerank_logits(question: str, text: str, model: Reranker) -> Column:
    """Model score per row; null where the model fails, so that the order before stays."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(model.logits(list(zip(q, t, strict=True))), dtype=float)
        except Exception:  # a model that fails must not fail the search
            return pd.Series([None] * len(q), dtype=float)

    return run(F.col(question), F.col(text))


def json_object(text: str) -> dict:
    """The first object in a model's reply: fences dropped, open strings and brackets closed."""
    import json

    body = re.sub(r"```(?:json)?", "", text or "")
    start = body.find("{")
    if start < 0:
        return {}
    body = body[start:]
    decoder = json.JSONDecoder()
    try:
        return decoder.raw_decode(body)[0]
    except json.JSONDecodeError:
        pass
    stack, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    closed = body + '"' * quoted + "".join(reversed(stack))
    for attempt in (closed, re.sub(r",\s*([}\]])", r"\1", closed), re.sub(r'[,:]?\s*"[^"]*"?\s*:?\s*([}\]]*)$', r"\1", closed)):
        try:
            return json.loads(attempt)
        except json.JSONDecodeError:
            continue
    return {}
