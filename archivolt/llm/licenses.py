"""License scans by ordered signature rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from archivolt.llm.license_rules import RULES, SHORT

# Every byte that is not part of a word becomes a space, A-Z become a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


@dataclass(frozen=True)
class Rule:
    """A signature: any of its keywords is in every text that the pattern matches."""

    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, first those of the highest priority, and as they are listed within one."""
    out = []
    for label, priority, keywords, pattern in RULES:
        for short, full in SHORT.items():
            pattern = pattern.replace(short, full)
        out.append(Rule(label, re.compile(rf"(?<= )(?:{pattern})(?= )"), tuple(keywords.split("|")), priority))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def prefilter() -> ahocorasick.Automaton:
    """Finds all rules' keywords and the base phrases in one pass; a keyword's value is the rules it admits."""
    admits: dict[str, list[int]] = {f" {phrase} ": [] for phrase in BASE.values()}
    for n, rule in enumerate(rules()):
        for k in rule.keywords:
            admits.setdefault(k, []).append(n)
    automaton = ahocorasick.Automaton()
    for k, numbers in admits.items():
        automaton.add_word(k, (k, tuple(numbers)))
    automaton.make_automaton()
    return automaton


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int


def detect(joined: str, tried: set[int] | None = None) -> list[Detection]:
    """Detections in words joined by single spaces, overlaps resolved.

    Only the rules in `tried` are tried, or all. A detection inside another of
    the same or a higher priority gives way to it; of two with the same place
    the rule that comes first wins.
    """
    padded = f" {joined} "
    every, found = rules(), []
    for n in range(len(every)) if tried is None else sorted(tried):
        rule = every[n]
        found += [(-rule.priority, m.start() - m.end(), n, m.start(), m.end(), rule.label) for m in rule.pattern.finditer(padded)]
    kept: list[Detection] = []
    starts: list[int] = []  # of the kept detections that no other kept one holds; their ends ascend with them
    ends: list[int] = []
    for priority, _, _, start, end, label in sorted(found):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append(Detection(label, start, end, -priority))
        first, last = bisect_left(starts, start), bisect_right(ends, end)
        starts[first : max(first, last)] = [start]
        ends[first : max(first, last)] = [end]
    return kept


def scan(text: str | None) -> dict:
    """Word count, base places and labels of one text."""
    words = (text or "").encode().translate(WORDS).split()
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    joined = b" ".join(words).decode()
    padded, starts, base = f" {joined} ", [], set()
    met = {k: admitted for _, (k, admitted) in prefilter().iter(padded)}
    if not met:
        return out
    for label, phrase in BASE.items():
        if f" {phrase} " in met:
            starts += [m.start() for m in re.finditer(f"(?= {phrase} )", padded)]
            base.add(label)
    kept = detect(joined, {n for admitted in met.values() for n in admitted})
    spaces = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32) if starts or kept else np.zeros(0, int)
    before = lambda places: np.searchsorted(spaces, places).tolist()
    if starts:
        out |= {"n_base": len(starts), "first_word": before(min(starts)), "last_word": before(max(starts))}
    score = max([d.priority / 100 for d in kept] + [0.6 if base else 0.0])
    out |= {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {d.label for d in kept})), "score": score}
    firsts, lasts = before([d.start for d in kept]), before([d.end for d in kept])
    out["spans"] = [{"label": d.label, "first": a - 1, "words": b - a + 1} for d, a, b in zip(kept, firsts, lasts, strict=True)]
    return out


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column("text")]
        columns = [batch.column("doc_id")] + [pa.array([r[f.name] for r in rows], f.type) for f in list(_OUT)[1:]]
        yield pa.record_batch(columns, schema=_OUT)


def scan_documents(docs: DataFrame) -> DataFrame:
    """License labels of each text, and spans: label, first word and number of words.

    Null and empty texts have no words, no labels ('' each), null first and
    last word and score 0. The score is the highest priority of the rules kept,
    over 100. Whole texts are scanned, in time that grows with their length and
    no faster. Rows are independent: repeated rows give repeated results, a null
    doc_id stays null, other columns are not read, an empty table gives an
    empty result.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long>>"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every whole text of `documents`; null and empty texts have none, other odd rows as in scan_documents."""
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base places and labels alone, which SQL can tell too."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _places(phrase: str) -> str:
    met = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))
    return f"list_filter(range(0, len(w)), lambda i: {met})"


BASE_SQL = (
    r"WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),"
    + f" p AS (SELECT doc_id, len(w) AS n, {', '.join(f'{_places(phrase)} AS {label}' for label, phrase in BASE.items())} FROM t),"
    + """ a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM a"""
)
