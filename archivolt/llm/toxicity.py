"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from archivolt.llm.common import remainder

WORD = re.compile(r"[^\W\d_]+")
WIDTH = 1 << 18
WINDOW = 16
KEPT_WORDS = 150_000
FORMS = 1 << 22
MOST_FORMS = 6  # of a word
MOST_FEATURES = 9
MOST = 30.0


def _h(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


def forms(word: str) -> list[str]:
    """The word and its longer prefixes: forms that can mark a span."""
    return ["w" + word] + ["p" + word[:k] for k in (4, 5, 6, 7, 8) if len(word) > k]


def own_features(word: str) -> list[int]:
    names = ["bias", "w" + word, "s" + word[-3:]] + ["p" + word[:k] for k in (3, 4, 5, 6, 7, 8) if len(word) > k]
    return [_h(x) for x in names]


@dataclass
class Field:
    """Weights of the hashed features, and log-potentials from state to state (0 clean, 1 toxic)."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, lift: list[float]) -> list[float]:
        """Probability of the toxic state at each token, by forward and backward ratios.

        lift is the exponential of each token's score for toxic over clean.
        """
        (oo, ot), (to, tt) = np.exp(self.moves).tolist()
        forward, r = [], None
        for g in lift:
            r = g if r is None else g * (r * tt + ot) / (r * to + oo)
            forward.append(r)
        out, q = [], 1.0
        for r, g in zip(reversed(forward), reversed(lift), strict=True):
            odds = r * q
            out.append(odds / (1.0 + odds))
            x = g * q
            q = (to + tt * x) / (oo + ot * x)
        out.reverse()
        return out


class Scorer(dict):
    """Per-word lifts, kept for a bounded number of words."""

    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        score = float(self.field.weights[own_features(word)].sum())
        value = self[word] = math.exp(max(-MOST, min(MOST, score)))
        return value


def tag(scorer: Scorer, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """Document score, and offending spans as (start, end, probability) in characters.

    The score is the highest marginal of any token, 0 without tokens. Tokens
    of at least `least` that follow one another make one span.
    """
    text = text or ""
    words = WORD.findall(text.lower())
    if not words:
        return 0.0, []
    p = scorer.field.marginals(list(map(scorer.__getitem__, words)))
    score = max(p)
    spans: list[tuple[int, int, float]] = []
    if score >= least:
        places = list(WORD.finditer(text))
        if len(places) == len(words):  # lower-casing can split or join letters of a few scripts
            last = -2
            for t, x in enumerate(p):
                if x >= least:
                    m = places[t]
                    if last == t - 1:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], x))
                    else:
                        spans.append((m.start(), m.end(), x))
                    last = t
    return score, spans


class Vocabulary(dict):
    """Numbers of words; 0 is no word and fills up windows."""

    def __init__(self):
        self[""] = 0

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.setdefault(w, len(self)) for w in words), np.int32, len(words))


def seeds(toxic: list[list[str]], clean: list[list[str]], chance: float = 0.01) -> set[str]:
    """Forms that mark toxic documents, given as lists of words (`marks_of`)."""
    words = Vocabulary()
    return marks_of(words, [words.ids(d) for d in toxic], [words.ids(d) for d in clean], chance)


def marks_of(words: Vocabulary, toxic: list[np.ndarray], clean: list[np.ndarray], chance: float = 0.01) -> set[str]:
    """Forms that mark toxic documents: in more of them than chance allows.

    A form in a toxic and b clean documents is a mark if it is 20 times as
    frequent among toxic documents, and if so uneven a split has a probability
    below chance / (number of forms) for a form that is blind to toxicity. As
    copies of a document are no independent evidence, a document does not count
    in a if the form stands there between two words between which an earlier
    document had it. Forms are counted by a hash.
    """
    if not toxic:
        return set()
    names = list(words)
    own = np.full((len(names), MOST_FORMS), FORMS, dtype=np.int32)
    for n, word in enumerate(names):
        f = [zlib.crc32(x.encode()) % FORMS for x in forms(word)]
        own[n, : len(f)] = f
    share = len(toxic) / (len(toxic) + len(clean) + 1)

    def documents(docs: list[np.ndarray]) -> np.ndarray:
        n = np.zeros(FORMS + 1, np.int64)
        for d in docs:
            n[np.unique(own[np.unique(d)])] += 1
        n[FORMS] = 0
        return n

    a, b = documents(toxic), documents(clean)
    limit = math.log(chance / (np.count_nonzero(a) + 1))

    def uneven(n: int, m: int) -> bool:  # by the first term of the binomial tail
        tail = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) + n * math.log(share) + m * math.log(1 - share)
        return n / len(toxic) >= 20 * (m + 0.5) / (len(clean) + 1) and tail < limit

    around: dict[int, set[tuple[int, int]]] = {f: set() for f in np.flatnonzero(a).tolist() if uneven(int(a[f]), int(b[f]))}
    possible = np.zeros(FORMS + 1, bool)
    possible[list(around)] = True
    fresh: Counter = Counter()
    for d in toxic:
        here: dict[int, set[tuple[int, int]]] = {}
        for i in np.flatnonzero(possible[own[d]].any(axis=1)).tolist():
            pair = (int(d[i - 1]) if i else 0, int(d[i + 1]) if i + 1 < len(d) else 0)
            for f in own[d[i]].tolist():
                if f in around:
                    here.setdefault(f, set()).add(pair)
        for f, pairs in here.items():
            fresh[f] += around[f].isdisjoint(pairs)
            around[f] |= pairs
    found = {f for f in around if uneven(fresh[f], int(b[f]))}
    possible[:] = False
    possible[list(found)] = True
    rows = np.flatnonzero(possible[own].any(axis=1)).tolist()
    return {x for n in rows for x in forms(names[n]) if zlib.crc32(x.encode()) % FORMS in found}


@dataclass
class Tokens:
    """Documents as numbers of words, one after the other."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(docs: list[np.ndarray]) -> Tokens:
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        return Tokens(np.concatenate([*docs, np.zeros(WINDOW, np.int32)]), np.cumsum(lengths) - lengths, lengths)

    def windows(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words of the windows that start at places of documents; past a document's end word 0."""
        place = at[:, None] + np.arange(WINDOW)
        return np.where(place < self.lengths[doc][:, None], self.words[np.minimum(self.starts[doc][:, None] + place, len(self.words) - 1)], 0)


def fit(words: Vocabulary, toxic: list[np.ndarray], clean: list[np.ndarray], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Fit the field to documents of known label by AdaGrad on the exact gradient of windows.

    Documents are numbers of words. Token labels come from the documents'
    labels: tokens of clean documents are clean; in toxic documents the marked
    tokens (`marks_of`) are toxic. Toxic documents without a marked token are
    left out. Each round reads the next windows of each clean document, round and
    round, and the windows around the next marked tokens of each toxic one: one
    window and four tokens, and as many more of a long document as it takes to
    read all of it within the rounds.
    """
    marks = marks_of(words, toxic, clean)
    marked = np.array([any(f in marks for f in forms(w)) for w in words])
    bad, good = Tokens.of(toxic), Tokens.of(clean)
    places = np.flatnonzero(marked[bad.words[: int(bad.lengths.sum())]])
    doc = np.searchsorted(bad.starts, places, "right") - 1
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if not len(places):
        weights[_h("bias")] = -6.0
        return Field(weights.astype(np.float32), moves)
    features = np.full((len(words), MOST_FEATURES), WIDTH, dtype=np.int32)
    for n, w in enumerate(words):
        f = own_features(w)
        features[n, : len(f)] = f
    first = np.searchsorted(doc, doc)  # of each mark the number of its document's first mark
    nth, of_doc = np.arange(len(doc)) - first, np.bincount(doc)[doc]
    at = np.maximum(0, places - bad.starts[doc] - WINDOW // 2)
    count = -(-good.lengths // WINDOW)
    per_turn = -(-count // rounds)  # windows of a document in a round
    every = np.repeat(np.arange(len(count)), per_turn)
    nth_window = np.arange(len(every)) - np.repeat(np.cumsum(per_turn) - per_turn, per_turn)
    marks_per_turn = np.maximum(4, -(-of_doc // rounds))
    weights = np.zeros(WIDTH + 1)
    weights[_h("bias")] = -2.0
    square, square_m = np.full(WIDTH + 1, 1e-8), np.full((2, 2), 1e-8)
    for turn in range(rounds):
        chosen = (nth - marks_per_turn * turn) % of_doc < marks_per_turn
        x_bad = bad.windows(doc[chosen], at[chosen])
        x_good = good.windows(every, (turn * per_turn[every] + nth_window) % count[every] * WINDOW)
        flat = features[np.concatenate([x_bad, x_good]).ravel()]
        y = np.concatenate([marked[x_bad], np.zeros(x_good.shape, bool)]).astype(float)
        u = np.clip(weights[flat].sum(axis=1).reshape(y.shape), -MOST, MOST)
        p, expected = _expect(u, moves)
        g = np.bincount(flat.ravel(), ((y - p).ravel() / len(y)).repeat(MOST_FEATURES), WIDTH + 1)
        used = np.unique(flat)
        g[used] -= decay * weights[used]
        g[WIDTH] = 0.0
        square += g * g
        weights += rate * g / np.sqrt(square)
        pairs = np.array([[((y[:, :-1] == s) & (y[:, 1:] == t)).sum() for t in (0, 1)] for s in (0, 1)])
        gm = (pairs - expected) / len(y) - decay * moves
        square_m += gm * gm
        moves = moves + 0.2 * gm / np.sqrt(square_m)
    return Field(weights[:WIDTH].astype(np.float32), moves)


def _expect(u: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and expected numbers of moves, for rows of scores."""
    (oo, ot), (to, tt) = np.exp(moves)
    g = np.exp(u)
    n = u.shape[1]
    forward, back = np.empty_like(u), np.ones_like(u)
    forward[:, 0] = g[:, 0]
    for t in range(1, n):
        forward[:, t] = g[:, t] * (forward[:, t - 1] * tt + ot) / (forward[:, t - 1] * to + oo)
    for t in range(n - 2, -1, -1):
        x = g[:, t + 1] * back[:, t + 1]
        back[:, t] = (to + tt * x) / (oo + ot * x)
    odds = forward * back
    f, x = forward[:, :-1], (g * back)[:, 1:]
    joint = np.stack([np.full_like(f, oo), ot * x, to * f, tt * f * x])
    joint /= joint.sum(axis=0)
    return odds / (1 + odds), joint.sum(axis=(1, 2)).reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 12_000) -> Field:
    """Fit to a bounded sample of labelled rows (doc_id, toxic).

    The sample holds `toxic` and `clean` labelled documents at most, chosen by a
    hash of doc_id, so how many come to the driver does not grow with the
    input; each comes whole. A doc_id labelled both ways counts as toxic; of
    several texts of one doc_id the smallest is taken. Without labels of both
    classes every token is clean.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity sample"))
    sizes = {r[0]: r[1] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    part = F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20))  # thins a large table before it is sorted
    drawn = [
        known.where(F.col("toxic") == y).where(part < min(1.0, (1.2 * n + 1000) / sizes.get(y, 1))).orderBy(part, order, "doc_id").limit(n)
        for y, n in ((1, toxic), (0, clean))
    ]
    ids = drawn[0].unionByName(drawn[1])
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    words, found = Vocabulary(), {}
    for doc_id, label, text in rows.toLocalIterator():  # texts pass, numbers of words stay
        if tokens := WORD.findall(text.lower()):
            found[doc_id] = (label, words.ids(tokens))
    split = [[ids for _, (label, ids) in sorted(found.items()) if label == y] for y in (0, 1)]
    return fit(words, split[1], split[0]) if split[0] and split[1] else fit(words, [], [])


_OUT = "doc_id long, score double, spans array<struct<start:int,end:int,probability:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def _tag(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Field(*shared.value))
        for batch in batches:
            found = [tag(scorer, t.as_py()) for t in batch.column("text")]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, _SPANS)], names=["doc_id", "score", "spans"])

    return run


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and toxic spans (character offsets) of every document.

    Null and empty texts, and texts without letters, score 0. Texts are read
    whole, and only the text decides. Rows are independent: repeated rows give
    repeated results, a null doc_id stays null, other columns are not read, an
    empty table gives an empty result. The field is broadcast; it has a fixed
    size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))
    return docs.select("doc_id", "text").mapInArrow(_tag(shared), _OUT)


def with_score(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of docs and score; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Field(*shared.value))
        for batch in batches:
            found = [tag(scorer, t.as_py(), 2.0)[0] for t in batch.column("text")]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    docs = docs.drop("score")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: remainder 1 to 4."""
    return labels.where(F.coalesce(remainder("doc_id", 5), F.lit(0)) != 0).select("doc_id", "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learned from the labels not held out; odd rows as in score_documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_documents(docs, train(docs, training_labels(labels)))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
