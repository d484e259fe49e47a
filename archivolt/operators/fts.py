"""Full-text search for Spanish: stems, prefix matches, cover density, word similarity."""

from __future__ import annotations

import itertools
import re
from collections import OrderedDict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from archivolt.functions import text as tx
from archivolt.functions import vector
from archivolt.operators.retrieval import top
from archivolt.operators.similar import nearest

LEXEMES = ArrayType(StructType([StructField("lexeme", StringType()), StructField("position", IntegerType())]))
WORD = re.compile(r"\w+")
VOWELS = "aeiouáéíóúü"
# Suffixes of the Snowball stemmer for Spanish.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
STANDARD = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
    "log": "logía logías".split(),
    "u": "ución uciones".split(),
    "ente": "encia encias".split(),
    "mente": "amente mente".split(),
    "idad": "idad idades".split(),
    "iva": "iva ivo ivas ivos".split(),
}
VERB_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERB_EN = "en es éis emos".split()
VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás "
    "iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido "
    "ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos "
    "íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó".split()
ACUTE = str.maketrans("áéíóú", "aeiou")
# Frequent words that are not indexed.
STOP = set(
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me "
    "hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él "
    "tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros es son fue ser ha".split()
)


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of the regions RV, R1 and R2."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    rv = len(w)
    if len(w) > 2:
        if w[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
        elif w[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
        else:
            rv = 3
    r1 = after(0)
    return rv, r1, after(r1) if r1 < len(w) else len(w)


def _longest(w: str, suffixes: list[str], start: int) -> str:
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem by the published Snowball rules for Spanish."""
    w = word.lower()
    rv, r1, r2 = _regions(w)
    pronoun = _longest(w, PRONOUNS, rv)
    if pronoun:
        body = w[: len(w) - len(pronoun)]
        gerund = _longest(body, ["iéndo", "ándo", "ár", "ér", "ír"], rv)
        if gerund:
            w = body[: len(body) - len(gerund)] + gerund.translate(ACUTE)
        elif _longest(body, ["ando", "iendo", "ar", "er", "ir"], rv) or (body.endswith("uyendo") and len(body) - 5 >= rv):
            w = body
    before = w
    w = _standard(w, r1, r2)
    if w == before:
        s = _longest(w, VERB_Y, rv)
        if s and w[: len(w) - len(s)].endswith("u"):
            w = w[: len(w) - len(s)]
        else:
            s = _longest(w, VERB_EN + VERB, rv)
            if s:
                w = w[: len(w) - len(s)]
                if s in VERB_EN and w.endswith("gu"):
                    w = w[:-1]
    s = _longest(w, RESIDUAL, rv)
    if s:
        w = w[: len(w) - len(s)]
    elif w.endswith(("e", "é")) and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACUTE)


def _standard(w: str, r1: int, r2: int) -> str:
    kinds = [(s, k) for k, ss in STANDARD.items() for s in ss if w.endswith(s)]
    if not kinds:
        return w
    s, kind = max(kinds, key=lambda x: len(x[0]))
    cut = len(w) - len(s)

    def drop(v: str, *ends: str) -> str:
        for e in ends:
            if v.endswith(e) and len(v) - len(e) >= r2:
                return v[: len(v) - len(e)]
        return v

    if s == "amente":
        if cut < r1:
            return w
        v = w[:cut]
        shorter = drop(v, "iv")
        return drop(shorter, "at") if shorter != v else drop(v, "os", "ic", "ad")
    if cut < r2:
        return w
    v = w[:cut]
    if kind == "ic":
        return drop(v, "ic")
    if kind == "log":
        return v + "log"
    if kind == "u":
        return v + "u"
    if kind == "ente":
        return v + "ente"
    if kind == "mente":
        return drop(v, "ante", "able", "ible")
    if kind == "idad":
        return drop(v, "abil", "ic", "iv")
    if kind == "iva":
        return drop(v, "at")
    return v


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """(stem, position) of the words that are indexed; positions count all words from 1."""
    return [(stem(w), n) for n, w in enumerate(WORD.findall((text or "").lower()), 1) if w not in STOP]


def cover_density(positions: dict[str, list[int]], terms: list[str]) -> float:
    """Sum over the shortest covers of all terms present of 1 / length (Clarke, Cormack and Tudhope)."""
    marks = sorted((p, t) for t in set(terms) for p in positions.get(t, []))
    need = {t for _, t in marks}
    if not need:
        return 0.0
    total, last, left = 0.0, {}, -1
    for p, t in marks:
        last[t] = p
        if len(last) == len(need):
            start = min(last.values())
            if start > left:
                total += 1.0 / (p - start + 1)
                left = start
    return total


@F.pandas_udf(LEXEMES)
def to_lexemes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"lexeme": x, "position": p} for x, p in lexemes(t)])


@F.pandas_udf(ArrayType(StringType()))
def to_stems(terms: pd.Series) -> pd.Series:
    return terms.map(lambda ts: sorted({stem(t.lower()) for t in ts}))


@F.pandas_udf(DoubleType())
def density(marks: pd.Series) -> pd.Series:
    """Cover density of (stem, position) marks."""

    def one(found) -> float:
        places: dict[str, list[int]] = {}
        for m in found:
            places.setdefault(m["stem"], []).append(m["position"])
        return cover_density(places, list(places))

    return marks.map(one).astype(float)


def index(chunks: DataFrame) -> DataFrame:
    """Postings (lexeme, chunk_id, positions) of all chunks, to be stored once."""
    each = chunks.select("chunk_id", F.explode(to_lexemes("content")).alias("l"))
    return each.groupBy(F.col("l.lexeme").alias("lexeme"), "chunk_id").agg(F.sort_array(F.collect_list("l.position")).alias("positions"))


def matches(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, density) of chunks with a lexeme that starts with a query term's stem.

    The vocabulary's prefixes meet the stems by hash; postings are joined by
    lexeme. queries has query_id and terms.
    """
    asked = queries.select("query_id", F.explode(to_stems("terms")).alias("stem"))
    vocabulary = postings.select("lexeme").distinct()
    lengths = F.sequence(F.lit(1), F.length("lexeme"))
    prefixes = vocabulary.where("lexeme <> ''").select("lexeme", F.explode(F.transform(lengths, lambda n: F.substring(F.col("lexeme"), F.lit(1), n))).alias("stem"))
    wanted = prefixes.join(asked, "stem").select("query_id", "lexeme", "stem")
    marks = postings.join(wanted, "lexeme").select("query_id", "chunk_id", "stem", F.explode("positions").alias("position"))
    return marks.groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("stem", "position")).alias("m")).select("query_id", "chunk_id", density("m").alias("density"))


def _grams(text: str) -> list[str]:
    return [g for w in WORD.findall(text.lower()) for p in [f"  {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]


def word_similarity(query: str, text: str | None) -> float:
    """Greatest similarity of the query's trigrams with those of any run of the text.

    A run opens and closes with a trigram of the query; its similarity is the
    number of query trigrams in it over the number of trigrams in either. One
    sweep keeps the trigrams met in order of their last places: a run that ends
    here holds just the latest of them, and one of more than three times the
    query's is no better than a third.
    """
    q = set(_grams(query))
    recent: OrderedDict[str, None] = OrderedDict()
    best, most = 0.0, 3 * len(q)
    for g in _grams(text or ""):
        recent[g] = None
        recent.move_to_end(g)
        if g not in q:
            continue
        met = 0
        for n, x in enumerate(itertools.islice(reversed(recent), most), 1):
            if x in q:
                met += 1
                best = max(best, met / (len(q) + n - met))
    return best


@F.pandas_udf(DoubleType())
def word_similarity_of(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([word_similarity(q or "", t) for q, t in zip(query, text, strict=True)], dtype=float)


def _judge(least: float):
    """Density of a text with a word that starts with a term's stem, 0 of one that is only word-similar, None of others."""

    def judge(question: tuple, low: str, common: int, of: int) -> float | None:
        _, text, terms = question
        stems, places = {stem(t.lower()) for t in terms} - {""}, {}
        for lexeme, position in lexemes(low):
            for s in stems:
                if lexeme.startswith(s):
                    places.setdefault(s, []).append(position)
        if places:
            return cover_density(places, list(places))
        return 0.0 if common and common >= least * of and word_similarity(text, low) >= least else None

    return judge


def text_leg(chunks: DataFrame, queries: DataFrame, k: int, least: float = 0.6, postings: DataFrame | None = None) -> DataFrame:
    """Chunks that match any stemmed prefix term or are word-similar, by trigram similarity and cover density.

    chunks: chunk_id, content; queries: query_id, query_text, a stated set.
    postings is the stored index. Without it one pass over the texts finds the
    hits (`similar.nearest`), and words are stemmed only in texts similar enough
    to be among the k. With it, word similarity is computed only where enough
    trigrams are shared for it, which a hash join of the trigrams counts.
    """
    if postings is None:
        found = nearest(chunks, queries, k, _judge(least))
        return top(found, k, F.desc("similarity"), F.desc("density"), F.asc("chunk_id"))
    q = queries.select("query_id", "query_text", tx.query_terms(F.lower("query_text")).alias("terms"), vector.trigrams(F.col("query_text")).alias("_q"))
    grams = chunks.select("chunk_id", "content", vector.trigrams(F.col("content")).alias("_c"))
    asked = q.select("query_id", F.size("_q").alias("_n"), F.explode("_q").alias("_g"))
    shared = grams.select("chunk_id", F.explode("_c").alias("_g")).join(asked, "_g").groupBy("query_id", "chunk_id", "_n").agg(F.count("*").alias("_k"))
    enough = shared.where(F.col("_k") >= least * F.col("_n")).join(chunks.select("chunk_id", "content"), "chunk_id").join(q.select("query_id", "query_text"), "query_id")
    similar = enough.where(word_similarity_of("query_text", "content") >= least).select("query_id", "chunk_id", F.lit(0.0).alias("density"))
    met = matches(postings, q).unionByName(similar).groupBy("query_id", "chunk_id").agg(F.max("density").alias("density"))
    scored = met.join(grams, "chunk_id").join(q, "query_id")
    scored = scored.select("query_id", "chunk_id", vector.trigram_similarity(F.col("_c"), F.col("_q")).alias("similarity"), "density")
    return top(scored, k, F.desc("similarity"), F.desc("density"), F.asc("chunk_id"))
