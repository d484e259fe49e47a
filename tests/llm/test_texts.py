"""Coding, packing, licenses, languages, toxicity: against plain versions and on odd rows."""

import hashlib
import random
import re._constants as _c
import re._parser as _parser
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from archivolt.llm import bpe, langid, licenses, packing, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACK = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'ll", "é", "中", "文", "。", "1", "23", ".", "--", "\t", "　", "ß", "\U0001f642", "\x1c", "x", "\r\n", "<|endoftext|>"]


def noise(r: random.Random, n: int) -> str:
    return "".join(r.choice(BITS) for _ in range(r.randint(0, n))) + r.choice(BITS) * r.randint(0, 80)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("leaf", [8, 32])
def test_tree_encoding_is_the_librarys(leaf):
    codec, r = bpe.Codec(RANKS, leaf), random.Random(leaf)
    for _ in range(800):
        t = noise(r, 200)
        ids = codec.encode(t)
        assert ids == codec.encoding.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_joins_make_the_tokens_of_nearly_all_texts(spark):
    """At the production leaf: texts of a sentence or more are joined at seams, and long runs inside a match."""
    codec = bpe.Codec(RANKS)
    some = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if t][:400]
    joined = 0
    for t in [*some, "文" * 300 + "化" * 300, "ab" * 900]:
        before = codec.joins
        assert codec.encode(t) == codec.encoding.encode_ordinary(t)
        joined += codec.joins > before
        assert codec.joins - before >= len(t) // 48 - 1
    assert joined > 0.95 * len(some) and codec.run_joins > 5


@pytest.mark.parametrize("run", ["a" * 40_000, "ab" * 20_000 + " x", "中文" * 10_000, "7" * 20_000, "-=" * 10_000, " " * 9_000])
def test_long_runs_are_joined_inside(run):
    codec = bpe.Codec(RANKS)
    assert codec.encode(run) == codec.encoding.encode_ordinary(run)


def test_op1_rows(odd, none):
    plain = bpe.Codec(RANKS).encoding
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd, RANKS).collect())
    want = Counter()
    for i, t in texts(odd):
        ids = plain.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_documents(none, RANKS).count() == 0


def test_chunked_ids_are_the_tokenizers():
    mine, theirs, r = packing.Tokens(PACK), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    for _ in range(800):
        t = noise(r, 80)
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_op2_rows(odd, none):
    mine = packing.Tokens(PACK)
    rows = packing.pack_documents(odd, PACK).collect()
    want = Counter()
    for i, t in texts(odd):
        ids = np.frombuffer(mine.ids(t or ""), "<u4").tolist() + [2]
        for n, (s, k) in enumerate(packing.cut(len(ids), 1024)):
            want[i, n, s, k, zlib.crc32(np.array(ids[s : s + k], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, PACK).count() == 0


def test_packing_is_tight_and_bounded():
    r = random.Random(1)
    sizes = sorted((r.randint(1, 1024) for _ in range(20_000)), reverse=True)
    bins, offsets = packing.pack(sizes, 1024, 65536)
    assert max(bins) + 1 <= 1.005 * sum(sizes) / 1024
    fit = packing.BestFit(1024, 8)
    for n in range(100):
        bin_, offset = fit.place(600)
        assert bin_ is None
        fit.put(n, 424 - n % 7)
        assert fit.count <= 8
    assert packing.pack([1024, 1, 1023], 1024, 4) == ([0, 1, 1], [0, 0, 1])


def test_open_bins_close_in_production():
    """The bound is far below a task's pieces and binds, at little cost."""
    r = np.random.default_rng(1)
    sizes = np.minimum(1024, r.exponential(500, 30_000).astype(int) + 1)
    packer = packing.Packer(1024, 512, 2048)
    bins, offsets = packer.place(sizes)
    assert packer.fit.closed > 100 and packer.fit.count <= 512
    assert bins.max() + 1 <= 1.01 * sizes.sum() / 1024
    used = np.bincount(bins, sizes)
    assert used.max() <= 1024 and (offsets + sizes <= 1024).all()


def base(text):
    words = [w for w in (text or "").encode().translate(licenses.WORDS).decode().split(" ") if w]
    at = [(i, label) for label, p in licenses.BASE.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_op5_base_is_exact(spark, odd, none):
    r = random.Random(2)
    parts = "mit MIT license License, apache general public gpl the ñ 2 - é\n".split(" ")
    made = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_documents(df).collect())
    assert got == Counter((i, *base(t)) for i, t in texts(df))
    for row in licenses.scan_documents(df).collect():
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert licenses.scan_documents(none).count() == 0


def test_contained_detections_give_way():
    found = licenses.scan("This is licensed under the GNU Lesser General Public License, version 2.1")
    assert found["labels"] == "gpl,lgpl-2.1" and [s["label"] for s in found["spans"]] == ["lgpl-2.1"]
    assert licenses.scan("SPDX-License-Identifier: Apache-2.0")["labels"] == "apache-2.0"
    assert licenses.scan("Licensed under CC BY-NC-SA 4.0")["labels"] == "cc-by-nc-sa-4.0"
    assert len(licenses.rules()) > 300


def test_the_prefilter_loses_nothing(spark):
    """Keywords admit every rule that matches: on real texts, on samples of all rules, and on their mixtures."""
    r = random.Random(6)
    samples = [sample(rule.pattern.pattern, r) for rule in licenses.rules() for _ in range(4)]
    for rule in licenses.rules():
        made = [f" {sample(rule.pattern.pattern, r)} " for _ in range(30)]
        assert all(rule.pattern.search(t) and any(k in t for k in rule.keywords) for t in made), (rule.label, made)
    grants = ["distributed under the GPL 2.0", "released under the MIT", "published under CC BY-SA 4.0", "available under cc by 4.0", "shared under the terms of the Apache 2.0"]
    assert [licenses.scan(t)["labels"] for t in grants] == ["gpl-2.0", "mit", "cc-by-sa-4.0", "cc-by-4.0", "apache-2.0"]
    texts_ = samples + grants + [" ".join(r.sample(samples, 3)) for _ in range(300)]
    texts_ += [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:3000]
    found = 0
    for t in texts_:
        words = (t or "").encode().translate(licenses.WORDS).split()
        every = licenses.detect(b" ".join(words).decode())
        got = licenses.scan(t)
        base_ = set(filter(None, got["base_labels"].split(",")))
        assert got["labels"] == ",".join(sorted(base_ | {d.label for d in every}))
        found += bool(every)
    assert found > 1500


def sample(pattern: str, r: random.Random) -> str:
    """A text that a rule's pattern matches, each choice and option drawn."""

    def draw(node) -> str:
        out = ""
        for op, arg in node:
            if op is _c.LITERAL:
                out += chr(arg)
            elif op is _c.IN:
                out += "x" if arg[0][0] is _c.CATEGORY else chr(r.choice([c for _, c in arg]))
            elif op is _c.MAX_REPEAT:
                low, high, part = arg
                out += "".join(draw(part) for _ in range(r.randint(low, min(high, low + 2))))
            elif op is _c.SUBPATTERN:
                out += draw(arg[3])
            elif op is _c.BRANCH:
                out += draw(r.choice(arg[1]))
            else:
                assert op in (_c.ASSERT, _c.ASSERT_NOT)
        return out

    return draw(_parser.parse(pattern))


SF = "/root/testdata/sf0.1"


def test_op8_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op8_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right > 0.99 and n > 2000 and 0 <= low and high <= 1


def test_languages_of_odd_rows(odd, none):
    model = langid.train(langid.labelled(odd))
    got = langid.identify(odd, model).collect()
    letters = {i: any(c.isalpha() for c in t or "") for i, t in texts(odd)}
    assert len(got) == 15 and all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got if r.doc_id is not None)
    assert langid.with_language(odd, model).columns.count("lang_pred") == 1
    assert {r.lang_pred for r in langid.identify(odd, langid.train(langid.labelled(none))).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_texts_of_no_learned_language_go(spark):
    """Other scripts and random letters are rejected by the pipeline's stage; all texts of the learned languages stay."""
    folder = SF.replace("sf0.1", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    strange = ["привет как дела это другой язык " * 3, "中文字符测试文本", "xqzv kjwq zzxv qqkj wvxz " * 4]
    more = spark.createDataFrame([(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], docs.schema)
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(more), folder).collect()
    letters = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(r.doc_id for r in kept) == sorted(letters)


def test_every_language_with_a_label_is_learned(spark):
    r = random.Random(8)
    alphabets = ["".join(chr(0x4E00 + 40 * n + i) for i in range(12)) for n in range(230)]
    rows = [(n * 4 + k, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(12)), f"l{n:03}") for n, a in enumerate(alphabets) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = langid.identify(df, model).join(df, "doc_id").where("lang = lang_pred").count()
    assert len(model.languages) == 230 and got > 0.95 * len(rows)


def test_mixtures_are_resolved():
    counts = np.zeros((2, langid.BUCKETS))
    a, b = "uno dos tres cuatro cinco seis", "one two three four five six"
    for row, t in enumerate((a, b)):
        np.add.at(counts[row], langid.grams(t * 50), 1)
    model = langid.Model.fit(["es", "en"], counts)
    both = langid.mixture(model, (a + " ") * 20 + (b + " ") * 10)
    assert list(both) == ["es", "en"] and abs(sum(both.values()) - 1) < 1e-3
    assert list(langid.mixture(model, a)) == ["es"] and langid.mixture(model, "12 !") == {}


def test_mixtures_are_those_of_plain_em(spark):
    """On documents of four languages and mixtures of two: the proportions of a plain EM over the languages that are chosen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.labelled(docs))
    some = [t for (t,) in docs.where("length(text) between 200 and 3000").select("text").limit(60).collect()]
    some += [a[:600] + " " + b[:900] for a, b in zip(some[:20], some[20:40], strict=True)]
    for text in some:
        got = langid.mixture(model, text)
        at = [model.languages.index(x) for x in got]
        weight = {i: 1 / len(at) for i in at}
        codes = langid.grams(text).tolist()
        for _ in range(200):
            shares = Counter()
            for c in codes:
                p = {i: weight[i] * float(model.likelihood[c, i]) for i in at}
                total = sum(p.values())
                for i in at:
                    shares[i] += p[i] / total
            weight = {i: shares[i] / len(codes) for i in at}
            if len(at) == 1:
                break
        assert all(abs(weight[model.languages.index(x)] - w) < 0.02 for x, w in got.items())


def made_corpus(spark):
    r = random.Random(3)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words = [r.choice(common) for _ in range(r.randint(30, 80))]
        bad = i % 6 == 0
        if bad:
            for w in r.sample(["grumble", "snarkish", "vilextra", "vilexter"], 2):
                words.insert(r.randint(0, len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_op9_finds_marked_words(spark, odd, none):
    docs, labels = made_corpus(spark)
    field = toxicity.train(docs, toxicity.training_labels(labels))
    got = toxicity.score_documents(docs, field).join(labels, "doc_id").collect()
    wrong = sum((r.score >= 0.5) != bool(r.toxic) for r in got)
    assert wrong <= 12
    text = dict(texts(docs))
    cut = {text[r.doc_id][s.start : s.end] for r in got for s in r.spans}
    assert cut & {"grumble", "snarkish"} and all(any(w in c for w in ("grumble", "snarkish", "vilex")) for c in cut)
    assert toxicity.tag(toxicity.Scorer(field), "un VILEXTON aqui")[1][0][:2] == (3, 11)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(odd, field).collect()}
    assert scores[4] == scores[5] == scores[6] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.with_score(odd, field).count() == 15 and toxicity.score_documents(none, field).count() == 0


def test_without_labels_all_is_clean(spark, odd):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    field = toxicity.train(odd, nothing)
    assert max(r.score for r in toxicity.score_documents(odd, field).collect()) < 0.5


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1, np.float32), r.normal(size=(2, 2)))
    scores = r.normal(size=6)
    p = field.marginals(np.exp(scores).tolist())
    weight, on = 0.0, np.zeros(6)
    for bits in range(64):
        y = [(bits >> t) & 1 for t in range(6)]
        w = np.exp(sum(s for s, b in zip(scores, y) if b) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        weight += w
        on += w * np.array(y)
    assert np.allclose(p, on / weight)
    batch, moves = toxicity._expect(scores[None, :], field.moves)
    assert np.allclose(batch[0], p) and abs(moves.sum() - 5) < 1e-9


def test_grants_need_no_word_license():
    """The sample of each grant rule, without the word license."""
    assert licenses.scan("This program is distributed under the GNU GPL v3")["labels"] == "gpl-3.0"
    assert licenses.scan("released under the MIT")["labels"] == "mit"
    assert licenses.scan("available under Apache 2.0")["labels"] == "apache-2.0"
    assert licenses.scan("published under CC BY 4.0")["labels"] == "cc-by-4.0"
    for text in ("It is shared under BSD", "provided under the terms of the MPL 2.0 here", "under the sea", "a plain text"):
        plain = " ".join(text.lower().replace(".", " ").split())
        assert licenses.scan(text)["labels"] == ",".join(sorted({d.label for d in licenses.detect(plain)}))
    assert licenses.scan("It is shared under BSD")["score"] == 0.75


def test_op9_held_out_figures(spark):
    """On rows held out of the fit: of 97 toxic ones 6 have no marked word at all (their labels are noise)."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    caught, toxic, left, clean = got.agg(*[F.sum((F.col("toxic") == y).cast("int") * (F.col("predicted") == p).cast("int")) for y, p in ((1, 1),)], F.sum(F.col("toxic")), F.sum(((F.col("toxic") == 0) & (F.col("predicted") == 0)).cast("int")), F.sum(1 - F.col("toxic"))).first()
    assert caught / toxic >= 0.92 and left / clean >= 0.98


def test_op9_takes_repeated_and_very_long_documents(spark):
    """Texts of one doc_id, both orders of rows, and a text far longer than any other give one field."""
    docs, labels = made_corpus(spark)
    more = docs.where("doc_id < 50").withColumn("text", F.concat(F.lit("zz "), "text")).union(spark.createDataFrame([(7, "word " * 60_000)], docs.schema))
    a = toxicity.train(docs.union(more), toxicity.training_labels(labels))
    b = toxicity.train(more.union(docs.orderBy(F.desc("doc_id"))), toxicity.training_labels(labels))
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()


def test_copies_are_no_evidence():
    """A word in thirty copies of one toxic document marks nothing; one in thirty different ones does."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = [r.choice(words) for _ in range(60)]
    copies = [text[:20] + ["rareword"] + text[20 : 50 + i % 10] for i in range(30)]
    others = [[r.choice(words) for _ in range(20)] + ["nastyword"] + [r.choice(words) for _ in range(20)] for _ in range(30)]
    clean = [[r.choice(words) for _ in range(60)] for _ in range(600)]
    marks = toxicity.seeds(copies + others, clean)
    assert "wnastyword" in marks and "wrareword" not in marks
