"""MPEG audio, the filter audit and spelling variants: against plain versions and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm import filters, mpeg, spelling

SF = "/root/testdata/sf0.001"


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# MPEG audio


def plain_crc(data):
    c = 0
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ 0xA001 if c & 1 else c >> 1
    return c


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 1000, 5001])
def test_checksums_joined_in_pairs(n):
    data = random.Random(n).randbytes(n)
    assert mpeg.music_crc(data) == mpeg.tag_crc(data) == plain_crc(data)


def test_every_payload_comes_back():
    r = random.Random(1)
    for n in (64, 128, 58, 59, 921, 922, 923, 10_000, 200_000):
        for data in (r.randbytes(n), b"\xff" * n, b"TAG" * (n // 3), b"ID3\4\0\0" * (n // 6), b"\xff\xfa\x14\0" * (n // 4), b"APETAGEX" * (n // 8)):
            media = mpeg.write(data)
            a = mpeg.read(media)
            assert a.payload == data and (a.skipped, a.resyncs, a.crc_failed) == (0, 0, 0)
            assert a.music_crc_ok and a.table.tag_crc_ok and a.table.frames == len(a.offsets) == a.checked
            assert a.samples == 1152 * len(a.offsets) and all(media[o : o + 2] == b"\xff\xfa" for o in a.offsets)


def test_damage_is_found_and_passed_over():
    data = random.Random(3).randbytes(5000)
    media = mpeg.write(data)
    whole = mpeg.read(media)
    at = whole.offsets[2]
    junk = mpeg.read(media[:at] + b"junk\xff\xfb\x90" * 5 + media[at:])
    assert (junk.skipped, junk.resyncs, junk.samples, junk.payload) == (35, 1, whole.samples, data)
    cut = mpeg.read(media[:-10])
    assert len(cut.offsets) == len(whole.offsets) - 1 and cut.skipped > 0 and cut.music_crc_ok is False
    flipped = bytearray(media)
    flipped[whole.offsets[1] + 10] ^= 1
    assert mpeg.read(bytes(flipped)).crc_failed == 1
    toc = bytearray(media)
    toc[whole.offsets[0] - 100] ^= 1
    assert mpeg.read(bytes(toc)).table.tag_crc_ok is False
    noise = mpeg.read(random.Random(4).randbytes(50_000))
    assert noise.first is None and noise.offsets == [] and noise.skipped == 50_000 and mpeg.feature(noise) == "none"
    assert mpeg.read(b"").skipped == 0


def test_tags_at_both_ends():
    media = mpeg.write(b"x" * 3000)
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + b"Someone".ljust(30, b"\0") + bytes(65)
    item = (4).to_bytes(4, "little") + bytes(4) + b"Mood\0calm"
    ape = item + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    a = mpeg.read(media + ape + v1)
    assert a.tags == [("TXXX", "payload=3000"), ("id3v1:title", "Title"), ("id3v1:artist", "Someone"), ("ape:Mood", "calm")] and a.skipped == 0
    assert mpeg.read(media[:-10] + v1).tags[1:] == [("id3v1:title", "Title"), ("id3v1:artist", "Someone")]
    body = b"TIT2" + (7).to_bytes(4, "big") + b"\0\0\1" + "añ".encode("utf-16")
    two = b"ID3\3\0\0" + mpeg.to_synchsafe(len(body) + 20) + body + bytes(20)
    assert mpeg.id3v2(two + media) == (len(two), [("TIT2", "añ")])


def stream(bits, n, body=b"\0"):
    h = mpeg.header(bits.to_bytes(4, "big"))
    return h, b"".join(bits.to_bytes(4, "big") + body * (h.length - 4) for _ in range(n))


def test_other_versions_and_layers_and_tables():
    for bits, version, layer, samples, length in ((0xFFFB9000, "1", 3, 1152, 417), (0xFFFB9200, "1", 3, 1152, 418), (0xFFF39000, "2", 3, 576, 261), (0xFFE39000, "2.5", 3, 576, 522), (0xFFFD9000, "1", 2, 1152, 522), (0xFFFF9000, "1", 1, 384, 312)):
        h, data = stream(bits, 5)
        a = mpeg.read(data)
        assert (h.version, h.layer, h.samples, h.length) == (version, layer, samples, length)
        assert a.samples == 5 * samples and a.offsets == [k * length for k in range(5)]
    for bad in (0xFFFB0000, 0xFFFBF000, 0xFFF99000, 0xFFEB9000, 0xFFFB9C00, 0xFEFB9000):
        assert mpeg.header(bad.to_bytes(4, "big")) is None
    h, data = stream(0xFFFB9000, 4)
    vbri = b"VBRI" + b"".join(v.to_bytes(k, "big") for v, k in ((1, 2), (5, 2), (0, 2), (1251, 4), (3, 4), (2, 2), (10, 2), (2, 2), (1, 2), (41, 2), (42, 2)))
    a = mpeg.read(data[:36] + vbri + data[36 + len(vbri) :])
    assert (a.table.kind, a.table.frames, a.table.toc, a.samples) == ("VBRI", 3, (410, 420), 3 * 1152)


def test_media_of_odd_rows(spark, odd, none, tmp_path):
    rows = mpeg.op11_mpeg_audio(spark, folder(tmp_path, documents=odd)).collect()
    assert len(rows) == odd.count()
    want = Counter()
    for i, t in texts_of(odd):
        raw = (t or "").encode()
        p = raw.ljust(max(64, (len(raw) + 63) // 64 * 64), b"\0")
        media = mpeg.write(p)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), mpeg.feature(mpeg.read(media))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows) == want
    assert mpeg.media_columns(mpeg.payload_media(none)).count() == 0
    other = spark.createDataFrame([(1, None, "x"), (2, bytearray(b""), "y"), (3, bytearray(b"\xff\xfb"), "z")], "id int, media binary, audio string")
    got = {r.id: r.audio for r in mpeg.media_columns(other).collect()}
    assert got[1] is None and got[2].seconds == 0.0 and got[3].frame_offsets == []


# Filter audit


def plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return len(words), len(set(words)), len(re.findall("[A-Z]", t or "")), len(re.findall(r"[#$%&*|]", t or "")), len(t or "")


def counted(texts):
    c = filters.text_counts(pa.array(texts, pa.string()))
    return list(zip(*[c[k].tolist() for k in ("words", "distinct", "capitals", "symbols", "points")], strict=True))


def test_counts_of_buffers(monkeypatch):
    r = random.Random(2)
    some = ["a b a", None, "", " \n", "a", "ab\x0bab ñ Ñ ñ", "\x1ca b\x1c\x85 b", "x" * 100] + ["".join(r.choice("ab A#ñ\n\t中") for _ in range(r.randint(0, 200))) for _ in range(600)]
    assert counted(some) == [plain_counts(t) for t in some]
    sliced = pa.array(some, pa.string()).slice(3, 50)
    assert filters.text_counts(sliced)["distinct"].tolist() == [plain_counts(t)[1] for t in some[3:53]]
    assert counted([]) == []
    big = [" ".join(r.choice(["aa", "bb", "cc"]) for _ in range(1_000_000)), "q" * 3_000_000 + " " + "q" * 3_000_000 + " z", "A B"]
    assert counted(big) == [plain_counts(t) for t in big]
    weak = filters.word_hashes
    monkeypatch.setattr(filters, "word_hashes", lambda d, s, e: weak(d, s, e) & np.uint64(3))
    assert counted(some) == [plain_counts(t) for t in some]


def plain_audit(docs, labels):
    """A loop over orders, steps and documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        fails = []
        for i, t, s in docs:
            if (s or "") != part:
                continue
            w, d, c, y, p = plain_counts(t)
            copies = [j for j, u, _ in docs if (u or "") == (t or "") and j is not None and i is not None and j < i]
            fails.append((i, {k for k, f in zip("ABCDE", (w < 200, 100 * d < 50 * w, 100 * c > 2 * p, y > 0, copies), strict=True) if f}))
        shapley, rows = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                prior = set(order[: step - 1])
                gone = [i for i, x in fails if f in x and not x & prior]
                shapley[f] += len(gone)
                rows.append((order, step, sum(not x & (prior | {f}) for _, x in fails), len(gone), sum(f in x and bool(x & prior) for _, x in fails), sum(x == {f} for _, x in fails), sum(i in good for i in gone), sum(i in toxic for i in gone), f))
        out |= {(part, *r[:2]): (*r[2:8], shapley[r[8]]) for r in rows}
    return out


def test_audit_of_odd_rows(spark, odd, none, tmp_path):
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS mask", "3 AS n")
    docs = odd.selectExpr("doc_id", "text", "CASE WHEN doc_id > 5 THEN 'web' WHEN doc_id = 2 THEN '' END AS source", "1 AS mask", "2 AS part", "3 AS digest")
    got = filters.op12_filter_audit(spark, folder(tmp_path, documents=docs, labels=labels)).collect()
    want = plain_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], marks)
    assert len(got) == len(want) == 1200
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert filters.interactions(none, labels).count() == 0
    assert filters.interactions(docs, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_audit_by_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(filters.OP12_SQL)
    got = filters.op12_filter_audit(spark, SF)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


# Spelling variants


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and distance_one(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def chain_rows():
    """Words in a chain of forms, ties, near words at every place, and a crowded shard."""
    words = {"chaining": 700, "chainin": 140, "chaininx": 28, "chinin": 5, "abcdefg": 30, "abcdefh": 30, "abcdef": 6, "ñandúes": 25, "ñandúez": 5, "Zebraic": 5, "zebraic": 26}
    words |= {"stem" + a + b: 5 for a in "abcdefghij" for b in "klmnopqrst"} | {a + "aaaaaa": 7 for a in "abcz"} | {"a" * 5: 50, "b" * 300: 6, "b" * 301: 40}
    return [(1000 + k, " ".join(w for w, n in words.items() for _ in range(n // 5)) + (" " + " ".join(w for w, n in words.items() for _ in range(n % 5)) if k == 0 else "")) for k in range(5)]


@pytest.mark.parametrize("shard", [spelling.SHARD, 7])
def test_pairs_of_words(spark, shard):
    docs = spark.createDataFrame(chain_rows(), "doc_id long, text string")
    words = spelling.vocabulary(docs)
    n = {r.word: r.n for r in words.collect()}
    want = {(a, b) for a in n for b in n if a < b and abs(len(a) - len(b)) < 2 and distance_one(a, b)}
    got = [tuple(sorted((r.a, r.b))) for r in spelling.links(words, shard).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_odd_rows(spark, odd, none, tmp_path):
    docs = odd.unionByName(spark.createDataFrame(chain_rows(), "doc_id long, text string"), allowMissingColumns=True).selectExpr("*", "1 AS word", "2 AS n", "3 AS form")
    got = {tuple(r) for r in spelling.op13_spelling(spark, folder(tmp_path, documents=docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(texts_of(docs))
    assert got == want and {r[2] for r in want if r[0] == "chinin"} == {"chaining"}
    assert spelling.variants(none).count() == 0


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in spelling.op13_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(texts_of(docs)) and len(got) > 100
