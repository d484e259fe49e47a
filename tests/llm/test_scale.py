"""Long texts and large groups: what grew with a square grows no more, and nothing is cut."""

import random
import time

import numpy as np

from archivolt.llm import licenses, simhash, toxicity

from .conftest import prose


def test_detections_against_all_pairs():
    r = random.Random(6)
    parts = "mit license apache license version 2 0 gnu general public license version 3 or later bsd 3 clause the of licensed under".split()
    for _ in range(60):
        words = " ".join(r.choice(parts) for _ in range(r.randint(1, 120)))
        padded = f" {words} "
        found = sorted((-x.priority, m.start() - m.end(), n, m.start(), m.end(), x.label) for n, x in enumerate(licenses.rules()) for m in x.pattern.finditer(padded))
        want: list[tuple] = []
        for p, _, _, start, end, label in found:
            if not any(a <= start and end <= b for _, a, b, _ in want):
                want.append((label, start, end, -p))
        got = licenses.detect(words)
        assert [(d.label, d.start, d.end, d.priority) for d in got] == want
        spans = licenses.scan(words)["spans"]
        assert [(s["label"], s["first"], s["words"]) for s in spans] == [(d.label, padded.count(" ", 0, d.start) - 1, padded.count(" ", d.start, d.end) + 1) for d in got]


def test_license_lines_of_two_megabytes():
    start = time.time()
    row = licenses.scan("mit license " * 170_000)
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (340_000, 170_000, 0, 339_998)
    assert time.time() - start < 20  # about 2 seconds on a machine with nothing else to do


def plain_groups(sets, side, similarity):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if (side is None or side[i] != side[j]) and (len(a & b) / len(a | b) if a | b else 1.0) >= similarity:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_similar_sets_against_all_pairs():
    r = np.random.default_rng(3)
    for trial in range(40):
        base = [r.choice(400, r.integers(0, 40), replace=False) for _ in range(12)]
        sets = []
        for x in base:
            for _ in range(4):
                y = np.concatenate([x[r.random(len(x)) > 0.08], r.choice(400, r.integers(0, 3))])
                sets.append(np.unique(y).astype(np.uint64))
        side = None if trial % 2 else r.random(len(sets)) > 0.5
        for similarity in (0.8, 0.5):
            got = list(range(len(sets)))
            edges = simhash.similar_edges(sets, side, similarity)
            for a, b in edges:
                got = [got[a] if g == got[b] else g for g in got]
            assert same_partition(got, plain_groups(sets, side, similarity)) and len(edges) == len(sets) - len(set(got))
    assert simhash.similar_edges([], None, 0.8) == []


def test_texts_of_one_template_are_not_compared_with_all(monkeypatch):
    r = random.Random(8)
    shared = [f"word{k}" for k in range(45)]
    sets = [simhash.shingle_set(" ".join(shared + [f"own{r.random()}" for _ in range(15)])) for _ in range(800)]
    sets += [sets[0], simhash.shingle_set(" ".join(shared + [f"own{k}" for k in range(15)])), simhash.shingle_set(" ".join(shared + [f"own{k}" for k in range(15)] + ["end"]))]
    calls = []
    real = simhash.jaccard
    monkeypatch.setattr(simhash, "jaccard", lambda a, b: calls.append(1) or real(a, b))
    assert sorted(simhash.similar_edges(sets, None, 0.8)) == [(0, 800), (801, 802)] and len(calls) < 20


def test_every_window_of_long_labelled_texts_is_read(monkeypatch):
    r = random.Random(2)
    clean = [prose(k, n) for k, n in enumerate([10_000, 15, 16, 17, 900, 2_000] + 400 * [20])]
    toxic = [" ".join(prose(100 + k, 5).split() + ["nastyword"] + prose(200 + k, 5).split()) for k in range(40)] + [" ".join(["nastyword", r.choice("ab")] * 500)]
    words = toxicity.Vocabulary()
    numbers = [[words.ids(toxicity.WORD.findall(t.lower())) for t in texts] for texts in (toxic, clean)]
    read = {"bad": set(), "good": set()}
    real = toxicity.Tokens.windows

    def windows(self, doc, at):
        read["good" if len(self.lengths) == len(clean) else "bad"] |= set(zip(doc.tolist(), at.tolist(), strict=True))
        return real(self, doc, at)

    monkeypatch.setattr(toxicity.Tokens, "windows", windows)
    toxicity.fit(words, numbers[0], numbers[1])
    assert read["good"] == {(d, at) for d, ids in enumerate(numbers[1]) for at in range(0, len(ids), toxicity.WINDOW)}
    assert len([1 for d, _ in read["bad"] if d == len(toxic) - 1]) > 450  # windows around all 500 marks of the last
