"""The class language model against plain Python: counts, moves between classes, probabilities."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aislemap.llm import class_lm as cl


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def learns(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def corpus(n=300, seed=6):
    """Two invented languages; within one, nouns and verbs take turns."""
    rng = random.Random(seed)
    nouns = [[f"{p}n{i}a" for i in range(12)] for p in "xy"]
    verbs = [[f"{p}v{i}o" for i in range(12)] for p in "xy"]
    rows = []
    for i in range(n):
        lang = rng.randrange(2)
        words = [w for _ in range(rng.randrange(1, 30)) for w in (rng.choice(nouns[lang]), rng.choice(verbs[lang]).upper())]
        if rng.random() < 0.3:
            words.insert(0, f"rare{rng.randrange(400)}q")
        rows.append((i, " ".join(words) + rng.choice(["", "\n", "\t "])))
    return rows + [(n, None), (n + 1, ""), (None, "xn1a xv1o"), (3, "xn1a again"), rows[5], (n + 2, "xn1a yv2o " * 30000), (n + 3, "w" * 100000)]


def frame(spark, rows):
    full = [(i, t, 1.0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, score double").selectExpr("*", "0L as row", "true as held_out").repartition(5)


@pytest.mark.parametrize("units,known", [(1 << 14, 1 << 17), (8, 20)])
def test_scores_are_those_of_the_formula(spark, monkeypatch, units, known):
    monkeypatch.setattr(cl, "UNITS", units)
    monkeypatch.setattr(cl, "KNOWN", known)
    monkeypatch.setattr(cl, "FAN_IN", 2)
    monkeypatch.setattr(cl, "RUN", 500)
    rows = corpus()
    docs = frame(spark, rows)
    model, vocabulary = cl.fit_class_lm(docs, classes=6, rounds=4)
    got = cl.score_class_lm(docs, model, vocabulary).collect()
    assert len(got) == len(rows)
    count = Counter()
    for i, t in rows:
        if learns(i):
            count.update([*split(t), ""])
    n, v = sum(count.values()), len(count)

    def class_of(w):
        if not w:
            return 6
        return int(model.classes[model.units.of[w.encode()] if w.encode() in model.units.of else model.units.words + cl.ending(w.encode())])

    ones, twos = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    d = ones / (ones + 2 * twos)
    class_n, types, pairs = Counter(), Counter(), Counter()
    for w, c in count.items():
        if w:
            class_n[class_of(w)] += c
            types[class_of(w)] += 1
    for i, t in rows:
        if learns(i):
            path = [6, *map(class_of, split(t)), 6]
            pairs.update(zip(path, path[1:]))
    after = Counter()
    for (a, _), c in pairs.items():
        after[a] += c
    share = {c: (class_n[c] + 1) / (sum(class_n.values()) + 7) for c in range(7)}

    def step(a, b):
        return (pairs[a, b] + share[b]) / (after[a] + 1)

    def emits(w):
        c = class_of(w)
        if not w or not class_n[c]:
            return 1.0
        return ((count[w] - d) if w in count else d * types[c]) / class_n[c]

    # the classes after any class, and the words of a class with its unseen one, have probability one
    for a in range(7):
        assert math.isclose(sum(step(a, b) for b in range(7)), 1)
    for c in range(6):
        if class_n[c]:
            assert math.isclose(sum(emits(w) for w in count if w and class_of(w) == c) + d * types[c] / class_n[c], 1)
    want = []
    for i, t in rows:
        words = split(t)
        path = [6, *map(class_of, words), 6]
        own = sum(math.log10(step(a, b)) for a, b in zip(path, path[1:])) + sum(math.log10(emits(w)) for w in words)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, ""])
        want.append((str(i), not learns(i), len(words) + 1, sum(w in count for w in [*words, ""]), n, base, own))
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for g, w in zip(sorted(((str(r[0]), *r[1:]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_classes_find_the_pattern(spark):
    rows = corpus()[:300]
    out = cl.class_lm(frame(spark, rows), classes=8, rounds=8).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.4 * sum(r["n_tokens"] for r in out)


def test_moves_are_the_best_ones():
    rng = np.random.default_rng(7)
    u = rng.integers(0, 9, 400)
    own, k = rng.integers(0, 4, 9), 4

    def matrix(classes):
        m = np.zeros((k, k))
        np.add.at(m, (classes[u[:-1]], classes[u[1:]]), 1)
        return m

    before, after, self_ = np.zeros((9, k)), np.zeros((9, k)), np.zeros(9)
    np.add.at(before, (u[1:], own[u[:-1]]), 1)
    np.add.at(after, (u[:-1], own[u[1:]]), 1)
    np.add.at(self_, u[1:][u[1:] == u[:-1]], 1)
    got = cl.best_classes(before, after, self_, own, matrix(own), k, np.ones(9, bool))
    for x in range(9):
        values = [cl.likelihood(matrix(np.where(np.arange(9) == x, c, own))) for c in range(k)]
        assert values[got[x]] == pytest.approx(max(values), abs=1e-6)


def test_empty(spark):
    assert cl.class_lm(frame(spark, []), 4, 2).count() == 0
    held = next(i for i in range(100) if not learns(i))
    row = cl.class_lm(frame(spark, [(held, "never learnt")]), 4, 2).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == pytest.approx(0) and row["score"] <= 0
