"""Near-duplicate classes against all pairs, and the sampler against its definition."""

import math
import random

import numpy as np
import pytest

from aislemap.llm.common import WordHasher, lower_words
from aislemap.llm.near_dedup import Sampler, Weights, near_duplicates, shingles, weighted_jaccard, without_near_duplicates


def expected(rows, similarity=0.8, rare=0.01):
    """Class id by row position: exact weights, all pairs, union by hand."""
    hasher = WordHasher(lower=True)
    bags = [shingles(hasher((t or "").encode())) for _, t in rows]
    counts = {}
    for found, _ in bags:
        for h in found.tolist():
            counts[h] = counts.get(h, 0) + 1
    weights = Weights([(h, n) for h, n in counts.items() if n > rare * len(rows)], len(rows), rare)
    bags = [(f, weights.of(f, c)) for f, c in bags]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = lower_words((rows[i][1] or "").encode()) == lower_words((rows[j][1] or "").encode())
            if same or (len(bags[i][0]) and len(bags[j][0]) and weighted_jaccard(bags[i], bags[j]) >= similarity):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out += [(rows[m][0], min(ids) if ids else None, len(members)) for m in members]
    return sorted(out, key=str)


def corpus(seed, copies):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    boiler = [word() for _ in range(60)]
    rows = []
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(1, 200))]
        if rng.random() < 0.3:
            words = boiler + words
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(0, 4)):
            other = list(words)
            for _ in range(rng.randrange(0, 6)):
                other[rng.randrange(len(other))] = word()
            rows.append((len(rows), "\n".join(other).title()))
    base = [word() for _ in range(150)]
    for _ in range(copies):
        other = list(base)
        other[rng.randrange(len(other))] = word()
        rows.append((len(rows), " ".join(other)))
    return rows


def got(df):
    return sorted([(r["doc_id"], r["class_id"], r["class_size"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed,copies", [(1, 40), (2, 0)])
def test_classes_match_all_pairs(make, seed, copies):
    rows = corpus(seed, copies) + [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One two!"), (None, "one two"), (905, "x " * 5000)]
    rows.append(rows[3])
    result = near_duplicates(make(rows)).cache()
    assert got(result) == expected(rows)
    kept = [r for r in result.collect() if r["kept"]]
    assert len(kept) == len({r["class_id"] for r in kept}) and all(r["doc_id"] == r["class_id"] for r in kept)


def test_every_pair_of_a_shared_passage_is_met(make):
    """Texts of one passage and little else are all in the same buckets and in classes of their own, but for the planted pairs."""
    rng, rows = random.Random(11), []
    word = lambda: "w" + str(rng.randrange(10**9))
    passage = [word() for _ in range(200)]
    for _ in range(120):
        own = [word() for _ in range(36)]
        rows.append((len(rows), " ".join(passage + own)))
        rows.append((len(rows), " ".join(passage + own[:18] + [word() for _ in range(18)])))
    want = expected(rows)
    assert len(want) == 240 and all(size == 2 for _, _, size in want)
    assert got(near_duplicates(make(rows))) == want


def test_sampler_follows_its_definition():
    sampler, rng = Sampler(64), np.random.default_rng(5)
    found = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    weights = rng.choice([1.0, 2.0, 3.7], len(found))
    value, level = sampler._rank(sampler._draws(found), np.log(weights)[None, :])
    assert np.isfinite(value).all()
    lead = value.argmin(axis=1)
    from aislemap.llm.common import mix

    want = mix(found[lead] + mix(level[np.arange(64), lead].astype(np.int64).view(np.uint64)))
    assert (sampler.samples(found, weights) == want).all()


def test_samples_agree_as_often_as_texts_are_similar():
    sampler, rng = Sampler(4000), np.random.default_rng(6)
    found = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64))
    wa, wb = rng.choice([1.0, 1.5, 2.0], len(found)), rng.choice([1.0, 1.5, 2.0], len(found))
    a, b = (found[:100], wa[:100]), (found[15:], wb[15:])
    share = float((sampler.samples(*a) == sampler.samples(*b)).mean())
    assert math.isclose(share, weighted_jaccard(a, b), abs_tol=0.04)


def test_empty_table_and_columns(spark, make):
    assert near_duplicates(make([])).count() == 0
    text = " ".join(f"a{i}" for i in range(100))
    odd = make([(1, text), (2, text + " end"), (3, "other text of five words")]).selectExpr("doc_id", "text", "'x' as node", "1 as row", "2 as bucket", "3 as text_hash")
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_word_hashes_depend_on_the_word_alone():
    lower, plain = WordHasher(lower=True), WordHasher(lower=False)
    rng = random.Random(8)
    words = ["a", "A", "b-c", "é", "É", "word9", "x" * 90000] + ["w%d" % i for i in range(3000)]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", ". "]) for _ in range(40000)).encode()
    for hasher, split in ((lower, lower_words), (plain, lambda t: t.split())):
        found, by = split(text), {}
        hashes = hasher(text)
        assert len(found) == len(hashes)
        for w, h in zip(found, hashes.tolist()):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)
        assert hasher(None).size == hasher(b"").size == hasher(b" . " if hasher is lower else b" ").size == 0
