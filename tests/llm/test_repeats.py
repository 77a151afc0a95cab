"""Repeated passages against every window counted by hand."""

import hashlib
import random
import re
from collections import Counter

import pytest

from aislemap.llm.repeats import repeated_spans, without_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, docs, vocabulary, passages):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(vocabulary))
    shared = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(passages)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [word() for _ in range(rng.randrange(0, 90))]
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.randrange(0, 10)
                words += p[a : len(p) - rng.randrange(0, 10)]
        if rows and rng.random() < 0.2:
            words = rng.choice(rows)[1].split()
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("vocabulary", [5000, 3])
def test_matches_all_windows(make, vocabulary):
    rows = corpus(vocabulary, 120, vocabulary, 6)
    rows += [(900, None), (901, ""), (902, "x " * 200), (903, "a b " * 50), (None, rows[3][1]), (904, "é " * 34)]
    rows += [rows[5], (905, "long " + " ".join(str(i) for i in range(30000))), (906, " ".join(str(i) for i in range(1000, 29000)))]
    got = [tuple(r) for r in repeated_spans(make(rows)).collect()]
    assert sorted(got, key=str) == expected(rows, 35)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in repeated_spans(docs).collect()]
    assert sorted(got, key=str) == expected(rows, 35)


def test_empty_table_and_clashing_names(spark, make):
    assert repeated_spans(make([])).count() == 0
    odd = make([(1, "a b")]).selectExpr("doc_id", "text", "1 as node", "2 as marks", "3 as place")
    assert repeated_spans(odd).first()["n_words"] == 2


def test_texts_without_repeats(make):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = {r["doc_id"]: r["text"] for r in without_repeats(make([(1, "start " + passage), (2, passage + "  end"), (3, "own  text"), (4, None)])).collect()}
    assert rows == {1: "start", 2: "end", 3: "own  text", 4: None}
