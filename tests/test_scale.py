"""Steps whose shuffles and files must not grow with copies of long texts, beside brute force."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aislemap.operators import clean, features
from aislemap.session import ensure_checkpoint_dir


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_duplicates_travel_without_their_text(spark):
    rows = [(1, "a", "long"), (2, "a", "long"), (3, "a", "other"), (4, "a", None), (5, "a", None), (6, "b", "")]
    df = spark.createDataFrame(rows, "listing_id long, title string, description string")
    done = clean.drop_exact_duplicates(df)
    assert sorted(tuple(r) for r in done.collect()) == [(1, "a", "long"), (3, "a", "other"), (4, "a", None), (6, "b", "")]
    found = exchanges(done.select("listing_id", "title"))
    assert found and not any("description#" in line for line in found)


def test_listing_file_is_smaller_than_its_texts(spark):
    from catalog_queries.cleaning import raw, s1

    sf_dir = "/root/testdata/sf0.001"
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("round-trip-csv-*"))
    read = s1(spark, sf_dir)
    (new,) = set(folder.glob("round-trip-csv-*")) - before
    texts = raw(spark, sf_dir, True)
    assert sum(f.stat().st_size for f in new.glob("part-*")) < texts.agg(F.sum(F.octet_length("description"))).first()[0] / 2
    assert read.count() == texts.count()


def shared_ids(spark):
    rnd = random.Random(1)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "ąž", "zz"]
    rows = [(i % 55 if i < 58 else i, " ".join(rnd.choice(words[: rnd.randint(2, 8)]) for _ in range(rnd.randint(0, 12)))) for i in range(70)]
    rows += [(-1, "aa bb"), (-1, "bb cc"), (99, None)]
    return rows, spark.createDataFrame(rows, "listing_id long, text string")


def runs_by_id(rows, low, high):
    found = {}
    for i, text in rows:
        w = (text or "").split()
        found.setdefault(i, Counter()).update(" ".join(w[a : a + n]) for n in range(low, high + 1) for a in range(len(w) - n + 1))
    return found


@pytest.mark.parametrize("held", [1 << 20, 3])
@pytest.mark.parametrize("low, high, min_df, most", [(1, 5, 3, 40), (1, 1, 1, 5), (2, 3, 2, 7), (1, 3, 2, 10000)])
def test_frequent_terms_of_shared_ids(spark, monkeypatch, low, high, min_df, most, held):
    monkeypatch.setattr(features, "HELD_RUNS", held, raising=False)
    rows, df = shared_ids(spark)
    own = runs_by_id(rows, low, high)
    total, seen = Counter(), Counter()
    for c in own.values():
        total.update(c)
        seen.update(c.keys())
    kept = sorted((t for t in total if seen[t] >= min_df), key=lambda t: (-total[t], t))[:most]
    vocab, counts = features.frequent_terms(df, "text", (low, high), min_df, most)
    assert sorted(tuple(r) for r in vocab.select("term", "df", "total").collect()) == sorted((t, seen[t], total[t]) for t in kept)
    got = sorted(tuple(r) for r in counts.select("listing_id", "term", "tf").collect())
    assert got == sorted((i, t, c[t]) for i, c in own.items() for t in set(c) & set(kept))


def test_run_facts_count_inside_the_row(spark):
    rows, df = shared_ids(spark)
    facts = features.run_facts(df, "text", (1, 5))
    want = {i: (sum(c.values()), len(c), min(c), max(c)) for i, c in runs_by_id(rows, 1, 5).items() if c}
    assert {r[0]: tuple(r)[1:] for r in facts.collect()} == want
    assert "Generate" not in facts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("low, high", [(1, 5), (2, 3), (3, 3)])
def test_runs_of_a_row_are_numbered_not_written(spark, low, high):
    """Facts of every length, where short texts end a run, with no run of a text in the plan."""
    rows, df = shared_ids(spark)
    facts = features.run_facts(df, "text", (low, high))
    want = {i: (sum(c.values()), len(c), min(c, key=lambda t: t.encode()), max(c, key=lambda t: t.encode())) for i, c in runs_by_id(rows, low, high).items() if c}
    assert {r[0]: tuple(r)[1:] for r in facts.collect()} == want
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_join" not in plan


def test_feature_vectors_write_the_texts_once(spark, monkeypatch):
    rows = [(i, f"red case {i % 3}", f"long text of part {i % 4}", float(i + 1), "s") for i in range(12)]
    df = spark.createDataFrame(rows, "listing_id long, title string, description string, price double, seller string")
    written, write = [], features.materialise
    monkeypatch.setattr(features, "materialise", lambda table: written.append(table.columns) or write(table))
    small = {"ngram": (1, 2), "min_df": 2, "max_features": 8}
    out, terms = features.feature_vectors(df, title=small, description=small, min_seller_rows=1)
    assert sum("description" in columns for columns in written) == 1
    assert out.count() == 12 and 0 < len(terms) <= 8
