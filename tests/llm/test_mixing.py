"""Targets, budgets and seeded choices of the mix against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np

from aislemap.llm.mixing import fit, knapsack, mix, mixed_documents


def water_fill(totals, share=1.5, weights=(3, 1, 2), cap=2):
    """Targets by sharing the excess again until no source is above its cap."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(totals.values()), {}, set(names)
    while open_:
        rate = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate > cap * totals[s]}
        if not full:
            target |= {s: weight[s] * rate for s in open_}
            break
        target |= {s: cap * totals[s] for s in full}
        open_ -= full
    return target


def test_knapsack_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(40):
        sizes = np.array(rng.sample(range(1, 30), 4))
        free = np.array([rng.randrange(0, 4) for _ in range(4)])
        budget = rng.randrange(0, 120)
        best = max(s for c in itertools.product(*[range(f + 1) for f in free]) if (s := int((np.array(c) * sizes).sum())) <= budget)
        chosen = knapsack(sizes, free, budget)
        assert (chosen <= free).all() and int((chosen * sizes).sum()) == best


def test_fit_meets_large_budgets():
    rng = np.random.default_rng(2)
    sizes = np.arange(0, 4000)
    counts = rng.integers(1, 50, 4000)
    total = int((sizes * counts).sum())
    for target in (0.37 * total, 1.21 * total, 2.0 * total, 0.0):
        passes, extra = fit(sizes, counts, target)
        assert (extra >= 0).all() and (extra <= counts).all() and abs(passes * total + int((extra * sizes).sum()) - target) <= 1


def corpus():
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 5, 5, 40, 41, 300]), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    return rows + [(700, None, "a"), (None, "x y", "b"), (5, "again", "b"), (701, "v " * 50000, "b"), rows[9], (702, "", "only empty")]


def test_mix_meets_targets(make):
    docs = make(corpus())
    out = mix(docs).collect()
    assert len(out) == len(corpus()) and all(0 <= r["copies"] <= 2 for r in out)
    totals, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r["size"] == len((r["text"] or "").split(" ")) - (1 if (r["text"] or "").endswith(" ") or not r["text"] else 0)
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = water_fill(totals)
    for s in totals:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= (1 if s == "hot" else 50000)
        assert {r["source_size"] for r in out if r["source"] == s} == {totals[s]}
    key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "", r["copies"]) for r in rows)
    assert key(out) == key(mix(docs.repartition(7)).collect())


def test_documents_repeat_and_names_clash(make):
    docs = make(corpus()).selectExpr("doc_id", "text", "source", "1 as size", "2 as copies", "3 as rank", "4 as key0")
    assert mixed_documents(docs).columns == docs.columns
    want = Counter({k: n for k, n in Counter({}).items()})
    for r in mix(docs.drop("size", "copies")).collect():
        want[(r["doc_id"], r["text"])] += r["copies"]
    got = Counter((r["doc_id"], r["text"]) for r in mixed_documents(docs).collect())
    assert got == +want
    assert mix(make([])).count() == 0 and mix(make([(1, None, None)])).first()["target"] == 0


def test_ranks_exchange_the_rows_once(spark):
    from pyspark.sql import functions as F

    from aislemap.llm.common import number_hash, seeded_rank

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = seeded_rank(docs.withColumn("hash", number_hash(F.lit("x"), "doc_id")), ["source"], "hash", ["doc_id"], 400)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["source"], r["rank"]) for r in ranked.collect()) == [(str(s), i) for s in range(3) for i in range(134 - (s > 0))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
