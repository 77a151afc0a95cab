"""Held-out accuracy of the classifiers, compiled rules against arrays, and the machine against its formula."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemap.llm.common import held_out, labelled
from aislemap.llm.quality import STATISTICS, Rules, fit_quality, fit_rules, measured, quality, score_quality
from aislemap.llm.toxicity import fit_machine, fit_toxicity, score_toxicity, toxicity

SF = "/root/testdata/sf0.1"


def accuracy(spark, fn, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = fn(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id")
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0], rows.agg(F.min("score"), F.max("score")).first()


def test_toxicity_on_held_out_rows(spark):
    share, (low, high) = accuracy(spark, toxicity, "toxic")
    assert share >= 0.98 and 0 <= low <= high <= 1


def test_quality_on_held_out_rows(spark):
    share, (low, high) = accuracy(spark, quality, "quality")
    assert share >= 0.98 and 0 <= low <= high <= 1


def test_compiled_rules_equal_arrays(spark, make):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    rules = fit_rules(x, y)
    assert ((rules.predict(x) > 0.5) == y).mean() > 0.97
    texts = ["a b c", "", None, "ABC!! DEF!! " * 30, "one two. three\nfour", "é ü ß"]
    docs = make([(i, t) for i, t in enumerate(texts)])
    rows = score_quality(docs, rules).join(docs.select("doc_id", measured(F.col("text")).alias("s")), "doc_id").orderBy("doc_id").collect()
    stats = np.array([[r["s"][k] for k in STATISTICS] for r in rows])
    assert np.allclose([r["score"] for r in rows], rules.predict(stats))


def test_machine_learns_a_pair_that_no_sum_can():
    rng = np.random.default_rng(4)
    slots, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        slots.append(np.array(sorted({7: a, 9: b}[k] and k for k in (7, 9) if {7: a, 9: b}[k]), np.int64))
        y.append(float(a and b) if rng.random() < 0.98 else 0.0)
    machine = fit_machine(slots, np.array(y), rounds=150)
    known = {int(t): i for i, t in enumerate(machine.terms)}
    v = machine.vectors[[known[7], known[9]]]
    both = machine.score(np.array([known[7], known[9]]))
    assert np.isclose(both, machine.start + machine.weights.sum() + float(v[0] @ v[1]))
    assert both > 0 and machine.score(np.array([known[7]])) < 0 and machine.score(np.array([known[9]])) < 0


def test_machine_learns_terms_that_say_nothing_alone():
    rng = np.random.default_rng(1)

    def rows(n):
        slots, y = [], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            slots.append(np.unique([*[7] * int(a), *[9] * int(b), *(100 + rng.integers(0, 500, 20))]).astype(np.int64))
            y.append(float(a != b))
        return slots, np.array(y)

    machine = fit_machine(*rows(4000))
    slots, y = rows(500)
    right = [(machine.score(k[k >= 0]) > 0) == t for k, t in zip((machine.place[s] for s in slots), y)]
    assert {7, 9} <= set(machine.terms.tolist()) and np.mean(right) > 0.98


def test_repeated_ids_stay_within_the_bound(spark, make):
    docs = make([(i % 20, f"t{i}") for i in range(400)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    rows = labelled(docs, labels, "toxic", 5).collect()
    assert len(rows) == 5 and all(r["text"] == min(f"t{i}" for i in range(400) if i % 20 == r["doc_id"]) for r in rows)


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_no_labels_one_label_and_odd_rows(spark, make, label):
    fit, score = (fit_toxicity, score_toxicity) if label == "toxic" else (fit_quality, score_quality)
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b"), (4, "w " * 20000)]
    docs = make(rows).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = score(docs, fit(docs, none)).collect()
    assert len(out) == 6 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in out)
    one = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3, 4)] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in score(docs, fit(docs, one)).collect())
    assert score(make([]), fit(docs, none)).count() == 0


def test_held_out_is_the_crc_rule(spark, make):
    import zlib

    rows = make([(i, "") for i in range(50)]).select("doc_id", held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_rules_without_conditions_are_a_constant(spark, make):
    out = score_quality(make([(1, "a")]), Rules(0.0, [])).first()
    assert out["score"] == 0.5


def test_pair_test_holds_few_rows_at_once():
    import tracemalloc

    from aislemap.llm.toxicity import FACTORS, Machine, _paired

    rng = np.random.default_rng(3)
    slots = [np.unique(rng.integers(0, 1200, 40)).astype(np.int32) for _ in range(12_000)]
    y = (rng.random(len(slots)) < 0.3).astype(float)
    machine = Machine(0.0, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    tracemalloc.start()
    try:
        _paired(slots, y, machine)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # one matrix of all rows and terms alone would take 57 MB, and three were held
    assert peak < 110 << 20
