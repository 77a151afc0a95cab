"""Methods from listings to stored results and their comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemap.operators import compare, features
from aislemap.plans import evaluate, run
from aislemap.sources import listings as io

KINDS = [("cable", "usb cable long"), ("case", "leather phone case"), ("drill", "cordless power drill")]


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        name, text = KINDS[i % 3]
        rows.append((i, f"{name} {text}", f"{text} {text}", float(10 * (i % 3) + 5 + rng.random()), f"s{i % 4}", name, f"{name} all"))
    return spark.createDataFrame(rows, "listing_id bigint, title string, description string, price double, seller string, division string, subcategory string")


SMALL = {"title": {"ngram": (1, 1), "min_df": 2, "max_features": 50}, "description": {"ngram": (1, 1), "min_df": 2, "max_features": 50}}


@pytest.fixture(scope="module")
def runs(shop):
    return [
        run.run_kmeans(shop, [2, 3], 4, **SMALL),
        run.run_ward(shop, [2, 3], 4, **SMALL),
        run.run_density(shop, [(20, 3)], 4, **SMALL),
        run.run_topics(shop, 10, 3),
    ]


def test_every_method_finds_the_kinds_and_describes_them(shop, runs):
    for r in runs:
        assert r.labelled.count() == 90 and r.vectors.count() == 90
        kept = r.labelled.where(~F.col("is_noise"))
        mixed = kept.groupBy("cluster").agg(F.count_distinct("division").alias("n")).where("n > 1").count()
        assert mixed == 0 and kept.count() >= 80, r.method
        summary = r.summary.collect()
        assert sum(s["size"] for s in summary) == 90
        for s in [s for s in summary if not s["is_noise_cluster"]]:
            kind = next(iter(s["top_subcategories"])).split()[0]
            words = {w for name, text in KINDS if name == kind for w in (name, *text.split())}
            assert s["sample_products"] and set(s["top_terms"][:2]) <= words, (r.method, s)


def test_runs_are_compared_with_vector_metrics(runs):
    runs = [*runs[:2], run.MethodRun(runs[2].method, runs[2].category, runs[2].labelled, None, runs[2].summary)]
    rows = {r["method"]: r for r in evaluate.compare_runs(runs).collect()}
    assert rows["kmeans"]["metrics_source"] == "original_features" and rows["kmeans"]["silhouette_score"] > 0.5
    assert rows["traditional_hdbscan"]["metrics_source"] == "approximated_features"
    assert all(r["davies_bouldin"] is not None and r["calinski_harabasz"] > 0 for r in rows.values())
    with pytest.raises(ValueError):
        evaluate.compare_runs(runs[:1])


def test_stored_runs_read_back(spark, runs, tmp_path):
    paths = run.store(runs[0], str(tmp_path))
    back = run.load(spark, "kmeans", "traditional", str(tmp_path))
    assert sorted(r["listing_id"] for r in back.vectors.collect()) == list(range(90))
    sizes = {r["cluster"]: r["size"] for r in back.summary.collect()}
    assert sizes == {r["cluster"]: r["count"] for r in back.labelled.groupBy("cluster").count().collect()}
    with pytest.raises(io.MissingResult):
        run.load(spark, "ward", "traditional", str(tmp_path))
    assert set(paths) == {"labels", "vectors", "summary"}


def test_dense_rows(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "c", 2.0), (2, "b", 3.0), (2, "b", 1.0)], "listing_id bigint, feature string, value double")
    assert {r["listing_id"]: r["vec"] for r in features.dense_rows(long).collect()} == {1: [1.0, 0.0, 2.0], 2: [0.0, 4.0, 0.0]}
    with pytest.raises(ValueError):
        features.dense_rows(long, most=2)
