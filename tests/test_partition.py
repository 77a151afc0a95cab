"""Agreement indices on small cases and edge cases."""

import itertools
import math

import numpy as np
import pytest

from aislemap.operators import packing, partition, quality


def scores(spark, u, v):
    df = spark.createDataFrame([(str(a), int(b)) for a, b in zip(u, v)], "u string, v int")
    return partition.partition_scores(partition.contingency(df, "u", "v")).first()


def brute_emi(u, v):
    """Mean mutual information over every arrangement of the second labeling."""
    n, total, count = len(u), 0.0, 0
    for perm in set(itertools.permutations(v)):
        mi = 0.0
        for a in set(u):
            for b in set(v):
                nij = sum(1 for x, y in zip(u, perm) if x == a and y == b)
                if nij:
                    mi += nij / n * math.log(nij * n / (list(u).count(a) * list(v).count(b)))
        total, count = total + mi, count + 1
    return total / count


def test_same_and_different(spark):
    s = scores(spark, [0, 0, 1, 1, 2], [5, 5, 6, 6, 7])
    for name in ("ari", "nmi", "ami", "homogeneity", "completeness", "v_measure"):
        assert s[name] == pytest.approx(1.0)
    s = scores(spark, [0, 0, 0], [1, 1, 1])
    assert (s["nmi"], s["ami"], s["ari"]) == (1.0, 1.0, 1.0)


def test_expected_mutual_info(spark):
    u, v = [0, 0, 0, 1, 1, 2, 2], [0, 1, 0, 1, 1, 0, 2]
    s = scores(spark, u, v)
    assert s["emi"] == pytest.approx(brute_emi(u, v), abs=1e-12)


def test_adjusted_rand_hand_case(spark):
    s = scores(spark, [0, 0, 1, 1], [0, 0, 1, 2])
    assert s["ari"] == pytest.approx(4 / 7)


def test_division_recovery_warns_on_noise(spark):
    df = spark.createDataFrame([("a", -1), ("a", -1), ("b", 0)], "division string, cluster int")
    row = partition.division_recovery(df).first()
    assert row["warning"] is not None and row["purity"] is None
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", -1)], "division string, cluster int")
    row = partition.division_recovery(df).first()
    assert row["warning"] is None and row["purity"] == pytest.approx(0.5)


def test_agreement_counts_fan_out(spark):
    a = spark.createDataFrame([("x", 0), ("x", 0), ("y", 1)], "title string, cluster int")
    b = spark.createDataFrame([("x", 3), ("x", 4), ("y", 4)], "title string, cluster int")
    joined = quality.match_methods(a, b)
    direct = partition.partition_scores(partition.contingency(joined, "cluster_traditional", "cluster_transformer")).first()
    short = quality.method_agreement(a, b).first()
    assert short["adjusted_rand_score"] == pytest.approx(direct["ari"])
    assert short["adjusted_mutual_info"] == pytest.approx(direct["ami"])
    assert (short["traditional_clusters"], short["transformer_clusters"]) == (2, 2)


def test_silhouette_singletons_and_copies(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "listing_id bigint, cluster int, vec array<double>")
    got = {r["listing_id"]: r["silhouette"] for r in quality.silhouette_rows(df).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("block", [4096, 17])
def test_silhouette_compares_all_rows_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "SILHOUETTE_BLOCK", block)
    rng = np.random.default_rng(0)
    x, k = rng.normal(size=(70, 3)) + (np.arange(70) % 3)[:, None], np.arange(70) % 3
    k[0] = 9
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(70):
        means = {c: d[i, k == c].sum() / max((k == c).sum() - (c == k[i]), 1) for c in set(k)}
        a, b = means.pop(k[i]), min(means.values())
        want.append((b - a) / max(a, b) if (k == k[i]).sum() > 1 else 0.0)
    df = spark.createDataFrame([(i, int(k[i]), x[i].tolist()) for i in range(70)], "listing_id bigint, cluster int, vec array<double>")
    got = {r["listing_id"]: r["silhouette"] for r in quality.silhouette_rows(df).collect()}
    assert np.allclose([got[i] for i in range(70)], want)
    some = {r["listing_id"]: r["silhouette"] for r in quality.silhouette_rows(df, scored=df.where("listing_id < 20")).collect()}
    assert some == pytest.approx({i: got[i] for i in range(20)})
    assert quality.silhouette(df, sample=20).first()[0] is not None


def test_silhouette_of_more_rows_than_the_old_limit(spark):
    df = spark.range(10500).selectExpr("id as listing_id", "cast(id % 2 as int) as cluster", "array(cast(id % 2 as double) * 10, cast(id % 7 as double) / 10) as vec")
    rows = quality.silhouette_rows(df)
    assert rows.count() == 10500 and rows.agg({"silhouette": "min"}).first()[0] > 0.9


def test_silhouette_parts_meet_without_a_shuffle_of_vectors(spark, monkeypatch):
    """Clusters of very different sizes: small ones share a part, large ones are cut; sums per cluster travel for cut clusters only."""
    monkeypatch.setattr(quality, "SILHOUETTE_BLOCK", 20)
    rng = np.random.default_rng(5)
    labels = np.r_[np.zeros(70, int), np.ones(45, int), np.repeat(np.arange(2, 40), 3), [40]]
    x = np.round(rng.normal(size=(len(labels), 3)) + labels[:, None] % 5, 3)
    x[1] = x[0]
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x))], "listing_id long, cluster int, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, k in enumerate(labels):
        means = {c: d[i][labels == c].mean() for c in set(labels.tolist()) - {k}}
        a, b = d[i][labels == k].sum() / max(1, (labels == k).sum() - 1), min(means.values())
        want.append((b - a) / max(a, b) if (labels == k).sum() > 1 else 0.0)
    plans, write, batch = [], packing.materialise, spark.conf.get(packing.BATCH_KEY)

    def noted(table):
        plans.append((table._jdf.queryExecution().executedPlan().toString(), spark.conf.get(packing.BATCH_KEY)))
        return write(table)

    monkeypatch.setattr(packing, "materialise", noted)
    rows = quality.silhouette_rows(df)
    met = [(plan, size) for plan, size in plans if "CartesianProduct" in plan]
    assert met and all("Exchange" not in plan and size == packing.BATCH_BYTES for plan, size in met)
    assert spark.conf.get(packing.BATCH_KEY) == batch
    got = {r["listing_id"]: r["silhouette"] for r in rows.collect()}
    assert np.allclose([got[i] for i in range(len(labels))], want)
    some = quality.silhouette_rows(df, scored=df.where("listing_id % 7 = 0")).collect()
    assert {r["listing_id"] for r in some} == set(range(0, len(labels), 7)) and all(abs(r["silhouette"] - want[r["listing_id"]]) < 1e-9 for r in some)


def test_matches_of_a_small_file_are_made_by_all_cores(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "titles")
    spark.range(400).select(F.concat(F.lit("t"), F.col("id") % 4).alias("title"), (F.col("id") % 7).alias("cluster")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    joined = quality.match_methods(df, df.withColumn("cluster", F.col("cluster") % 2))
    assert joined.rdd.getNumPartitions() > 1 and joined.count() == 40000


def brute_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, k in enumerate(labels):
        means = {c: d[i][labels == c].mean() for c in set(labels.tolist()) - {k}}
        a, b = d[i][labels == k].sum() / max(1, (labels == k).sum() - 1), min(means.values())
        out.append((b - a) / max(a, b) if (labels == k).sum() > 1 else 0.0)
    return out


@pytest.mark.parametrize("block, dims, travel", [(4096, 12, 1 << 26), (25, 12, 1 << 26), (25, 3, 1 << 26), (25, 12, 0)])
def test_silhouette_compares_only_clusters_that_can_be_nearest(spark, monkeypatch, block, dims, travel):
    """Two labelings at once, with wide, far, tiny and repeated clusters; most pairs are left out without changing a value."""
    monkeypatch.setattr(quality, "SILHOUETTE_BLOCK", block)
    monkeypatch.setattr(quality, "SHAPE_BYTES", travel)
    monkeypatch.setattr(quality, "CALL_TIME", 0)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dims)) * 4
    labels = np.r_[np.repeat(np.arange(10), 24), [10] * 70, [11]]
    x = centres[labels] + rng.normal(size=(len(labels), dims)) * np.where(labels == 3, 5.0, 0.7)[:, None] + 100
    x[5] = x[4]
    other = np.where(labels < 5, 0, labels)
    rows = [(m, i, int(k), v.tolist()) for m, own in (("a", labels), ("b", other)) for i, (k, v) in enumerate(zip(own, x))]
    df = spark.createDataFrame(rows, "method string, listing_id long, cluster int, vec array<double>")
    want = {(m, i): v for m, own in (("a", labels), ("b", other)) for i, v in enumerate(brute_silhouettes(x, own))}
    got = {(r["method"], r["listing_id"]): r["silhouette"] for r in quality.silhouette_rows(df, by="method").collect()}
    assert got.keys() == want.keys() and all(abs(got[key] - v) < 1e-9 for key, v in want.items())
    means = {r["method"]: r["silhouette_score"] for r in quality.silhouette(df, by="method").collect()}
    assert means["a"] == pytest.approx(np.mean([v for (m, _), v in want.items() if m == "a"]))


@pytest.mark.parametrize("dims", [2, 20])
def test_shapes_bound_the_mean_distance(dims):
    from aislemap.operators import shapes

    rng = np.random.default_rng(dims)
    labels = np.arange(600) % 12
    x = rng.normal(size=(600, dims)) * rng.gamma(2.0, size=dims) + rng.normal(size=(12, dims))[labels] * 6
    groups = [x[labels == k] for k in range(12)]
    known = np.vstack([shapes.shape(shapes.moments(g, g.mean(0)), g.mean(0)) for g in groups])
    assert known.shape[1] == shapes.width(dims)
    asked = shapes.reachable(x, labels, known)
    means = np.column_stack([np.sqrt(((x[:, None] - g[None]) ** 2).sum(2)).mean(1) for g in groups])
    means[np.arange(600), labels] = np.inf
    assert asked[np.arange(600), labels].all() and asked[np.arange(600), means.argmin(1)].all()
    assert asked.mean() < 0.5


@pytest.mark.parametrize("block", [4096, 20])
def test_silhouettes_of_several_labelings_share_their_distances(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "SILHOUETTE_BLOCK", block)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(110, 4)) + (np.arange(110) % 4)[:, None] * 2
    x[7] = x[3]
    labels = [np.arange(110) % 4, np.where(np.arange(110) == 0, 9, np.arange(110) % 3), np.zeros(110, int)]
    df = spark.createDataFrame([(i, [int(own[i]) for own in labels], x[i].tolist()) for i in range(110)], "listing_id long, clusters array<int>, vec array<double>")
    plans, write = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda table: plans.append(table._jdf.queryExecution().executedPlan().toString()) or write(table))
    got = {r["model"]: r["silhouette_score"] for r in quality.silhouettes(df).collect()}
    assert sum("CartesianProduct" in plan for plan in plans) == 1
    assert set(got) == {0, 1, 2} and got[2] is None
    assert all(got[m] == pytest.approx(np.mean(brute_silhouettes(x, labels[m]))) for m in (0, 1))
