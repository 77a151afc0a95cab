"""Scores, rankings and reports on published metrics of seven methods."""

import pytest

from aislemap.operators import compare
from aislemap.operators.density_params import score_runs, select_density_params
from aislemap.plans.methods import method_catalogue

# Published metrics; the last two columns are the expected scores.
COLUMNS = (
    "method string, method_category string, num_clusters bigint, num_samples bigint, cluster_density double, silhouette_score double, "
    "davies_bouldin double, metrics_source string, subcategory_nmi double, avg_top_seller_concentration double, price_homogeneity double, "
    "noise_percent double, small_clusters_pct double, expected_business double, expected_score double"
)
ROWS = [
    ("transformer", "transformer-based", 299, 14152, 47.331103678929765, 0.6262938976287842, 0.4502848960112012, "original_embeddings", 0.7483802713035249, 0.6447610937673076, 0.22736633787530092, None, None, 14.815193357140227, 9.181422488969092),
    ("kmeans", "traditional", 175, 14152, 80.86857142857143, 0.3138604612294473, 1.027428070983387, "original_embeddings", 0.5192856532328609, 0.8065542266750683, 0.6647348753540705, None, None, 12.995993328636814, 16.062937446414182),
    ("traditional_agglomerative", "traditional", 270, 14152, 52.41481481481482, 0.34482496793127543, 0.9208029357355603, "original_embeddings", 0.5823906183115022, 0.808576048645681, 0.6891889938746916, None, None, 15.049207657773106, 17.849222404026715),
    ("traditional_hdbscan", "density-based", 55, 14152, 257.3090909090909, 0.5575743913650513, 1.02379571873883, "original_embeddings", 0.4131013068108238, 0.7245062872380945, 0.4311633824066228, 13.178349349915205, None, 7.219174426425578, 12.575963611447815),
    ("bertopic", "topic-based", 313, 37412, 119.52715654952077, -0.48337797953283723, 7.523027428532538, "approximated_features", 0.4865553622376698, 0.5353867764429513, -0.18668752762788166, None, 96.80511182108627, 2.940842308754847, 5.617339707359237),
    ("transformer_kmeans", "transformer-based", 200, 14152, 70.76, 0.4777244031429291, 0.6953260953834931, "original_embeddings", 0.6284031964481758, 0.4871762763994332, -0.13460401688733348, None, None, 6.718896864124336, 6.887405143070819),
    ("transformer_agglomerative", "transformer-based", 290, 14152, 48.8, 0.6175426840782166, 0.4508163822179646, "original_embeddings", 0.7457783706900138, 0.6456662521430698, 0.22617360154537736, None, None, 14.744861992870547, 9.158011777710307),
]
RANKING = ["traditional_agglomerative", "kmeans", "traditional_hdbscan", "transformer", "transformer_agglomerative", "transformer_kmeans", "bertopic"]


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def scored(metrics):
    return compare.method_score(compare.business_alignment(metrics.drop("expected_business", "expected_score")))


def test_scores(metrics, scored):
    joined = scored.join(metrics.select("method", "expected_business", "expected_score"), "method").collect()
    assert len(joined) == 7
    for r in joined:
        assert r["business_alignment"] == pytest.approx(r["expected_business"], rel=1e-12)
        assert r["overall_score"] == pytest.approx(r["expected_score"], rel=1e-12)


def test_ranking_and_best(scored):
    ranked = compare.rank_methods(scored).orderBy("rank").collect()
    assert [r["method"] for r in ranked] == RANKING
    best = {r["method_category"]: r["method"] for r in compare.best_per_category(scored).collect()}
    assert best == {"density-based": "traditional_hdbscan", "traditional": "traditional_agglomerative", "topic-based": "bertopic", "transformer-based": "transformer"}


def test_warnings(metrics):
    got = {(r["method"], r["metric"]) for r in compare.threshold_warnings(metrics).collect()}
    assert got == {(m, "price_homogeneity") for m in ("transformer", "bertopic", "transformer_kmeans", "transformer_agglomerative")}


def test_category_comparison(metrics):
    got = compare.category_comparison(metrics).collect()
    assert {r["method"] for r in got} == {"kmeans", "traditional_agglomerative", "transformer", "transformer_kmeans", "transformer_agglomerative"}


def test_radar(metrics):
    one = {r["method"]: r for r in compare.radar_normalise(metrics).collect()}
    assert one["bertopic"]["subcategory_nmi"] == 0.5
    assert one["transformer"]["subcategory_nmi"] == 1.0 and one["transformer_kmeans"]["subcategory_nmi"] == 0.0
    best = {r["method"] for r in compare.radar_normalise(metrics, "best").collect()}
    assert best == {"transformer", "traditional_agglomerative", "traditional_hdbscan", "bertopic"}
    assert compare.radar_normalise(metrics.drop("silhouette_score", "price_homogeneity")).count() == 0


def test_recommendations_and_report(spark, scored):
    rec = {r["use_case"]: r["method"] for r in compare.recommendations(scored).collect()}
    assert rec["production"] == "traditional_agglomerative"
    assert rec["matching existing categories"] == "transformer"
    assert rec["pricing strategy"] == rec["seller analysis"] == rec["business alignment"] == "traditional_agglomerative"
    assert rec["semantic understanding"] == "transformer"
    rows = compare.report_rows(scored, method_catalogue(spark))
    got = {(r["section"], r["key"]): r["value"] for r in rows.collect()}
    assert got[("ranking", "traditional_agglomerative")] == "17.85 points"
    assert got[("best method metrics", "silhouette_score")] == "0.3448"
    assert got[("best method metrics", "num_samples")] == "14152"
    assert got[("best method metrics", "cluster_density")] == "52.4148"
    assert got[("methods", "kmeans")] == "K-Means over weighted terms, sellers and prices (175 clusters)"
    assert "- **kmeans**: 16.06 points" in compare.report_markdown(rows)


def test_single_method_has_no_relative_score(metrics):
    one = compare.business_alignment(metrics.where("method = 'kmeans'"))
    assert one.first()["business_alignment"] == 0.0


def test_comparison_table_and_stack(spark, metrics):
    table = compare.comparison_table(metrics, method_catalogue(spark))
    assert {r["method"]: r["method_category"] for r in table.collect()}["bertopic"] == "topic-based"
    a = spark.createDataFrame([("m", 1)], "method string, x int")
    b = spark.createDataFrame([("n", 2.0)], "method string, y double")
    assert {tuple(r) for r in compare.stack_methods([a, b]).select("method", "x", "y").collect()} == {("m", 1, None), ("n", None, 2.0)}


# Published search over density settings.
RUNS = [
    (50, 10, 69, 2287, 16.160260033917467, 0.6025084), (50, 20, 63, 2825, 19.96184284906727, 0.5799412),
    (50, 30, 54, 1865, 13.178349349915207, 0.7145996), (100, 10, 29, 1955, 13.814301865460711, 0.5079477),
    (100, 20, 27, 2325, 16.428773318258905, 0.5180521), (100, 30, 25, 1980, 13.990955342001131, 0.6808311),
    (200, 10, 18, 1698, 11.998304126625213, 0.5610348), (200, 20, 17, 1690, 11.941775014132277, 0.55223936),
    (200, 30, 15, 1626, 11.489542114188808, 0.66144246),
]


def test_density_parameters(spark):
    runs = spark.createDataFrame(RUNS, "min_cluster_size int, min_samples int, n_clusters int, n_noise int, noise_percent double, silhouette double")
    for full_at, floor in ((50, 20), (30, None)):
        best = select_density_params(runs, full_at, floor).first()
        assert (best["min_cluster_size"], best["min_samples"]) == (50, 30)
    top = score_runs(runs).orderBy("score", ascending=False).first()
    assert top["score"] == pytest.approx(0.6204, abs=1e-4)
    few = select_density_params(runs.where("n_clusters < 20")).first()
    assert few["n_clusters"] == 18


def test_measures_of_whole_clusters_share_one_pass(spark):
    from aislemap.operators import quality
    from aislemap.plans.evaluate import method_metrics
    from aislemap.session import materialise

    n = 240
    rows = [("ab"[i % 2], ["density-based", "traditional"][i % 2], i % 7 - 1, f"d{i % 3}", f"s{i % 5}", f"x{i % 4}", float(i % 11) if i % 13 else None) for i in range(n)]
    labels = spark.createDataFrame(rows, "method string, method_category string, cluster int, division string, subcategory string, seller string, price double")
    labels = materialise(labels)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = method_metrics(labels.mapInPandas(counted, labels.schema)).toPandas().set_index("method")
    # one pass for the clusters, one or two for the sellers, one or two for the known groupings
    assert n <= read.value <= 5 * n
    by = ["method"]
    plain = [
        quality.partition_shape(labels, by), quality.cluster_size_stats(labels, by), quality.price_homogeneity(labels, by),
        quality.noise_percent(labels.where("method_category = 'density-based'"), by),
    ]
    for part in plain:
        for r in part.collect():
            for name, value in r.asDict().items():
                if name != "method":
                    assert got.loc[r["method"], name] == pytest.approx(value)
    assert got.loc["a", "method_category"] == "density-based" and got.loc["b", "noise_percent"] != got.loc["a", "noise_percent"]
