"""Queries that compare and rank methods, on metrics measured from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislemap.operators import compare, density_params
from aislemap.plans.evaluate import method_metrics
from aislemap.plans.labelings import METHOD_LABELS, label_methods
from aislemap.session import materialise
from aislemap.sources.warehouse import table
from catalog_queries.cleaning import cleaned
from catalog_queries.oracle import CLEAN_SHORT, with_
from catalog_queries.registry import Registry
from catalog_queries.scoring import EXTERNAL_SQL, METHODS_SQL, rounded

QUERIES = Registry()
query = QUERIES.query

_EXT = ", ".join(
    f"max(CASE WHEN g LIKE '%|{t}' THEN {src} END) AS {t}_{out}"
    for t in ("division", "subcategory") for out, src in (("rand_score", "ari"), ("mutual_info", "ami"), ("nmi", "nmi"))
)
METRICS_SQL = with_(CLEAN_SHORT, METHODS_SQL, EXTERNAL_SQL) + f""",
shape AS (SELECT method, any_value(method_category) AS method_category, count(DISTINCT cluster) AS num_clusters, count(*) AS num_samples, count(*) / count(DISTINCT cluster) AS cluster_density FROM methods GROUP BY 1),
ext AS (SELECT split_part(g, '|', 1) AS method, {_EXT} FROM score GROUP BY 1),
sc AS (SELECT method, cluster, seller, count(*) AS n FROM methods GROUP BY 1, 2, 3),
sr AS (SELECT *, row_number() OVER (PARTITION BY method, cluster ORDER BY n DESC, seller) AS k, sum(n) OVER (PARTITION BY method, cluster) AS tot FROM sc),
sp AS (SELECT method, cluster, CAST(max(n) AS DOUBLE) / max(tot) AS p1, CAST(sum(n) FILTER (WHERE k <= 3) AS DOUBLE) / max(tot) AS p3 FROM sr GROUP BY 1, 2),
sell AS (SELECT method, avg(p1) AS avg_top_seller_concentration, avg(p3) AS avg_top3_seller_concentration, count(*) FILTER (WHERE p1 > 0.8) AS high_concentration_clusters FROM sp GROUP BY 1),
pp AS (SELECT method, cluster, stddev_samp(price) / avg(price) AS cv, (max(price) - min(price)) / avg(price) AS rr FROM methods GROUP BY 1, 2),
pri AS (SELECT method, avg(cv) AS avg_price_cv, 1 - avg(cv) AS price_homogeneity, avg(rr) AS avg_price_range_ratio FROM pp GROUP BY 1),
noi AS (SELECT method, CASE WHEN count(*) FILTER (WHERE cluster = -1) > 0 THEN (count(*) FILTER (WHERE cluster = -1)) * 100 / count(*) END AS noise_percent
  FROM methods WHERE method_category = 'density-based' GROUP BY 1),
ss AS (SELECT method, cluster, count(*) AS n FROM methods GROUP BY 1, 2),
siz AS (SELECT method, min(n) AS min_cluster_size, max(n) AS max_cluster_size, avg(n) AS mean_cluster_size, median(n) AS median_cluster_size, stddev_samp(n) AS std_cluster_size,
  stddev_samp(n) / avg(n) AS cluster_size_cv, (count(*) FILTER (WHERE n < (SELECT count(*) FROM clean) * CAST(0.01 AS DOUBLE))) * 100 / count(*) AS small_clusters_pct FROM ss GROUP BY 1),
metrics AS (SELECT * FROM shape JOIN ext USING (method) JOIN sell USING (method) JOIN pri USING (method) LEFT JOIN noi USING (method) JOIN siz USING (method)),
biz AS (SELECT *, """ + " + ".join(
    f"coalesce(({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0) * {w}, 0)" for m, w in compare.BUSINESS_WEIGHTS.items()
) + """ AS business_alignment FROM metrics),
scored AS (SELECT *, (CASE WHEN coalesce(subcategory_nmi < 0.3, false) OR coalesce(num_clusters < 20, false) OR coalesce(price_homogeneity < 0.4, false) THEN 0.6 ELSE 1 END) * (
  pow(greatest(0, least(1, subcategory_nmi / 0.7)), 1.3) * 10 + greatest(0, least(1, (price_homogeneity - 0.3) / 0.6)) * 5
  + greatest(0, least(1, (avg_top_seller_concentration - 0.5) / 0.4)) * 5 + greatest(0, least(1, (num_clusters - 20) / 280)) * 2
  + (cluster_density - min(cluster_density) OVER ()) / (max(cluster_density) OVER () - min(cluster_density) OVER ()) * 2
  + CASE WHEN method_category = 'density-based' AND count(noise_percent) OVER () > 1 THEN
      coalesce((max(noise_percent) OVER () - noise_percent) / nullif(max(noise_percent) OVER () - min(noise_percent) OVER (), 0) * 2, 0) ELSE 0 END
  + coalesce((max(small_clusters_pct) OVER () - small_clusters_pct) / nullif(max(small_clusters_pct) OVER () - min(small_clusters_pct) OVER (), 0) * 1, 0)) AS overall_score FROM biz)
"""

_COUNTS = ("num_clusters", "num_samples", "high_concentration_clusters", "min_cluster_size", "max_cluster_size")


def metrics(spark, sf_dir):
    return method_metrics(label_methods(materialise(cleaned(spark, sf_dir))))


def scored(spark, sf_dir):
    return materialise(compare.method_score(compare.business_alignment(metrics(spark, sf_dir))))


def _round_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("u1_stack_methods", with_(CLEAN_SHORT, METHODS_SQL) + """SELECT method, count(DISTINCT cluster) AS num_clusters, CASE WHEN method = 'size_label' THEN count(*) FILTER (WHERE cluster = -1) END AS noise_rows
FROM methods GROUP BY 1""")
def u1(spark, sf_dir):
    labels = label_methods(materialise(cleaned(spark, sf_dir)))
    records = []
    for name, *_ in METHOD_LABELS:
        aggs = [F.count_distinct("cluster").alias("num_clusters")]
        if name == "size_label":
            aggs.append(F.count_if(F.col("cluster") == -1).alias("noise_rows"))
        records.append(labels.where(F.col("method") == name).groupBy("method").agg(*aggs))
    return compare.stack_methods(records)


_M1 = ("cluster_density", "division_nmi", "subcategory_nmi", "subcategory_rand_score", "subcategory_mutual_info", "avg_top_seller_concentration",
       "avg_top3_seller_concentration", "price_homogeneity", "avg_price_range_ratio", "noise_percent", "median_cluster_size", "std_cluster_size", "small_clusters_pct")


@query("m1_comparison_table", METRICS_SQL + f"SELECT method, method_category, {', '.join(_COUNTS)}, {_round_sql(*_M1)} FROM metrics")
def m1(spark, sf_dir):
    catalogue = spark.createDataFrame([(m, c) for m, c, *_ in METHOD_LABELS], "method string, method_category string")
    df = compare.comparison_table(metrics(spark, sf_dir), catalogue)
    return rounded(df.select("method", "method_category", *_COUNTS, *_M1))


@query("m2_business_alignment", METRICS_SQL + "SELECT method, round(business_alignment, 6) AS business_alignment FROM biz")
def m2(spark, sf_dir):
    return rounded(compare.business_alignment(metrics(spark, sf_dir)).select("method", "business_alignment"))


@query("m3_method_score", METRICS_SQL + "SELECT method, round(overall_score, 6) AS overall_score FROM scored")
def m3(spark, sf_dir):
    return rounded(compare.method_score(metrics(spark, sf_dir)).select("method", "overall_score"))


@query("m4_threshold_warnings", METRICS_SQL + """SELECT method, 'subcategory_nmi' AS metric, round(subcategory_nmi, 6) AS value, CAST(0.3 AS DOUBLE) AS minimum FROM metrics WHERE subcategory_nmi < 0.3
UNION ALL SELECT method, 'num_clusters', CAST(num_clusters AS DOUBLE), CAST(20 AS DOUBLE) FROM metrics WHERE num_clusters < 20
UNION ALL SELECT method, 'price_homogeneity', round(price_homogeneity, 6), CAST(0.4 AS DOUBLE) FROM metrics WHERE price_homogeneity < 0.4""")
def m4(spark, sf_dir):
    return rounded(compare.threshold_warnings(metrics(spark, sf_dir)))


@query("m5_rank_methods", METRICS_SQL + """SELECT method, method_category, round(overall_score, 6) AS overall_score,
CAST(row_number() OVER (ORDER BY overall_score DESC, method) AS INTEGER) AS rank FROM scored""")
def m5(spark, sf_dir):
    return rounded(compare.rank_methods(scored(spark, sf_dir)))


@query("m6_best_per_category", METRICS_SQL + """SELECT method_category, method, round(overall_score, 6) AS overall_score FROM
(SELECT *, row_number() OVER (PARTITION BY method_category ORDER BY overall_score DESC, method) AS r FROM scored) WHERE r = 1""")
def m6(spark, sf_dir):
    return rounded(compare.best_per_category(scored(spark, sf_dir)))


@query("m7_category_comparison", METRICS_SQL + f"""SELECT method_category, method, num_clusters, {_round_sql('subcategory_nmi', 'avg_top_seller_concentration', 'price_homogeneity', 'cluster_density')}
FROM (SELECT *, count(*) OVER (PARTITION BY method_category) AS peers FROM metrics) WHERE peers > 1""")
def m7(spark, sf_dir):
    return rounded(compare.category_comparison(metrics(spark, sf_dir)))


def _radar_sql(window: str) -> str:
    return ", ".join(
        f"round(CASE WHEN min({m}) OVER ({window}) = max({m}) OVER ({window}) THEN 0.5 ELSE ({m} - min({m}) OVER ({window})) / (max({m}) OVER ({window}) - min({m}) OVER ({window})) END, 6) AS {m}"
        for m in ("subcategory_nmi", "avg_top_seller_concentration", "price_homogeneity")
    )


@query("m8_radar_by_category", METRICS_SQL + f"SELECT method, method_category, {_radar_sql('PARTITION BY method_category')} FROM metrics")
def m8(spark, sf_dir):
    return rounded(compare.radar_normalise(metrics(spark, sf_dir), "category"))


@query("m8_radar_best_methods", METRICS_SQL + f"""SELECT method, method_category, {_radar_sql('')} FROM
(SELECT *, row_number() OVER (PARTITION BY method_category ORDER BY subcategory_nmi DESC, method) AS r FROM metrics) WHERE r = 1""")
def m8_best(spark, sf_dir):
    return rounded(compare.radar_normalise(metrics(spark, sf_dir), "best"))


_CASES = "\nUNION ALL ".join(
    f"SELECT '{use}' AS use_case, method, '{m}' AS basis, CAST({m} AS DOUBLE) AS value FROM scored" for use, m in compare.USE_CASES
) + "\nUNION ALL SELECT CASE method_category " + " ".join(f"WHEN '{c}' THEN '{u}'" for c, u in compare.CATEGORY_USES.items()) \
    + " END, method, 'overall_score', overall_score FROM scored"
_RECOMMENDED = f"""rec AS (SELECT use_case, method, basis, value FROM (SELECT *, row_number() OVER (PARTITION BY use_case ORDER BY value DESC, method) AS r FROM ({_CASES})) WHERE r = 1)"""


@query("m9_recommendations", METRICS_SQL + f", {_RECOMMENDED} SELECT use_case, method, basis, round(value, 6) AS value FROM rec")
def m9(spark, sf_dir):
    return rounded(compare.recommendations(scored(spark, sf_dir)))


_REPORT_METRICS = ["subcategory_nmi", "num_clusters", "avg_top_seller_concentration", "price_homogeneity", "num_samples", "cluster_density"]


@query("m10_report_rows", METRICS_SQL + f""", {_RECOMMENDED},
best AS (SELECT * FROM scored ORDER BY overall_score DESC, method LIMIT 1)
SELECT 'methods' AS section, CAST(row_number() OVER (ORDER BY method_category, method) AS INTEGER) AS position, method AS key, num_clusters || ' clusters' AS value FROM scored
UNION ALL SELECT 'ranking', CAST(row_number() OVER (ORDER BY overall_score DESC, method) AS INTEGER), method, printf('%.2f', overall_score) || ' points' FROM scored
UNION ALL SELECT 'best by category', CAST(row_number() OVER (ORDER BY method_category) AS INTEGER), method_category, method || ' (' || printf('%.2f', overall_score) || ' points)' FROM
  (SELECT *, row_number() OVER (PARTITION BY method_category ORDER BY overall_score DESC, method) AS r FROM scored) WHERE r = 1
UNION ALL SELECT 'recommendations', CAST(row_number() OVER (ORDER BY use_case) AS INTEGER), use_case, method FROM rec
""" + "".join(
    f"UNION ALL SELECT 'best method metrics', {i + 1}, '{m}', " + (f"CAST({m} AS VARCHAR)" if m in _COUNTS else f"CASE WHEN abs({m}) < 1000 THEN printf('%.4f', {m}) ELSE printf('%.1f', {m}) END") + " FROM best\n"
    for i, m in enumerate(_REPORT_METRICS)
))
def m10(spark, sf_dir):
    df = scored(spark, sf_dir).select("method", "method_category", *_REPORT_METRICS, "business_alignment", "overall_score")
    rows = compare.report_rows(df)
    return rows.where("key <> 'business_alignment'")


_EXTERNAL_NAMES = [f"{t}_{m}" for t in ("division", "subcategory") for m in ("rand_score", "mutual_info", "nmi")]
_CHARTS = {
    "num_clusters": ["num_clusters"], "external_metrics": _EXTERNAL_NAMES,
    "cluster_sizes": ["min_cluster_size", "median_cluster_size", "mean_cluster_size", "max_cluster_size"],
    "dashboard": ["subcategory_nmi", "num_clusters", "price_homogeneity"],
}


@query("m11_chart_data", METRICS_SQL + "\nUNION ALL ".join(
    f"SELECT '{chart}' AS chart, method, '{m}' AS series, round(CAST({m} AS DOUBLE), 6) AS value FROM metrics" for chart, names in _CHARTS.items() for m in names))
def m11(spark, sf_dir):
    return rounded(compare.chart_data(metrics(spark, sf_dir)))


# runs of a density method as the parameter search leaves them: one per order
# priority and return flag, measured on the line items
_RUNS = """runs AS (SELECT CAST(10 * (1 + ascii(o_orderpriority) - ascii('1')) AS INTEGER) AS min_cluster_size, CAST(ascii(l_returnflag) AS INTEGER) AS min_samples,
count(DISTINCT l_suppkey) AS n_clusters, count(*) FILTER (WHERE l_discount > 0.08) AS n_noise,
(count(*) FILTER (WHERE l_discount > 0.08)) * 100 / count(*) AS noise_percent, avg(l_tax) * 10 AS silhouette
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query("c12_select_density_params", f"WITH {_RUNS}" + """, s AS (SELECT *, silhouette * (1 - noise_percent / 100) * least(n_clusters / 50, 1) AS score FROM runs)
SELECT min_cluster_size, min_samples, n_clusters, n_noise, round(noise_percent, 6) AS noise_percent, round(silhouette, 6) AS silhouette, round(score, 6) AS score
FROM s WHERE n_clusters >= 20 AND score > -1 ORDER BY s.score DESC, min_cluster_size, min_samples LIMIT 1""")
def c12(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    noisy = F.col("l_discount") > 0.08
    runs = line.groupBy((10 * (1 + F.ascii("o_orderpriority") - F.ascii(F.lit("1")))).alias("min_cluster_size"), F.ascii("l_returnflag").alias("min_samples")).agg(
        F.count_distinct("l_suppkey").alias("n_clusters"), F.count_if(noisy).alias("n_noise"),
        (F.count_if(noisy) * 100 / F.count("*")).alias("noise_percent"), (F.avg("l_tax") * 10).alias("silhouette"),
    )
    return rounded(density_params.select_density_params(runs))
