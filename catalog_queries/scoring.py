"""Queries that score clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislemap.operators import partition, quality
from aislemap.plans.labelings import METHOD_LABELS, label_methods
from aislemap.session import materialise
from aislemap.sources.warehouse import table
from catalog_queries.cleaning import cleaned
from catalog_queries.describing import CENTER, VEC, labelled
from catalog_queries.oracle import CLEAN, CLEAN_SHORT, with_
from catalog_queries.registry import Registry

QUERIES = Registry()
query = QUERIES.query


def _r(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


def rounded(df, digits: int = 6):
    """Round every floating column."""
    return df.select(*[_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- labelings ------------------------------------------------------------------

# several labelings of the same listings stand for the results of several methods
METHODS_SQL = "methods AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, '{category}' AS method_category, listing_id, title, price, seller, division, subcategory, {sql} AS cluster FROM clean"
    for m, category, sql, _ in METHOD_LABELS
) + ")"


def methods(spark, sf_dir, description: bool = False):
    return label_methods(cleaned(spark, sf_dir, description))


def partition_sql(lab: str, key: str = "0") -> str:
    """CTEs ending in ``score`` (one row per key) from a relation with columns u, v and the key."""
    return f"""
cells AS (SELECT {key} AS g, u, v, CAST(count(*) AS DOUBLE) AS n FROM {lab} GROUP BY 1, 2, 3),
ma AS (SELECT g, u, sum(n) AS a FROM cells GROUP BY 1, 2),
mb AS (SELECT g, v, sum(n) AS b FROM cells GROUP BY 1, 2),
tt AS (SELECT g, sum(n) AS t, sum(n * (n - 1) / 2) AS pc, -sum(n * ln(n)) AS hc FROM cells GROUP BY 1),
sa AS (SELECT g, sum(a * (a - 1) / 2) AS pa, sum(a * ln(a)) AS la FROM ma GROUP BY 1),
sb AS (SELECT g, sum(b * (b - 1) / 2) AS pb, sum(b * ln(b)) AS lb FROM mb GROUP BY 1),
mi AS (SELECT cells.g, sum(n / t * ln(n * t / (a * b))) AS mi FROM cells JOIN ma ON ma.g = cells.g AND ma.u = cells.u
  JOIN mb ON mb.g = cells.g AND mb.v = cells.v JOIN tt ON tt.g = cells.g GROUP BY 1),
da AS (SELECT g, a, count(*) AS ca FROM ma GROUP BY 1, 2), db AS (SELECT g, b, count(*) AS cb FROM mb GROUP BY 1, 2),
nij AS (SELECT g, a, b, t, ca * cb AS c, unnest(range(CAST(greatest(1, a + b - t) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS n
  FROM da JOIN db USING (g) JOIN tt USING (g)),
emi AS (SELECT g, sum(c * (n / t) * ln(t * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1)
  - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS emi FROM nij GROUP BY 1),
ent AS (SELECT *, ln(t) - la / t AS hu, ln(t) - lb / t AS hv, pa * pb / (t * (t - 1) / 2) AS chance FROM tt JOIN sa USING (g) JOIN sb USING (g) JOIN mi USING (g) JOIN emi USING (g)),
score AS (SELECT g, (pc - chance) / ((pa + pb) / 2 - chance) AS ari, mi / ((hu + hv) / 2) AS nmi, (mi - emi) / ((hu + hv) / 2 - emi) AS ami,
  mi / hu AS homogeneity, mi / hv AS completeness, 2 * (mi / hu) * (mi / hv) / (mi / hu + mi / hv) AS v_measure, emi FROM ent)"""


LAB = "lab AS (SELECT subcategory AS u, cluster AS v FROM clean)"


def scores(spark, sf_dir, adjusted: bool = False):
    return partition.partition_scores(partition.contingency(cleaned(spark, sf_dir), "subcategory", "cluster"), adjusted=adjusted)


@query("e1_partition_shape", with_(CLEAN_SHORT, METHODS_SQL) + """SELECT method, count(DISTINCT cluster) AS num_clusters, count(*) AS num_samples,
round(count(*) / count(DISTINCT cluster), 6) AS cluster_density FROM methods GROUP BY 1""")
def e1(spark, sf_dir):
    return rounded(quality.partition_shape(methods(spark, sf_dir), ["method"]))


@query("e5_cluster_size_stats", with_(CLEAN_SHORT, METHODS_SQL) + """, s AS (SELECT method, cluster, count(*) AS n FROM methods GROUP BY 1, 2)
SELECT method, min(n) AS min_cluster_size, max(n) AS max_cluster_size, round(avg(n), 6) AS mean_cluster_size, median(n) AS median_cluster_size,
round(stddev_samp(n), 6) AS std_cluster_size, round(stddev_samp(n) / avg(n), 6) AS cluster_size_cv,
round((count(*) FILTER (WHERE n < (SELECT count(*) FROM clean) * CAST(0.01 AS DOUBLE))) * 100 / count(*), 6) AS small_clusters_pct FROM s GROUP BY 1""")
def e5(spark, sf_dir):
    return rounded(quality.cluster_size_stats(methods(spark, sf_dir), ["method"]))


@query("e7_adjusted_rand", with_(CLEAN_SHORT, LAB, partition_sql("lab")) + "SELECT round(ari, 6) AS ari FROM score")
def e7(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("ari"))


@query("e8_normalized_mutual_info", with_(CLEAN_SHORT, LAB, partition_sql("lab")) + "SELECT round(nmi, 6) AS nmi FROM score")
def e8(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("nmi"))


@query("e9_adjusted_mutual_info", with_(CLEAN_SHORT, LAB, partition_sql("lab")) + "SELECT round(ami, 6) AS ami, round(emi, 6) AS emi FROM score")
def e9(spark, sf_dir):
    return rounded(scores(spark, sf_dir, True).select("ami", "emi"))


@query("e10_homogeneity_completeness_v", with_(CLEAN_SHORT, LAB, partition_sql("lab"))
       + "SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(v_measure, 6) AS v_measure FROM score")
def e10(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("homogeneity", "completeness", "v_measure"))


_PURITY = """(SELECT sum(CASE WHEN v = -1 THEN 0 ELSE top END) / sum(n) FROM (SELECT v, max(c) AS top, sum(c) AS n FROM
(SELECT u, v, CAST(count(*) AS DOUBLE) AS c FROM lab GROUP BY 1, 2) GROUP BY 1))"""


@query("e11_purity", with_(CLEAN_SHORT, LAB) + f"SELECT round({_PURITY}, 6) AS purity")
def e11(spark, sf_dir):
    return rounded(partition.purity(partition.contingency(cleaned(spark, sf_dir), "subcategory", "cluster")))


@query("e12_division_recovery", with_(CLEAN_SHORT, "lab AS (SELECT division AS u, cluster AS v FROM clean)", partition_sql("lab"))
       + f"""SELECT round(ari, 6) AS adjusted_rand_index, round(nmi, 6) AS normalized_mutual_info, round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness,
round(v_measure, 6) AS v_measure, round({_PURITY}, 6) AS purity, CAST(NULL AS VARCHAR) AS warning FROM score""")
def e12(spark, sf_dir):
    return rounded(partition.division_recovery(cleaned(spark, sf_dir)))


@query("e13_centroid_separability", with_(CLEAN, METHODS_SQL.replace("division, subcategory, ", "division, subcategory, description, ")) + """, m AS (SELECT method, cluster, avg(price) AS a, avg(length(title)) AS b,
avg(length(description)) AS c FROM methods GROUP BY 1, 2), d AS (SELECT x.method, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) AS d FROM m x JOIN m y ON x.method = y.method AND x.cluster < y.cluster)
SELECT method, round(avg(d), 6) AS avg_centroid_distance, round(min(d), 6) AS min_centroid_distance FROM d GROUP BY 1""")
def e13(spark, sf_dir):
    from aislemap.operators.clean import text_lengths

    df = materialise(text_lengths(cleaned(spark, sf_dir, True)).drop("description"))
    return rounded(quality.centroid_separability(label_methods(df), ["method"]))


@query("e14_seller_concentration", with_(CLEAN_SHORT, METHODS_SQL) + """, c AS (SELECT method, cluster, seller, count(*) AS n FROM methods GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY method, cluster ORDER BY n DESC, seller) AS k, sum(n) OVER (PARTITION BY method, cluster) AS t FROM c),
p AS (SELECT method, cluster, CAST(max(n) AS DOUBLE) / max(t) AS p1, CAST(sum(n) FILTER (WHERE k <= 3) AS DOUBLE) / max(t) AS p3 FROM r GROUP BY 1, 2)
SELECT method, round(avg(p1), 6) AS avg_top_seller_concentration, round(avg(p3), 6) AS avg_top3_seller_concentration, count(*) FILTER (WHERE p1 > 0.8) AS high_concentration_clusters FROM p GROUP BY 1""")
def e14(spark, sf_dir):
    return rounded(quality.seller_concentration(methods(spark, sf_dir), ["method"]))


@query("e15_price_homogeneity", with_(CLEAN_SHORT, METHODS_SQL) + """, p AS (SELECT method, cluster, stddev_samp(price) / avg(price) AS cv, (max(price) - min(price)) / avg(price) AS rr FROM methods GROUP BY 1, 2)
SELECT method, round(avg(cv), 6) AS avg_price_cv, round(1 - avg(cv), 6) AS price_homogeneity, round(avg(rr), 6) AS avg_price_range_ratio FROM p GROUP BY 1""")
def e15(spark, sf_dir):
    return rounded(quality.price_homogeneity(methods(spark, sf_dir), ["method"]))


@query("e16_noise_percent", with_(CLEAN_SHORT, METHODS_SQL) + """SELECT method, CASE WHEN count(*) FILTER (WHERE cluster = -1) > 0
THEN round((count(*) FILTER (WHERE cluster = -1)) * 100 / count(*), 6) END AS noise_percent FROM methods GROUP BY 1""")
def e16(spark, sf_dir):
    return rounded(quality.noise_percent(methods(spark, sf_dir), ["method"]))


@query("e17_topic_coherence", "SELECT max(CAST(quality AS DOUBLE)) AS topic_coherence FROM labels")
def e17(spark, sf_dir):
    summary = table(spark, sf_dir, "labels").withColumnRenamed("quality", "coherence_score")
    return quality.topic_coherence(summary)


_TITLES = """lab AS (SELECT a AS u, b AS v FROM (SELECT title, cluster AS a FROM clean) x JOIN
(SELECT p_name || ' ' || p_brand AS title, p_size % 7 AS b FROM part) y USING (title))"""


@query("e19_method_agreement", with_(CLEAN_SHORT, _TITLES, partition_sql("lab")) + """SELECT round(ari, 6) AS adjusted_rand_score, round(ami, 6) AS adjusted_mutual_info,
(SELECT count(DISTINCT cluster) FROM clean) AS traditional_clusters, (SELECT count(DISTINCT p_size % 7) FROM part) AS transformer_clusters FROM score""")
def e19(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("title"), (F.col("p_size") % 7).alias("cluster"))
    return rounded(quality.method_agreement(cleaned(spark, sf_dir), part))


_EXTERNAL = ", ".join(
    f"round(max(CASE WHEN g LIKE '%|{t}' THEN {src} END), 6) AS {t}_{out}"
    for t in ("division", "subcategory") for out, src in (("rand_score", "ari"), ("mutual_info", "ami"), ("nmi", "nmi"))
)
EXTERNAL_SQL = """lab AS (SELECT method || '|division' AS k, division AS u, cluster AS v FROM methods UNION ALL SELECT method || '|subcategory', subcategory, cluster FROM methods),""" \
    + partition_sql("lab", "k")


@query("e20_external_metrics", with_(CLEAN_SHORT, METHODS_SQL, EXTERNAL_SQL) + f"SELECT split_part(g, '|', 1) AS method, {_EXTERNAL} FROM score GROUP BY 1")
def e20(spark, sf_dir):
    return rounded(quality.external_metrics(methods(spark, sf_dir), ["method"]))


# ---- vector space ---------------------------------------------------------------

_SIL = """pair AS (SELECT a.listing_id, a.cluster AS own, b.cluster AS k, sum(list_distance(a.vec, b.vec)) AS s, count(*) AS n FROM vec a, vec b GROUP BY 1, 2, 3),
ab AS (SELECT listing_id, own, max(CASE WHEN own = k THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = k THEN n END) AS n_own,
min(CASE WHEN own <> k THEN s / n END) AS b FROM pair GROUP BY 1, 2),
sil AS (SELECT listing_id, own AS cluster, CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS silhouette FROM ab)"""
_CH = """g AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM flat GROUP BY 1)),
ch AS (SELECT (sum(n * list_distance(c, (SELECT g FROM g)) ** 2) / (count(*) - 1)) / ((SELECT sum(list_distance(vec, c) ** 2) FROM vec JOIN center USING (cluster)) / (sum(n) - count(*))) AS ch
FROM center JOIN (SELECT cluster, count(*) AS n FROM vec GROUP BY 1) USING (cluster))"""
_DB = """sp AS (SELECT cluster, c, avg(list_distance(vec, c)) AS s FROM vec JOIN center USING (cluster) GROUP BY 1, 2),
db AS (SELECT avg(r) AS db FROM (SELECT x.cluster, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sp x JOIN sp y ON x.cluster <> y.cluster GROUP BY 1))"""


@query("e2_silhouette", with_(VEC, _SIL) + "SELECT round(avg(silhouette), 6) AS silhouette_score FROM sil")
def e2(spark, sf_dir):
    return rounded(quality.silhouette(labelled(spark, sf_dir)))


@query("e2_silhouette_rows", with_(VEC, _SIL) + "SELECT listing_id, cluster, round(silhouette, 6) AS silhouette FROM sil")
def e2_rows(spark, sf_dir):
    return rounded(quality.silhouette_rows(labelled(spark, sf_dir)))


@query("e3_calinski_harabasz", with_(VEC, CENTER, _CH) + "SELECT round(ch, 6) AS calinski_harabasz FROM ch")
def e3(spark, sf_dir):
    return rounded(quality.calinski_harabasz(labelled(spark, sf_dir)))


@query("e4_davies_bouldin", with_(VEC, CENTER, _DB) + "SELECT round(db, 6) AS davies_bouldin FROM db")
def e4(spark, sf_dir):
    return rounded(quality.davies_bouldin(labelled(spark, sf_dir)))


@query("e18_basic_cluster_metrics", with_(VEC, CENTER, _SIL, _CH, _DB) + """SELECT (SELECT count(DISTINCT cluster) FROM vec) AS num_clusters, (SELECT round(avg(silhouette), 6) FROM sil) AS silhouette,
(SELECT round(db, 6) FROM db) AS davies_bouldin, (SELECT round(ch, 6) FROM ch) AS calinski_harabasz, CAST(NULL AS DOUBLE) AS noise_percentage""")
def e18(spark, sf_dir):
    return rounded(quality.basic_cluster_metrics(labelled(spark, sf_dir)))


@query("c4_cluster_centroids", with_(VEC, CENTER) + "SELECT cluster, CAST(i AS BIGINT) AS component, round(x, 6) AS value FROM (SELECT cluster, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM center)")
def c4(spark, sf_dir):
    from aislemap.operators.describe import cluster_centroids

    df = cluster_centroids(labelled(spark, sf_dir)).select("cluster", F.posexplode("centroid").alias("component", "value"))
    return df.select("cluster", (F.col("component") + 1).cast("bigint").alias("component"), _r("value"))
