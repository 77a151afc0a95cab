"""Queries for vector operators and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from aislemap.operators import density, features, kmeans, topics, vectors as vx, ward
from aislemap.session import materialise
from aislemap.sources.warehouse import products, vectors
from catalog_queries.cleaning import cleaned
from catalog_queries.describing import CENTER, VEC, labelled
from catalog_queries.oracle import with_
from catalog_queries.registry import Registry
from catalog_queries.scoring import rounded

QUERIES = Registry()
query = QUERIES.query


@query("r2_explained_variance", with_(VEC) + """, f AS (SELECT i, var_pop(x) AS v FROM (SELECT generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM vec) GROUP BY 1)
SELECT CAST(i - 1 AS INTEGER) AS component, round(v / (SELECT sum(v) FROM f), 6) AS ratio FROM f WHERE i <= 20""")
def r2(spark, sf_dir):
    full = vectors(spark, sf_dir)
    return rounded(vx.explained_variance(full, full.withColumn("vec", F.slice("vec", 1, 20))))


@query("r3_append_scaled", "SELECT vec_id AS listing_id, len(embedding) + 1 AS dims, round(CAST(label AS DOUBLE) * 0.2, 6) AS last_value FROM embeddings")
def r3(spark, sf_dir):
    df = features.append_scaled(vectors(spark, sf_dir).withColumn("p", F.col("label") * 0.2), "vec", "p")
    return df.select("listing_id", F.size("vec").cast("bigint").alias("dims"), F.round(F.element_at("vec", -1), 6).alias("last_value"))


@query("r4_seeded_sample", "SELECT vec_id AS listing_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id LIMIT 100")
def r4(spark, sf_dir):
    return vx.seeded_sample(vectors(spark, sf_dir), 100).select("listing_id")


def _knn_sql(distance: str) -> str:
    return f"""SELECT id, neighbour_id, round(d, 6) AS distance, rank FROM (SELECT a.listing_id AS id, b.listing_id AS neighbour_id, {distance} AS d,
CAST(row_number() OVER (PARTITION BY a.listing_id ORDER BY {distance}, b.listing_id) AS INTEGER) AS rank FROM vec a JOIN vec b ON a.listing_id <> b.listing_id) WHERE rank <= 15"""


@query("r5_knn_graph_euclidean", with_(VEC) + _knn_sql("list_distance(a.vec, b.vec)"))
def r5(spark, sf_dir):
    return rounded(vx.knn_graph(vectors(spark, sf_dir), 15))


@query("r5_knn_graph_cosine", with_(VEC) + _knn_sql("(1 - list_cosine_similarity(a.vec, b.vec))"))
def r5_cosine(spark, sf_dir):
    return rounded(vx.knn_graph(vectors(spark, sf_dir), 15, "cosine"))


@query("r1_truncated_svd")
def r1(spark, sf_dir):
    rows, _ = features.feature_vectors(products(spark, sf_dir))
    return vx.truncated_svd(rows).vectors


@query("r6_project_2d")
def r6(spark, sf_dir):
    return vx.project_2d(vectors(spark, sf_dir))


@query("r7_zoom_bounds", with_(VEC) + """SELECT round(x0 - 0.1 * (x1 - x0), 6) AS x_min, round(x1 + 0.1 * (x1 - x0), 6) AS x_max, round(y0 - 0.1 * (y1 - y0), 6) AS y_min, round(y1 + 0.1 * (y1 - y0), 6) AS y_max FROM
(SELECT quantile_cont(vec[1], 0.025) AS x0, quantile_cont(vec[1], 0.975) AS x1, quantile_cont(vec[2], 0.025) AS y0, quantile_cont(vec[2], 0.975) AS y1 FROM vec WHERE cluster <> 0)""")
def r7(spark, sf_dir):
    df = labelled(spark, sf_dir).select(F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")).alias("cluster"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return rounded(vx.zoom_bounds(df))


def _round_sql(n: int) -> str:
    """One assignment round and the centroids of its groups."""
    return f"""a{n} AS (SELECT listing_id, vec, arg_min(k, (d, k)) AS k FROM (SELECT listing_id, vec, c{n}.k, list_distance(vec, c) AS d FROM vec, c{n}) GROUP BY 1, 2),
c{n + 1} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS m FROM (SELECT k, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM a{n}) GROUP BY 1, 2) GROUP BY 1)"""


@query("c3_assign_nearest", with_(VEC, "c1 AS (SELECT row_number() OVER (ORDER BY listing_id) - 1 AS k, vec AS c FROM vec ORDER BY listing_id LIMIT 10)", _round_sql(1), _round_sql(2), _round_sql(3))
       + "SELECT listing_id, CAST(k AS INTEGER) AS cluster FROM a3")
def c3(spark, sf_dir):
    return kmeans.lloyd(vectors(spark, sf_dir), 10, 3).select("listing_id", "cluster")


@query("c1_kmeans")
def c1(spark, sf_dir):
    return kmeans.kmeans(vectors(spark, sf_dir), 10).select("listing_id", "cluster")


@query("c2_kmeans_fast")
def c2(spark, sf_dir):
    return kmeans.kmeans_fast(vectors(spark, sf_dir), 10).select("listing_id", "cluster")


def _inertia_sql(k: int, rounds: int) -> str:
    parts = [VEC, f"c1 AS (SELECT row_number() OVER (ORDER BY listing_id) - 1 AS k, vec AS c FROM vec ORDER BY listing_id LIMIT {k})"]
    parts += [_round_sql(i + 1) for i in range(rounds)]
    last = f"c{rounds + 1}"
    return f"({with_(*parts)} SELECT {k} AS k, round(sum(d), 6) AS inertia FROM (SELECT min(power(list_distance(vec, c), 2)) AS d FROM vec, {last} GROUP BY listing_id))"


@query("c5_fit_many", " UNION ALL ".join(_inertia_sql(k, 3) for k in (5, 10, 20)))
def c5_fit_many(spark, sf_dir):
    """Three sizes fitted at once, three rounds from the rows with the lowest ids."""
    rows = vectors(spark, sf_dir)
    first = np.array(rows.orderBy("listing_id").limit(20).select("vec").toPandas()["vec"].tolist(), dtype=float)
    _, costs = kmeans.fit_many(materialise(rows), {(k, 0): first[:k] for k in (5, 10, 20)}, 3, 0.0)
    return spark.createDataFrame([(k, round(c, 6)) for (k, _), c in costs.items()], "k int, inertia double")


@query("c5_sweep_k")
def c5(spark, sf_dir):
    return kmeans.sweep_k(vectors(spark, sf_dir), range(50, 301, 5), restarts=3)


@query("c5_select_best_k", """SELECT k, silhouette FROM (SELECT CAST(p_size AS INTEGER) AS k, round(avg(l_discount), 9) AS silhouette
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ORDER BY silhouette DESC, k LIMIT 1""")
def c5_best(spark, sf_dir):
    from aislemap.sources.warehouse import table

    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    scores = line.groupBy(F.col("p_size").alias("k")).agg(F.round(F.avg("l_discount"), 9).alias("silhouette"))
    return kmeans.select_best_k(scores).select("k", "silhouette")


@query("c6_elbow")
def c6(spark, sf_dir):
    return kmeans.elbow(vectors(spark, sf_dir))


_RELABEL = "SELECT listing_id, CASE WHEN label < 2 THEN (SELECT max(label) FROM embeddings) + 1 ELSE label END AS cluster, label < 2 AS is_noise FROM (SELECT vec_id AS listing_id, label FROM embeddings)"


@query("c11_relabel_noise", _RELABEL)
def c11(spark, sf_dir):
    from aislemap.operators.density import relabel_noise

    df = vectors(spark, sf_dir).withColumn("cluster", F.when(F.col("label") < 2, -1).otherwise(F.col("label")))
    return relabel_noise(df).select("listing_id", "cluster", "is_noise")


_CORE = """nd AS (SELECT a.listing_id AS id, b.listing_id AS neighbour_id, list_distance(a.vec, b.vec) AS d,
row_number() OVER (PARTITION BY a.listing_id ORDER BY list_distance(a.vec, b.vec), b.listing_id) AS r FROM vec a JOIN vec b ON a.listing_id <> b.listing_id),
core AS (SELECT id, max(d) AS core FROM nd WHERE r <= 10 GROUP BY 1)"""


@query("c9a_core_distance", with_(VEC, _CORE) + "SELECT id, round(core, 6) AS core FROM core")
def c9a(spark, sf_dir):
    return rounded(density.core_distances(vx.knn_graph(vectors(spark, sf_dir), 10)))


@query("c9b_mutual_reachability", with_(VEC, _CORE) + """SELECT nd.id, nd.neighbour_id, round(greatest(nd.d, a.core, b.core), 6) AS weight
FROM nd JOIN core a ON a.id = nd.id JOIN core b ON b.id = nd.neighbour_id WHERE r <= 10""")
def c9b(spark, sf_dir):
    graph = materialise(vx.knn_graph(vectors(spark, sf_dir), 10))
    return rounded(density.mutual_reachability(graph, density.core_distances(graph)))


@query("c9c_spanning_tree")
def c9c(spark, sf_dir):
    points = vectors(spark, sf_dir).select(F.col("listing_id").alias("id"), "vec")
    graph = materialise(vx.knn_graph(points, 10, id_col="id"))
    return rounded(density.spanning_tree(materialise(points.join(density.core_distances(graph), "id")), graph))


@query("c9_density_cluster")
def c9(spark, sf_dir):
    return density.density_cluster(vectors(spark, sf_dir), 10, 5).select("listing_id", "cluster")


@query("c12_density_grid")
def c12_grid(spark, sf_dir):
    """The settings grid over one neighbour search, as the choice of settings reads it."""
    return rounded(density.sweep_density(vectors(spark, sf_dir), [(size, samples) for samples in (5, 10) for size in (10, 20, 40)]))


@query("c10_membership_probability")
def c10(spark, sf_dir):
    df = density.density_cluster(vectors(spark, sf_dir), 10, 5, "leaf")
    return rounded(df.select("listing_id", "cluster", "probability"))


@query("c7_ward_cluster")
def c7(spark, sf_dir):
    return ward.ward_cluster(vectors(spark, sf_dir), 10).select("listing_id", "cluster")


@query("c8_merge_tree")
def c8(spark, sf_dir):
    return rounded(ward.merge_tree(ward.ward_tree(vectors(spark, sf_dir))))


@query("c7_ward_totals", with_(VEC) + """, f AS (SELECT i, sum(x * x) - sum(x) * sum(x) / count(*) AS squares, count(*) AS n FROM (SELECT generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM vec) GROUP BY 1)
SELECT max(n)::BIGINT AS n_rows, max(n)::BIGINT - 1 AS n_merges, max(n)::BIGINT AS last_size, round(sum(squares), 6) AS squares, 10::BIGINT AS n_clusters, 0.0::DOUBLE AS cut_gap FROM f""")
def c7_totals(spark, sf_dir):
    """What any Ward tree keeps: its costs sum to all squares around the mean, those below a cut to the squares inside the clusters."""
    rows = vectors(spark, sf_dir)
    tree = ward.ward_tree(rows)
    cut = materialise(rows.join(ward.cut_tree(tree, 10).withColumnRenamed("id", "listing_id"), "listing_id").select("cluster", "vec"))
    axes = cut.select("cluster", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    within = axes.agg(F.sum(F.col("v") * F.col("n")).alias("within"))
    cost = F.col("height") * F.col("height") / 2
    merges = tree.merges.agg(
        F.count("*").alias("n_merges"), F.max("size").alias("last_size"), F.sum(cost).alias("squares"),
        F.sum(F.when(F.col("step") <= tree.n_leaves - 10, cost)).alias("below"),
    )
    out = merges.withColumn("within", within.scalar()).withColumn("n_clusters", cut.agg(F.count_distinct("cluster")).scalar())
    gap = F.round(F.abs(F.col("within") - F.col("below")) / F.col("squares"), 6)
    return out.select((F.col("n_merges") + 1).alias("n_rows"), "n_merges", "last_size", F.round("squares", 6).alias("squares"), "n_clusters", gap.alias("cut_gap"))


@query("c13_topic_model")
def c13(spark, sf_dir):
    rows, _ = topics.topic_model(products(spark, sf_dir).select("listing_id", "title"), "title")
    return rows.select("listing_id", "cluster", F.round("probability", 6).alias("probability"))


@query("c14_topic_probability", with_(VEC, CENTER) + """SELECT listing_id, round(max(1 / d) / sum(1 / d), 6) AS probability FROM
(SELECT listing_id, list_distance(vec, c) AS d FROM vec, center) GROUP BY 1""")
def c14(spark, sf_dir):
    return rounded(topics.topic_probability(labelled(spark, sf_dir)).select("listing_id", "probability"))
