"""Queries that describe clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislemap.operators import describe, quality
from aislemap.sources.warehouse import table, vectors
from catalog_queries.cleaning import cleaned
from catalog_queries.oracle import CLEAN_SHORT, with_
from catalog_queries.registry import Registry

QUERIES = Registry()
query = QUERIES.query


def _r(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


def _top_sql(key: str, k: int) -> str:
    return f"""SELECT cluster, {key}, n, rank FROM (SELECT cluster, {key}, count(*) AS n,
CAST(row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {key}) AS INTEGER) AS rank FROM clean GROUP BY 1, 2) WHERE rank <= {k}"""


@query("a1_cluster_sizes", with_(CLEAN_SHORT) + "SELECT cluster, count(*) AS size FROM clean GROUP BY 1")
def a1(spark, sf_dir):
    return describe.cluster_sizes(cleaned(spark, sf_dir)).orderBy("cluster")


@query("a2_top_subcategories", with_(CLEAN_SHORT) + _top_sql("subcategory", 5))
def a2(spark, sf_dir):
    return describe.top_k_per_cluster(cleaned(spark, sf_dir), "subcategory", 5)


@query("a3_top_sellers", with_(CLEAN_SHORT) + _top_sql("seller", 3))
def a3(spark, sf_dir):
    return describe.top_k_per_cluster(cleaned(spark, sf_dir), "seller", 3)


@query("a4_cluster_price_range", with_(CLEAN_SHORT) + "SELECT cluster, min(price) AS price_min, round(avg(price), 6) AS price_mean, max(price) AS price_max FROM clean GROUP BY 1")
def a4(spark, sf_dir):
    df = describe.cluster_price_range(cleaned(spark, sf_dir))
    return df.select("cluster", "price_min", _r("price_mean"), "price_max")


_FIRST = """SELECT cluster, listing_id, title, rank FROM (SELECT cluster, listing_id, title,
CAST(row_number() OVER (PARTITION BY cluster ORDER BY listing_id) AS INTEGER) AS rank FROM clean) WHERE rank <= {k}"""


@query("a5_cluster_first_titles", with_(CLEAN_SHORT) + _FIRST.format(k=5))
def a5(spark, sf_dir):
    return describe.cluster_first_titles(cleaned(spark, sf_dir), 5)


VEC = """vec AS (SELECT vec_id AS listing_id, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster FROM embeddings)"""
CENTER = """flat AS (SELECT cluster, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM vec),
center AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS m FROM flat GROUP BY 1, 2) GROUP BY 1)"""


def labelled(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("label", "cluster")


@query("a6_cluster_representatives", with_(VEC, CENTER) + """SELECT cluster, listing_id, round(d, 6) AS distance, rank FROM (SELECT cluster, listing_id, d,
CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(d, 9), listing_id) AS INTEGER) AS rank FROM (SELECT v.cluster, listing_id, list_distance(vec, c) AS d
FROM vec v JOIN center USING (cluster))) WHERE rank <= 5""")
def a6(spark, sf_dir):
    return describe.cluster_representatives(labelled(spark, sf_dir), "vec", 5).select("cluster", "listing_id", _r("distance"), "rank")


# Back-projection on a term space both engines can build: words of the part names
# against part brands as components, loadings = mean price of the pair.
_TERMS_SQL = """
load AS (SELECT p_brand AS component, w AS term, avg(p_retailprice) AS loading FROM
  (SELECT p_brand, p_retailprice, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1, 2),
cent AS (SELECT cluster, p_brand AS component, avg(l_quantity) AS value FROM
  (SELECT p_size % 20 AS cluster, p_brand, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2),
w AS (SELECT cluster, term, round(sum(value * loading), 9) AS weight FROM cent JOIN load USING (component) GROUP BY 1, 2)
SELECT cluster, term, round(weight, 4) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS INTEGER) AS rank FROM w) WHERE rank <= 10"""


@query("a7_cluster_top_terms", "WITH " + _TERMS_SQL)
def a7(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = part.select("p_brand", "p_retailprice", F.explode(F.split("p_name", " ")).alias("term"))
    components = words.groupBy(F.col("p_brand").alias("component"), "term").agg(F.avg("p_retailprice").alias("loading"))
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    centers = line.groupBy((F.col("p_size") % 20).alias("cluster"), F.col("p_brand").alias("component")).agg(F.avg("l_quantity").alias("value"))
    top = describe.cluster_top_terms(centers, components, 10)
    return top.select("cluster", "term", _r("weight", 4), "rank")


@query("a8_cluster_summary", with_(CLEAN_SHORT, f"subs AS ({_top_sql('subcategory', 5)})", f"sel AS ({_top_sql('seller', 3)})", f"tit AS ({_FIRST.format(k=5)})")
       + """SELECT b.cluster, size, price_min, price_mean, price_max, is_noise_cluster, top_subcategories, top_sellers, sample_products FROM
(SELECT cluster, count(*) AS size, min(price) AS price_min, round(avg(price), 6) AS price_mean, max(price) AS price_max, cluster = -1 AS is_noise_cluster FROM clean GROUP BY 1) b
JOIN (SELECT cluster, string_agg(subcategory || '=' || n, ';' ORDER BY rank) AS top_subcategories FROM subs GROUP BY 1) USING (cluster)
JOIN (SELECT cluster, string_agg(seller || '=' || n, ';' ORDER BY rank) AS top_sellers FROM sel GROUP BY 1) USING (cluster)
JOIN (SELECT cluster, string_agg(title, ';' ORDER BY rank) AS sample_products FROM tit GROUP BY 1) USING (cluster)""")
def a8(spark, sf_dir):
    df = describe.cluster_summary(cleaned(spark, sf_dir), noise_cluster=-1)

    def flat(col):
        pairs = F.transform(F.map_entries(col), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.array_join(pairs, ";").alias(col)

    price = [F.round("price_range." + f, 6).alias("price_" + f) for f in ("min", "mean", "max")]
    return df.select("cluster", "size", *price, "is_noise_cluster", flat("top_subcategories"), flat("top_sellers"),
                     F.array_join("sample_products", ";").alias("sample_products"))


@query("a9_cluster_examples", with_(CLEAN_SHORT) + """, k AS (SELECT cluster, listing_id, title, CAST(row_number() OVER (PARTITION BY cluster ORDER BY md5(CAST(listing_id AS VARCHAR) || '-42'), listing_id) AS INTEGER) AS rank,
count(*) OVER (PARTITION BY cluster) AS size, count(*) OVER () AS total FROM clean)
SELECT CASE WHEN cluster = -1 THEN 'Noise' ELSE 'Cluster ' || cluster END AS name, listing_id, title, rank, size, round(size * 100 / total, 6) AS percentage FROM k WHERE rank <= 10""")
def a9(spark, sf_dir):
    df = describe.cluster_examples(cleaned(spark, sf_dir), 10)
    return df.select("name", "listing_id", "title", "rank", "size", _r("percentage"))


@query("a10_crosstab_long", with_(CLEAN_SHORT) + "SELECT cluster, subcategory, count(*) AS n FROM clean GROUP BY 1, 2")
def a10(spark, sf_dir):
    return describe.crosstab_long(cleaned(spark, sf_dir), "cluster", "subcategory")


_PCT = """tot AS (SELECT cluster, count(*) AS total FROM clean GROUP BY 1),
cell AS (SELECT cluster, subcategory, count(*) AS n FROM clean GROUP BY 1, 2),
sub AS (SELECT subcategory, count(*) AS n FROM clean GROUP BY 1)"""


@query("a11_crosstab_row_pct", with_(CLEAN_SHORT, _PCT) + """SELECT tot.cluster, sub.subcategory, coalesce(cell.n, 0) AS n, round(coalesce(cell.n, 0) * 100 / total, 6) AS pct
FROM tot CROSS JOIN sub LEFT JOIN cell ON cell.cluster = tot.cluster AND cell.subcategory = sub.subcategory""")
def a11(spark, sf_dir):
    df = describe.crosstab_row_pct(cleaned(spark, sf_dir), "cluster", "subcategory")
    return df.select("cluster", "subcategory", "n", _r("pct"))


def _heat_sql(subs: int, clusters: int | None) -> str:
    limit = f"ORDER BY total DESC, cluster LIMIT {clusters}" if clusters else ""
    return f"""SELECT t.cluster, s.subcategory, round(coalesce(cell.n, 0) * 100 / total, 6) AS pct FROM (SELECT * FROM tot {limit}) t
CROSS JOIN (SELECT subcategory FROM sub ORDER BY n DESC, subcategory LIMIT {subs}) s LEFT JOIN cell ON cell.cluster = t.cluster AND cell.subcategory = s.subcategory"""


@query("a12_heatmap_top", with_(CLEAN_SHORT, _PCT) + _heat_sql(15, 20))
def a12(spark, sf_dir):
    return describe.heatmap_top(cleaned(spark, sf_dir)).select("cluster", "subcategory", _r("pct"))


@query("a13_heatmap_top_global", with_(CLEAN_SHORT, _PCT) + _heat_sql(20, None))
def a13(spark, sf_dir):
    return describe.heatmap_top_global(cleaned(spark, sf_dir)).select("cluster", "subcategory", _r("pct"))


@query("a14_seller_share", with_(CLEAN_SHORT) + """, s AS (SELECT seller FROM clean GROUP BY 1 ORDER BY count(*) DESC, seller LIMIT 10),
c AS (SELECT cluster, seller, count(*) AS n FROM clean WHERE seller IN (SELECT seller FROM s) GROUP BY 1, 2), t AS (SELECT cluster, sum(n) AS total FROM c GROUP BY 1)
SELECT t.cluster, s.seller, round(coalesce(c.n, 0) * 100 / CAST(total AS DOUBLE), 6) AS pct FROM t CROSS JOIN s LEFT JOIN c ON c.cluster = t.cluster AND c.seller = s.seller""")
def a14(spark, sf_dir):
    return describe.seller_share(cleaned(spark, sf_dir)).select("cluster", "seller", _r("pct"))


@query("a15_topic_sizes", with_(CLEAN_SHORT) + """SELECT cluster, count(*) AS size, (SELECT count(DISTINCT cluster) FROM clean WHERE cluster <> -1) AS n_topics,
(SELECT count(*) FROM clean WHERE cluster = -1) AS n_outliers, round((SELECT count(*) FROM clean WHERE cluster = -1) * 100 / (SELECT count(*) FROM clean), 6) AS outlier_percent FROM clean GROUP BY 1""")
def a15(spark, sf_dir):
    df = describe.topic_sizes(cleaned(spark, sf_dir))
    return df.select("cluster", "size", "n_topics", "n_outliers", _r("outlier_percent"))


@query("a16_largest_clusters", with_(CLEAN_SHORT, f"subs AS ({_top_sql('subcategory', 3)})", f"tit AS ({_FIRST.format(k=3)})",
       "big AS (SELECT cluster, count(*) AS size FROM clean GROUP BY 1 ORDER BY size DESC, cluster LIMIT 5)")
       + """SELECT cluster, 'subcategory' AS kind, rank, subcategory AS value, n, size FROM subs JOIN big USING (cluster)
UNION ALL SELECT cluster, 'title', rank, title, NULL, size FROM tit JOIN big USING (cluster)""")
def a16(spark, sf_dir):
    return describe.largest_clusters(cleaned(spark, sf_dir)).select("cluster", "kind", "rank", "value", "n", "size")


@query("j1_match_methods_by_title", """SELECT p1.title, a AS cluster_traditional, b AS cluster_transformer FROM
(SELECT p_name || ' ' || p_brand AS title, p_size % 20 AS a FROM part) p1 JOIN (SELECT p_name || ' ' || p_brand AS title, p_size % 7 AS b FROM part) p2 USING (title)""")
def j1(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_brand"))
    a = part.withColumn("cluster", F.col("p_size") % 20)
    b = part.withColumn("cluster", F.col("p_size") % 7)
    return quality.match_methods(a, b)


@query("j4_attach_vectors", """SELECT vec_id AS listing_id, label, len(embedding) AS dims, n_chars FROM embeddings JOIN documents ON vec_id = doc_id""")
def j4(spark, sf_dir):
    from aislemap.sources.listings import attach_vectors

    listed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"), "n_chars")
    df = attach_vectors(listed, vectors(spark, sf_dir))
    return df.select("listing_id", "label", F.size("vec").cast("bigint").alias("dims"), "n_chars")
