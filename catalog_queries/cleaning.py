"""Queries for sources, price and field cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislemap.functions.price import clean_price_currency, clean_price_decimal_comma, price_band
from aislemap.operators import clean
from aislemap.plans.profiles import clean_listings, load_catalogue
from aislemap.session import ensure_checkpoint_dir
from aislemap.sources import listings as io
from aislemap.sources.warehouse import raw_listings, table
from catalog_queries.registry import Registry
from catalog_queries.oracle import CLEAN, CLEAN_SHORT, PRICE, PRICE_CURRENCY, PRICED, RAW, RAW_SHORT, with_

# Cleaned listings whose required fields leave out the description: every listing
# has one here, and queries that do not read the text should not have to join it.
SHORT_FIELDS = ("title", "division", "subcategory", "price", "seller")


def raw(spark: SparkSession, sf_dir: str, description: bool = False) -> DataFrame:
    return raw_listings(spark, sf_dir, description)


def priced(spark: SparkSession, sf_dir: str, description: bool = False) -> DataFrame:
    df = raw(spark, sf_dir, description).withColumn("price", clean_price_decimal_comma("price"))
    return clean.backfill_subcategory(clean.drop_invalid_price(df))


def cleaned(spark: SparkSession, sf_dir: str, description: bool = False, min_rows: int = 30) -> DataFrame:
    """The shared cleaning; without the description unless a query reads it."""
    if description:
        return clean_listings(raw(spark, sf_dir, True), "kmeans", min_rows)
    df = clean.drop_category(priced(spark, sf_dir))
    return clean.filter_small_groups(clean.require_fields(df, SHORT_FIELDS), "subcategory", min_rows)


QUERIES = Registry()
query = QUERIES.query

LISTED = "listing_id, title, seller, division, subcategory, cluster"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-trip-{name}-{uuid.uuid4().hex}"


@query("s1_read_listings", with_(RAW) + "SELECT listing_id, title, md5(description) AS description_md5, price, seller, division, category, subcategory FROM raw")
def s1(spark, sf_dir):
    path = _scratch(spark, "csv")
    # every listing carries the whole text of its document, so the text outgrows the tables; multi-line CSV is not split anyway
    raw(spark, sf_dir, True).drop("cluster").write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    df = io.read_listings(spark, path)
    return df.select("listing_id", "title", F.md5("description").alias("description_md5"), "price", "seller", "division", "category", "subcategory")


@query("s2_read_assignments", with_(CLEAN_SHORT) + "SELECT cluster, count(*) AS n, round(sum(price), 4) AS total FROM clean GROUP BY 1")
def s2(spark, sf_dir):
    path = _scratch(spark, "labels")
    io.write_assignments(cleaned(spark, sf_dir), path)
    labels, _ = io.read_assignments(spark, path)
    return labels.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("s3_write_filtered", with_(CLEAN_SHORT) + f"SELECT {LISTED}, price FROM clean")
def s3(spark, sf_dir):
    path = _scratch(spark, "filtered")
    io.write_listings(cleaned(spark, sf_dir), path)
    return spark.read.parquet(path).selectExpr(*LISTED.split(", "), "price")


@query("s4_write_assignments", with_(CLEAN_SHORT) + """SELECT 'kmeans' AS method, listing_id, cluster, false AS is_noise FROM clean
UNION ALL SELECT 'density', listing_id, cluster, cluster = -1 FROM clean""")
def s4(spark, sf_dir):
    path = _scratch(spark, "assignments")
    df = cleaned(spark, sf_dir).select("listing_id", "cluster")
    methods = F.explode(F.array(F.struct(F.lit("kmeans").alias("m"), F.lit(False).alias("f")),
                                F.struct(F.lit("density").alias("m"), (F.col("cluster") == -1).alias("f"))))
    df = df.withColumn("x", methods).select(F.col("x.m").alias("method"), "listing_id", "cluster", F.col("x.f").alias("is_noise"))
    io.write_assignments(df, path)
    stored, _ = io.read_assignments(spark, path)
    return stored.select("method", "listing_id", "cluster", "is_noise")


@query("s5_write_summary", with_(CLEAN_SHORT) + """SELECT cluster, count(*) AS size, round(avg(price), 6) AS price_mean,
arg_min(title, listing_id) AS first_title FROM clean GROUP BY 1""")
def s5(spark, sf_dir):
    from aislemap.operators.describe import cluster_summary

    path = _scratch(spark, "summary")
    io.write_summary(cluster_summary(cleaned(spark, sf_dir)), path)
    stored = spark.read.json(path)
    return stored.select(F.col("cluster").cast("int").alias("cluster"), "size", F.round("price_range.mean", 6).alias("price_mean"),
                         F.col("sample_products")[0].alias("first_title"))


@query("s6_write_vectors", "SELECT vec_id AS listing_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, len(embedding) AS dims FROM embeddings")
def s6(spark, sf_dir):
    from aislemap.sources.warehouse import vectors

    path = _scratch(spark, "vectors")
    io.write_vectors(vectors(spark, sf_dir), path)
    df = io.read_vectors(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return df.select("listing_id", F.round(total, 6).alias("total"), F.size("vec").cast("bigint").alias("dims"))


@query("s7_write_metrics", with_(CLEAN_SHORT) + """SELECT 'by_size' AS method, count(DISTINCT cluster) AS num_clusters, count(*) AS num_samples FROM clean
UNION ALL SELECT 'by_division', count(DISTINCT division), count(*) FROM clean""")
def s7(spark, sf_dir):
    path = _scratch(spark, "metrics")
    df = cleaned(spark, sf_dir)
    pairs = F.explode(F.create_map(F.lit("by_size"), F.col("cluster").cast("string"), F.lit("by_division"), F.col("division")))
    from aislemap.operators.quality import partition_shape

    shape = partition_shape(df.select(pairs.alias("method", "label")), ["method"], "label")
    io.write_metrics(shape.select("method", "num_clusters", "num_samples"), path)
    return spark.read.option("header", True).schema("method string, num_clusters bigint, num_samples bigint").csv(path)


@query("p1_clean_price_decimal_comma", with_(RAW_SHORT) + f"SELECT listing_id, price AS raw_price, {PRICE} AS price FROM raw")
def p1(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", F.col("price").alias("raw_price"), clean_price_decimal_comma("price").alias("price"))


@query("p2_clean_price_currency", with_(RAW_SHORT) + f"SELECT listing_id, price AS raw_price, {PRICE_CURRENCY} AS price FROM raw")
def p2(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", F.col("price").alias("raw_price"), clean_price_currency("price").alias("price"))


@query("p3_drop_invalid_price", with_(RAW_SHORT) + f"SELECT listing_id, {PRICE} AS price FROM raw WHERE ({PRICE}) IS NOT NULL")
def p3(spark, sf_dir):
    df = raw(spark, sf_dir).withColumn("price", clean_price_decimal_comma("price"))
    return clean.drop_invalid_price(df).select("listing_id", "price")


@query("p4_backfill_subcategory", with_(RAW_SHORT) + "SELECT listing_id, category, coalesce(subcategory, category) AS subcategory FROM raw")
def p4(spark, sf_dir):
    return clean.backfill_subcategory(raw(spark, sf_dir)).select("listing_id", "category", "subcategory")


@query("p5_drop_category", with_(RAW_SHORT) + "SELECT * EXCLUDE (category) FROM raw")
def p5(spark, sf_dir):
    return clean.drop_category(raw(spark, sf_dir))


@query("p6_require_fields", with_(RAW) + """SELECT listing_id, title, price, seller, subcategory, length(description) AS description_length FROM raw
WHERE title IS NOT NULL AND division IS NOT NULL AND subcategory IS NOT NULL AND description IS NOT NULL
AND price IS NOT NULL AND seller IS NOT NULL""")
def p6(spark, sf_dir):
    df = clean.require_fields(raw(spark, sf_dir, True))
    return df.select("listing_id", "title", "price", "seller", "subcategory", F.char_length("description").cast("bigint").alias("description_length"))


@query("p7_drop_exact_duplicates", with_(RAW) + f"""SELECT listing_id, title, price, seller, division, subcategory FROM
(SELECT min(listing_id) AS listing_id, title, description, {PRICE_CURRENCY} AS price, seller, division,
coalesce(subcategory, category) AS subcategory FROM raw GROUP BY ALL)""")
def p7(spark, sf_dir):
    df = load_catalogue(raw(spark, sf_dir, True).drop("cluster"))
    return df.select("listing_id", "title", "price", "seller", "division", "subcategory")


@query("p8_filter_small_groups", with_(RAW_SHORT, PRICED) + """SELECT listing_id, subcategory FROM priced WHERE subcategory IN
(SELECT subcategory FROM priced GROUP BY 1 HAVING count(*) >= 30)""")
def p8(spark, sf_dir):
    return clean.filter_small_groups(priced(spark, sf_dir), "subcategory", 30).select("listing_id", "subcategory")


@query("p9_filter_group_quantiles", with_(RAW_SHORT, PRICED) + """, lim AS (SELECT subcategory, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi
FROM priced GROUP BY 1) SELECT listing_id, subcategory, price FROM priced JOIN lim USING (subcategory) WHERE price >= lo AND price <= hi""")
def p9(spark, sf_dir):
    return clean.filter_group_quantiles(priced(spark, sf_dir), "subcategory", "price").select("listing_id", "subcategory", "price")


@query("p10_price_band_text", with_(RAW_SHORT, PRICED) + """SELECT listing_id, price,
CASE WHEN price < 50 THEN 'low price' WHEN price < 200 THEN 'medium price' ELSE 'high price' END AS band FROM priced""")
def p10(spark, sf_dir):
    return priced(spark, sf_dir).select("listing_id", "price", price_band("price").alias("band"))


_FLAGS = """SELECT listing_id, CAST(price < {lo} AS DOUBLE) AS price_low, CAST(price >= {lo} AND price < {hi} AS DOUBLE) AS price_medium,
CAST(price >= {hi} AS DOUBLE) AS price_high FROM clean"""
_FLAG_COLS = ("listing_id", "price_low", "price_medium", "price_high")


@query("p11_price_flags_quartile", with_(CLEAN_SHORT, "q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM clean)")
       + _FLAGS.format(lo="(SELECT a FROM q)", hi="(SELECT b FROM q)"))
def p11(spark, sf_dir):
    return clean.price_flags_quartile(cleaned(spark, sf_dir)).select(*_FLAG_COLS)


@query("p12_price_flags_fixed", with_(CLEAN_SHORT) + _FLAGS.format(lo="50", hi="200"))
def p12(spark, sf_dir):
    return clean.price_flags_fixed(cleaned(spark, sf_dir)).select(*_FLAG_COLS)


@query("p13_price_log_standard", with_(CLEAN_SHORT, "m AS (SELECT avg(ln(1 + price)) AS mu, stddev_pop(ln(1 + price)) AS sd FROM clean)")
       + "SELECT listing_id, round((ln(1 + price) - (SELECT mu FROM m)) / (SELECT sd FROM m), 6) AS price_log FROM clean")
def p13(spark, sf_dir):
    return clean.price_log_standard(cleaned(spark, sf_dir)).select("listing_id", F.round("price_log", 6).alias("price_log"))


@query("p14_price_standard_weighted", with_(CLEAN_SHORT, "m AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM clean)")
       + "SELECT listing_id, round((price - (SELECT mu FROM m)) / (SELECT sd FROM m) * 0.2, 6) AS price_scaled FROM clean")
def p14(spark, sf_dir):
    return clean.price_standard_weighted(cleaned(spark, sf_dir)).select("listing_id", F.round("price_scaled", 6).alias("price_scaled"))


_FILLED = f"""filled AS (SELECT listing_id, coalesce({PRICE}, (SELECT quantile_cont({PRICE}, 0.5) FROM raw)) AS price FROM raw)"""


@query("p15_price_log_z_sample", with_(RAW_SHORT, _FILLED, "m AS (SELECT avg(ln(1 + price)) AS mu, stddev_samp(ln(1 + price)) AS sd FROM filled)")
       + "SELECT listing_id, round((ln(1 + price) - (SELECT mu FROM m)) / (SELECT sd FROM m), 6) AS price_z FROM filled")
def p15(spark, sf_dir):
    df = raw(spark, sf_dir).withColumn("price", clean_price_decimal_comma("price"))
    return clean.price_log_z_sample(df).select("listing_id", F.round("price_z", 6).alias("price_z"))


@query("p16_fill_median", with_(RAW_SHORT, _FILLED) + "SELECT listing_id, round(price, 6) AS price FROM filled")
def p16(spark, sf_dir):
    df = raw(spark, sf_dir).withColumn("price", clean_price_decimal_comma("price"))
    return clean.fill_median(df).select("listing_id", F.round("price", 6).alias("price"))


# the scale factors give every seller hundreds of rows, so the threshold is raised to split them
_RARE = 290


@query("p17_limit_rare_values", with_(CLEAN_SHORT, f"big AS (SELECT seller FROM clean GROUP BY 1 HAVING count(*) >= {_RARE})")
       + "SELECT listing_id, seller, CASE WHEN seller IN (SELECT seller FROM big) THEN seller ELSE 'other' END AS seller_limited FROM clean")
def p17(spark, sf_dir):
    return clean.limit_rare_values(cleaned(spark, sf_dir), "seller", _RARE).select("listing_id", "seller", "seller_limited")


@query("p18_one_hot", with_(CLEAN_SHORT) + "SELECT listing_id, 'seller_' || seller AS feature, CAST(1 AS DOUBLE) AS value FROM clean")
def p18(spark, sf_dir):
    from aislemap.operators.features import one_hot

    return one_hot(cleaned(spark, sf_dir), "seller", "seller")


@query("p19_text_lengths", with_(RAW) + """SELECT listing_id, length(title) AS title_length, length(coalesce(description, '')) AS description_length,
length(title) / 100 AS title_scaled, length(coalesce(description, '')) / 1000 AS description_scaled FROM raw""")
def p19(spark, sf_dir):
    df = clean.text_lengths(raw(spark, sf_dir, True))
    return df.select(
        "listing_id", F.col("title_length").cast("bigint").alias("title_length"), F.col("description_length").cast("bigint").alias("description_length"),
        (F.col("title_length") / 100).alias("title_scaled"), (F.col("description_length") / 1000).alias("description_scaled"),
    )


@query("p20_validate_assignments", with_(RAW_SHORT, """lab AS (SELECT CASE WHEN subcategory IS NOT NULL THEN listing_id END AS cluster FROM raw)""",
       "f AS (SELECT count(*) AS n, count(*) FILTER (WHERE cluster IS NULL) AS nulls, count(DISTINCT cluster) + max(CASE WHEN cluster IS NULL THEN 1 ELSE 0 END) AS k FROM lab)")
       + """SELECT 'missing_column_title' AS issue, CAST(0 AS BIGINT) AS detail UNION ALL SELECT 'null_cluster', nulls FROM f WHERE nulls > 0
UNION ALL SELECT 'too_few_clusters', k FROM f WHERE k < 2 UNION ALL SELECT 'too_many_clusters', k FROM f WHERE k >= 2 AND k > n / 2""")
def p20(spark, sf_dir):
    labels = raw(spark, sf_dir).withColumn("cluster", F.when(F.col("subcategory").isNotNull(), F.col("listing_id")))
    return clean.validate_assignments(labels.drop("title"))


@query("p21_cleaning_audit", with_(CLEAN) + """SELECT (SELECT count(*) FROM raw) AS rows_read, (SELECT count(*) FROM raw) - (SELECT count(*) FROM priced) AS dropped_price,
(SELECT count(*) FROM priced) - (SELECT count(*) FROM complete) AS dropped_missing, (SELECT count(*) FROM clean) AS rows_kept,
(SELECT count(DISTINCT subcategory) FROM clean) AS groups_kept""")
def p21(spark, sf_dir):
    return clean.cleaning_audit(raw(spark, sf_dir, True))


@query("p22_clean_listings", with_(CLEAN) + "SELECT listing_id, title, price, seller, division, subcategory, length(description) AS description_length FROM clean")
def p22(spark, sf_dir):
    df = clean_listings(raw(spark, sf_dir, True), "kmeans")
    return df.select("listing_id", "title", "price", "seller", "division", "subcategory", F.char_length("description").cast("bigint").alias("description_length"))


@query("p22b_clean_listings_topic", with_(RAW_SHORT, PRICED, """kept AS (SELECT * FROM priced WHERE subcategory IN (SELECT subcategory FROM priced GROUP BY 1 HAVING count(*) >= 30))""",
       "lim AS (SELECT subcategory, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM kept GROUP BY 1)")
       + "SELECT listing_id, title, price, seller, category, subcategory FROM kept JOIN lim USING (subcategory) WHERE price >= lo AND price <= hi")
def p22b(spark, sf_dir):
    df = clean_listings(raw(spark, sf_dir), "bertopic")
    return df.select("listing_id", "title", "price", "seller", "category", "subcategory")
