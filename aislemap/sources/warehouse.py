"""Listings, texts and vectors derived from the order warehouse tables.

One listing is one (part, supplier) pair that was ordered at least once. The
price column is text in the mixed notations a scraped catalogue carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislemap.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    cents = F.round(F.min("l_extendedprice") * 100).cast("bigint")
    offers = line.groupBy("l_partkey", "l_suppkey").agg(cents.alias("line_cents"))
    # integer half-up division keeps the price text independent of float formatting
    return offers.select(
        "l_partkey", "l_suppkey", F.expr("(line_cents + 250) div 500").alias("cents")
    )


def _price_text():
    shown = F.concat(
        F.expr("cast(cents div 100 as string)"), F.lit("."), F.lpad(F.expr("cast(cents % 100 as string)"), 2, "0")
    )
    style = (F.col("l_partkey") + F.col("l_suppkey")) % 20
    return (
        F.when(style == 0, F.concat(F.lit("€"), shown))
        .when(style == 1, F.lit("n/a"))
        .when(style == 2, F.lit(None))
        .when(style == 3, F.concat(F.lit("1,"), shown))
        .when(style % 2 == 0, F.replace(shown, F.lit("."), F.lit(",")))
        .otherwise(shown)
    )


def raw_listings(spark: SparkSession, sf_dir: str, description: bool = True) -> DataFrame:
    """Uncleaned listings with a ``cluster`` label (-1 = noise).

    ``description`` is the whole text of the document attached to the part.
    """
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    bucket = F.col("p_size") % 20
    df = (
        _offers(spark, sf_dir)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, "l_suppkey")
        .select(
            (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("listing_id"),
            F.concat_ws(" ", "p_name", "p_brand").alias("title"),
            _price_text().alias("price"),
            F.when((7 * F.col("l_partkey") + F.col("l_suppkey")) % 97 != 0, F.col("s_name")).alias("seller"),
            F.col("p_type").alias("division"),
            F.col("p_brand").alias("category"),
            F.when(F.col("p_size") % 10 != 0, F.concat_ws(" ", "p_brand", "p_name")).alias("subcategory"),
            F.when(bucket == 19, F.lit(-1)).otherwise(bucket).cast("int").alias("cluster"),
            "l_partkey",
        )
    )
    if description:
        docs = table(spark, sf_dir, "documents")
        n_docs = docs.agg(F.count("*")).scalar()
        texts = docs.select(F.col("doc_id"), F.col("text").alias("description"))
        df = df.withColumn("doc_id", F.col("l_partkey") % n_docs).join(texts, "doc_id", "left").drop("doc_id")
    return df.drop("l_partkey")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings: the source sells, the language is the division."""
    return spread(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("listing_id"), "text", F.col("source").alias("seller"), F.col("lang").alias("division")
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-length embeddings in double precision with their known label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("listing_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("int").alias("label"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per part with the whole text of a document as its description."""
    part = table(spark, sf_dir, "part")
    docs = table(spark, sf_dir, "documents")
    supplier = table(spark, sf_dir, "supplier")
    n_docs = docs.agg(F.count("*")).scalar()
    n_sellers = supplier.agg(F.count("*")).scalar()
    keyed = part.withColumn("doc_id", F.col("p_partkey") % n_docs).withColumn("s_suppkey", F.col("p_partkey") % n_sellers)
    # the text comes last, so that no other join shuffles it
    df = keyed.join(supplier.select("s_suppkey", "s_name"), "s_suppkey").join(docs.select("doc_id", "text"), "doc_id")
    return df.select(
        F.col("p_partkey").alias("listing_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.col("text").alias("description"),
        F.col("p_retailprice").alias("price"),
        F.col("s_name").alias("seller"),
        F.col("p_type").alias("division"),
        F.concat_ws(" ", "p_brand", "p_name").alias("subcategory"),
        F.when(F.col("p_size") % 20 == 19, -1).otherwise(F.col("p_size") % 20).cast("int").alias("cluster"),
    )


# Phrases that exercise the text rules, chosen per part by its key.
_PHRASES = [
    "Brand new", "genuine leather", "water resistant", "Dėklas ir dangtis", "cover for the phone", "su bevielis krovikliu",
    "professional silicon shell", "AUTHENTIC waterproof", "telefonui, 10 centimeters!", "kabelis - 5 mm", "cordless drill by hand",
    "25 m² box, 5½ in, 10³ pcs", "cafe\u0301 with Dangtis\u0328 of x_y",
]
_MEASURES = [" inch", "x20x30", " gb", "tb", "X7", '.5 inches', " mb ssd"]


def messy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-like texts made from the parts, and every document."""
    key = F.col("p_partkey")

    def pick(options: list[str]):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (key % len(options) + 1).cast("int"))

    made = table(spark, sf_dir, "part").select(
        key.alias("listing_id"),
        F.concat(pick(_PHRASES), F.lit(" "), F.col("p_name"), F.lit(" "), (F.col("p_size") * 7).cast("string"), pick(_MEASURES)).alias("text"),
    )
    docs = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("listing_id"), "text")
    return spread(made.unionByName(docs))
