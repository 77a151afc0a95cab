"""Cleaning and typing of raw listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aislemap.functions.price import (
    HIGH_EDGE,
    LOW_EDGE,
    clean_price_decimal_comma,
    price_flags,
    standardise,
)
from aislemap.operators.quantiles import exact_median, exact_quantiles
from aislemap.session import small_side
from aislemap.sources.listings import REQUIRED_FIELDS


def drop_invalid_price(df: DataFrame, price: str = "price") -> DataFrame:
    return df.where(F.col(price).isNotNull())


def backfill_subcategory(df: DataFrame) -> DataFrame:
    """Missing subcategories take the category; the column is added when absent."""
    if "subcategory" not in df.columns:
        return df.withColumn("subcategory", F.col("category"))
    if "category" not in df.columns:
        return df
    return df.withColumn("subcategory", F.coalesce("subcategory", "category"))


def drop_category(df: DataFrame) -> DataFrame:
    return df.drop("category")


def require_fields(df: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    return df.dropna(subset=list(fields))


def drop_exact_duplicates(df: DataFrame, id_col: str | None = "listing_id", long_texts: Sequence[str] = ("description",)) -> DataFrame:
    """One row per distinct listing over all business columns; the lowest id stays.

    Long texts are told apart by their SHA-256, so only the digest is compared and shuffled
    as a key; the text itself travels once, and not at all if nothing reads it.
    """
    business = [c for c in df.columns if c != id_col]
    long = [c for c in business if c in long_texts]
    ids = [F.min(id_col).alias(id_col)] if id_col in df.columns else []
    if not long and not ids:
        return df.dropDuplicates(business)
    keys = [F.unhex(F.sha2(F.col(c).cast("string"), 256)).alias(f"_{c}_digest") if c in long else F.col(c) for c in business]
    # equal digests have equal texts, so any of them stands for all
    return df.groupBy(*keys).agg(*ids, *[F.any_value(c).alias(c) for c in long]).select(*df.columns)


def filter_small_groups(df: DataFrame, key: str, min_rows: int = 30) -> DataFrame:
    """Keep rows whose ``key`` value occurs at least ``min_rows`` times."""
    kept = df.groupBy(key).count().where(F.col("count") >= min_rows).select(key)
    return df.join(small_side(kept), key, "left_semi")


def filter_group_quantiles(df: DataFrame, key: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Keep rows inside the inclusive quantile range of their group."""
    limits = exact_quantiles(df, value, [low, high], [key], ["_low", "_high"])
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return df.join(small_side(limits, 3), key).where(inside).select(*df.columns)


def price_flags_quartile(df: DataFrame, price: str = "price") -> DataFrame:
    """Low / medium / high indicators cut at the quartiles of the whole table."""
    q = exact_quantiles(df, price, [0.25, 0.75], names=["q25", "q75"])
    edges = q.select(F.struct("q25", "q75")).scalar()
    df = df.withColumn("_edges", edges)
    flags = price_flags(F.col(price), F.col("_edges.q25"), F.col("_edges.q75"))
    return df.select(*[c for c in df.columns if c != "_edges"], *flags)


def price_flags_fixed(df: DataFrame, low: float = LOW_EDGE, high: float = HIGH_EDGE, price: str = "price") -> DataFrame:
    return df.select("*", *price_flags(F.col(price), low, high))


def _with_moments(df: DataFrame, value: Column, sd) -> DataFrame:
    moments = df.agg(F.struct(F.avg(value).alias("mean"), sd(value).alias("sd"))).scalar()
    return df.withColumn("_m", moments)


def price_log_standard(df: DataFrame, price: str = "price", out: str = "price_log") -> DataFrame:
    """Population z-score of ``log1p(price)``."""
    value = F.log1p(price)
    scaled = standardise(value, F.col("_m.mean"), F.col("_m.sd"))
    return _with_moments(df, value, F.stddev_pop).withColumn(out, scaled).drop("_m")


def price_standard_weighted(df: DataFrame, weight: float = 0.2, price: str = "price", out: str = "price_scaled") -> DataFrame:
    """Population z-score of the price, scaled down to ``weight``; a missing price counts as the median."""
    df = df.withColumn("_p", fill_median_value(df, price))
    value = F.col("_p")
    scaled = standardise(value, F.col("_m.mean"), F.col("_m.sd")) * weight
    return _with_moments(df, value, F.stddev_pop).withColumn(out, scaled).drop("_m", "_p")


def price_log_z_sample(df: DataFrame, price: str = "price", out: str = "price_z") -> DataFrame:
    """Sample z-score of ``log1p`` of the median-filled price."""
    df = df.withColumn("_p", fill_median_value(df, price))
    value = F.log1p("_p")
    scaled = (value - F.col("_m.mean")) / F.nullif(F.col("_m.sd"), F.lit(0.0))
    return _with_moments(df, value, F.stddev_samp).withColumn(out, scaled).drop("_m", "_p")


def fill_median_value(df: DataFrame, value: str) -> Column:
    return F.coalesce(F.col(value), exact_median(df, value).scalar())


def fill_median(df: DataFrame, value: str = "price") -> DataFrame:
    """Missing values take the median of the whole table."""
    return df.withColumn(value, fill_median_value(df, value))


def limit_rare_values(df: DataFrame, key: str = "seller", min_rows: int = 10, other: str = "other", out: str = "seller_limited") -> DataFrame:
    """Values with fewer than ``min_rows`` rows become ``other``."""
    frequent = df.groupBy(key).count().where(F.col("count") >= min_rows).select(key, F.col(key).alias(out))
    return df.join(small_side(frequent), key, "left").withColumn(out, F.coalesce(out, F.lit(other)))


def text_lengths(df: DataFrame, scaled: bool = False) -> DataFrame:
    """Character counts of title and description, or the same over 100 and 1000."""
    title = F.char_length(F.coalesce("title", F.lit("")))
    description = F.char_length(F.coalesce("description", F.lit("")))
    if scaled:
        title, description = title / 100, description / 1000
    return df.withColumn("title_length", title).withColumn("description_length", description)


def validate_assignments(df: DataFrame, required: Sequence[str] = ("price", "title", "subcategory")) -> DataFrame:
    """One row per problem that makes labelled listings unusable for scoring."""
    spark = df.sparkSession
    schema = "issue string, detail bigint"
    missing = [("missing_column_" + c, 0) for c in ("cluster", *required) if c not in df.columns]
    absent = spark.createDataFrame(missing, schema)
    if "cluster" not in df.columns:
        return absent
    # a missing label is a value of its own when labels are counted
    has_null = F.max(F.col("cluster").isNull().cast("bigint"))
    facts = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.count_if(F.col("cluster").isNull()), F.lit(0)).alias("nulls"),
        (F.count_distinct("cluster") + F.coalesce(has_null, F.lit(0))).alias("clusters"),
    )
    found = facts.select(
        F.explode(
            F.array(
                F.when(F.col("nulls") > 0, F.struct(F.lit("null_cluster").alias("issue"), F.col("nulls").alias("detail"))),
                F.when(F.col("clusters") < 2, F.struct(F.lit("too_few_clusters").alias("issue"), F.col("clusters").alias("detail"))),
                F.when(
                    (F.col("clusters") >= 2) & (F.col("clusters") > F.col("rows") / 2),
                    F.struct(F.lit("too_many_clusters").alias("issue"), F.col("clusters").alias("detail")),
                ),
            )
        ).alias("x")
    ).where("x is not null")
    return absent.unionByName(found.select("x.issue", "x.detail"))


def cleaning_audit(raw: DataFrame, min_rows: int = 30) -> DataFrame:
    """Rows read, dropped for price, dropped for missing fields, and kept, plus groups kept."""
    df = backfill_subcategory(raw.withColumn("price", clean_price_decimal_comma("price")))
    has_price = F.col("price").isNotNull()
    complete = has_price
    for c in REQUIRED_FIELDS:
        complete = complete & F.col(c).isNotNull()
    per_group = df.groupBy("subcategory").agg(
        F.count("*").alias("n"), F.count_if(has_price).alias("priced"), F.count_if(complete).alias("complete")
    )
    big = F.col("complete") >= min_rows
    return per_group.agg(
        F.sum("n").alias("rows_read"),
        (F.sum("n") - F.sum("priced")).alias("dropped_price"),
        (F.sum("priced") - F.sum("complete")).alias("dropped_missing"),
        F.sum(F.when(big, F.col("complete")).otherwise(0)).alias("rows_kept"),
        F.count_if(big).alias("groups_kept"),
    )
