"""Several labelings of one listing table, in the long form all scores accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# name, category, SQL text and column of the label: simple rules over a listing that
# play the part of clustering methods in comparison queries
METHOD_LABELS = [
    ("size_label", "density-based", "cluster", lambda: F.col("cluster")),
    ("division_label", "traditional", "length(division) + 10 * ascii(division)",
     lambda: F.length("division") + 10 * F.ascii("division")),
    ("brand_label", "traditional", "CAST(replace(split_part(subcategory, ' ', 1), 'Brand#', '') AS INTEGER)",
     lambda: F.replace(F.split_part("subcategory", F.lit(" "), F.lit(1)), F.lit("Brand#"), F.lit("")).cast("int")),
    ("name_label", "transformer-based", "ascii(title) * 100 + length(title)", lambda: F.ascii("title") * 100 + F.length("title")),
    ("seller_label", "transformer-based", "CAST(right(seller, 2) AS INTEGER) % 30", lambda: F.right("seller", F.lit(2)).cast("int") % 30),
    ("price_label", "topic-based", "CAST(least(floor(price / 10), 40) AS INTEGER)",
     lambda: F.least(F.floor(F.col("price") / 10), F.lit(40)).cast("int")),
]


def label_methods(df: DataFrame) -> DataFrame:
    """One row per listing and method: (method, method_category, listing columns.., cluster)."""
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(category).alias("method_category"), label().cast("int").alias("cluster"))
            for m, category, _, label in METHOD_LABELS
        ]
    )
    keep = [c for c in df.columns if c != "cluster"]
    return df.withColumn("_e", F.explode(entries)).select("_e.method", "_e.method_category", *keep, "_e.cluster")
