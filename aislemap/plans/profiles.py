"""Cleaning profiles: the same steps, composed as each clustering method expects them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from aislemap.functions.price import clean_price_currency, clean_price_decimal_comma
from aislemap.functions.text import text_features
from aislemap.operators import clean


@dataclass(frozen=True)
class Profile:
    drop_category: bool = True
    require_fields: bool = True
    price_quantiles: bool = False
    text_features: bool = False


# What each method's cleaning keeps.
PROFILES = {
    "shared": Profile(text_features=True),
    "kmeans": Profile(),
    "traditional_agglomerative": Profile(),
    "traditional_hdbscan": Profile(),
    "bertopic": Profile(drop_category=False, require_fields=False, price_quantiles=True),
    "transformer": Profile(text_features=True),
    "transformer_agglomerative": Profile(text_features=True),
    "transformer_hdbscan": Profile(drop_category=False),
    "transformer_kmeans": Profile(drop_category=False),
}


def clean_listings(raw: DataFrame, profile: str | Profile = "shared", min_rows: int = 30) -> DataFrame:
    """Typed listings ready for a method: priced, complete, in groups of a useful size."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    df = raw.withColumn("price", clean_price_decimal_comma("price"))
    df = clean.backfill_subcategory(clean.drop_invalid_price(df))
    if p.drop_category:
        df = clean.drop_category(df)
    if p.require_fields:
        df = clean.require_fields(df)
    df = clean.filter_small_groups(df, "subcategory", min_rows)
    if p.price_quantiles:
        df = clean.filter_group_quantiles(df, "subcategory", "price")
    if p.text_features:
        df = df.withColumn("text_features", text_features())
    return df


def load_catalogue(raw: DataFrame) -> DataFrame:
    """The lighter load: currency prices, one category column, no repeated listings."""
    df = raw.withColumn("price", clean_price_currency("price"))
    return clean.drop_exact_duplicates(clean.drop_category(clean.backfill_subcategory(df)))
