"""Price parsing, bands and scaling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what counts as a plain decimal number. Without this guard a cast
# would also take "1d", "inf" and "nan".
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Price band edges.
LOW_EDGE, HIGH_EDGE = 50.0, 200.0


def _to_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clean_price_decimal_comma(price) -> Column:
    """Comma is the decimal mark and spaces are dropped; anything unparsable is null."""
    text = F.col(price) if isinstance(price, str) else price
    return _to_number(F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")))


def clean_price_currency(price) -> Column:
    """The euro sign and thousands commas are dropped; anything unparsable is null."""
    text = F.col(price) if isinstance(price, str) else price
    return _to_number(F.translate(text, "€,", ""))


def price_band(price, low: float = LOW_EDGE, high: float = HIGH_EDGE) -> Column:
    price = F.col(price) if isinstance(price, str) else price
    band = F.when(price < low, "low price").when(price < high, "medium price").otherwise("high price")
    return F.when(price.isNotNull(), band)


def price_flags(price: Column, low, high) -> list[Column]:
    """0/1 indicators for below ``low``, in ``[low, high)`` and from ``high`` up."""
    return [
        (price < low).cast("double").alias("price_low"),
        ((price >= low) & (price < high)).cast("double").alias("price_medium"),
        (price >= high).cast("double").alias("price_high"),
    ]


def standardise(value: Column, mean: Column, sd: Column) -> Column:
    """z-score; a column without spread maps to zero."""
    return F.when(sd == 0, F.lit(0.0)).otherwise((value - mean) / sd)
