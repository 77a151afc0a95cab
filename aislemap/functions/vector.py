"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_distance(a, b) -> Column:
    parts = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_norm(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x)


def unit(a) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    length = F.sqrt(squared_norm(a))
    return F.transform(_col(a), lambda x: F.when(length > 0, x / length).otherwise(x))
