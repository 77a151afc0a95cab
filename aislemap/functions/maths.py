"""Small numeric expressions Spark SQL does not ship."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Coefficients of the Stirling series B2k / (2k (2k-1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0, from the Stirling series after shifting x up by eight."""
    x = x.cast("double")
    shift = F.lit(0.0)
    for k in range(0, 8, 4):
        # logs of products of four factors: three fewer log calls, no overflow below 1e75
        shift = shift + F.log((x + k) * (x + (k + 1)) * (x + (k + 2)) * (x + (k + 3)))
    z = x + 8.0
    inv2 = 1 / (z * z)
    series = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * inv2 + F.lit(c)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series / z - shift


def log_factorial(n: Column) -> Column:
    return log_gamma(n + 1)
