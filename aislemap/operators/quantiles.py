"""Exact quantiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here values
are counted first, the counts are summed into narrow value ranges, and only the
ranges that hold a wanted rank are put in order. A group of any size is spread
over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislemap.session import materialise

# Ranges per power of two: a range is at most 4.4 % wide.
RANGES_PER_OCTAVE = 16


def _value_range(v: Column) -> Column:
    """Index of the range of ``v``; never decreases as ``v`` grows."""
    magnitude = F.floor(F.log2(F.abs(v)) * RANGES_PER_OCTAVE).cast("int") + 20000
    return F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(0)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """One row per group with linearly interpolated quantiles of the non-null values."""
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    counts = (
        df.select(*by, F.col(value).cast("double").alias("v"))
        .where("v is not null")
        .groupBy(*by, "v")
        .agg(F.count("*").alias("c"))
        .withColumn("r", _value_range(F.col("v")))
    )
    # counts are far smaller than the rows and are read twice
    counts = materialise(counts)
    per_range = counts.groupBy(*by, "r").agg(F.sum("c").alias("c"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    per_range = per_range.select(
        *by,
        "r",
        F.sum("c").over(group.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        "c",
        F.sum("c").over(group).alias("n"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("pos"))
            for i, p in enumerate(probs)
        ]
    )
    ranks = (
        per_range.withColumn("w", F.explode(wanted))
        .select(
            *by, "r", "upto", "c", F.col("w.i").alias("i"), F.col("w.pos").alias("pos"),
            F.explode(F.array(F.floor("w.pos"), F.ceil("w.pos"))).alias("rank"),
        )
        .where((F.col("rank") >= F.col("upto") - F.col("c")) & (F.col("rank") < F.col("upto")))
        .select(*by, "r", "i", "pos", "rank", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("inner_rank"))
        .distinct()
    )
    within = Window.partitionBy(*by, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = counts.join(ranks.select(*by, "r").distinct(), [*by, "r"], "left_semi").select(
        *by, "r", "v", "c", F.sum("c").over(within).alias("v_upto")
    )
    hit = (F.col("inner_rank") < F.col("v_upto")) & (F.col("inner_rank") >= F.col("v_upto") - F.col("c"))
    found = ordered.join(ranks, [*by, "r"]).where(hit)
    low = F.min_by("v", "rank")
    per_prob = found.groupBy(*by, "i").agg(
        (low + (F.max_by("v", "rank") - low) * (F.max("pos") - F.floor(F.max("pos")))).alias("q")
    )
    return per_prob.groupBy(*by).agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(names)]
    )


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, [name])
