"""Choice among density clustering runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def score_runs(runs: DataFrame, full_at: int = 50) -> DataFrame:
    """Silhouette, lowered by noise and by having fewer than ``full_at`` clusters."""
    score = F.col("silhouette") * (1 - F.col("noise_percent") / 100) * F.least(F.col("n_clusters") / full_at, F.lit(1.0))
    return runs.withColumn("score", score)


def select_density_params(runs: DataFrame, full_at: int = 50, min_clusters: int | None = 20) -> DataFrame:
    """The best run: highest score among runs with enough clusters, otherwise the run with most clusters."""
    scored = score_runs(runs, full_at)
    good = F.lit(True) if min_clusters is None else (F.col("n_clusters") >= min_clusters) & (F.col("score") > -1)
    order = [
        F.desc(good.cast("int")),
        F.desc(F.when(good, F.col("score")).otherwise(F.col("n_clusters").cast("double"))),
        F.asc("min_cluster_size"),
        F.asc("min_samples"),
    ]
    return scored.orderBy(*order).limit(1)
