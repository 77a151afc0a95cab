"""All label-based metrics of several methods, as one row per method."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from aislemap.operators import quality
from aislemap.operators.compare import MINIMUM_METHODS
from aislemap.operators.features import dense_rows, fallback_features
from aislemap.plans.run import MethodRun, stacked
from aislemap.session import materialise


def method_metrics(labels: DataFrame, sizes: bool = True) -> DataFrame:
    """Metrics for a long table of labels with a ``method`` and ``method_category`` column.

    Every measure groups by method, so all methods are scored in the same passes, and those
    of whole clusters share one. Noise is reported for density-based methods only.
    """
    by = ["method"]
    # a method has one category
    profile = materialise(quality.cluster_profile(labels, ["method", "method_category"]))
    density = "method_category = 'density-based'"
    parts = [
        quality.external_metrics(labels, by),
        quality.seller_concentration(labels, by),
        quality.price_homogeneity(labels, by, profile=profile),
        quality.noise_percent(labels.where(density), by, profile=profile.where(density)),
    ]
    if "title_length" in labels.columns:
        parts.append(quality.centroid_separability(labels, by))
    if sizes:
        parts.append(quality.cluster_size_stats(labels, by, profile=profile))
    out = quality.partition_shape(labels, by, profile=profile)
    for part in parts:
        out = out.join(part, "method", "left")
    categories = profile.groupBy("method").agg(F.first("method_category").alias("method_category"))
    return materialise(out.join(categories, "method"))


def vector_metrics(run: MethodRun) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin of a run, with the source of its vectors.

    A run without vectors is measured on stand-in features of its listings. Labels with
    fewer than two clusters have no such figures.
    """
    vectors, source = run.vectors, "original_features"
    if vectors is None:
        vectors, source = dense_rows(fallback_features(run.labelled)), "approximated_features"
    rows = materialise(run.labelled.select("listing_id", "cluster").join(vectors, "listing_id"))
    one = rows.agg(F.lit(run.method).alias("method"), F.lit(source).alias("metrics_source"), F.count_distinct("cluster").alias("_k"))
    for part in (quality.silhouette(rows), quality.calinski_harabasz(rows), quality.davies_bouldin(rows)):
        name = part.columns[0]
        one = one.withColumn(name, F.when(F.col("_k") > 1, part.select(name).scalar()))
    return one.drop("_k")


def compare_runs(runs: Sequence[MethodRun]) -> DataFrame:
    """One row per method with all metrics of its labels and vectors; a comparison needs two methods or more."""
    if len(runs) < MINIMUM_METHODS:
        raise ValueError(f"a comparison needs {MINIMUM_METHODS} methods, got {len(runs)}")
    figures = reduce(DataFrame.unionByName, [vector_metrics(r) for r in runs])
    return materialise(method_metrics(stacked(runs)).join(figures, "method"))
