"""Comparison and ranking of methods, from one row of metrics per method.

All tables here have one row per method (or per method and metric), so windows
over the whole table are windows over a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Weights, target ranges, minimum values and metric groups of the scores.
BUSINESS_WEIGHTS = {"subcategory_nmi": 10.0, "price_homogeneity": 5.0, "avg_top_seller_concentration": 5.0}
SCORE_WEIGHTS = {
    "subcategory_nmi": 10.0,
    "price_homogeneity": 5.0,
    "avg_top_seller_concentration": 5.0,
    "silhouette_score": 3.0,
    "num_clusters": 2.0,
    "cluster_density": 2.0,
    "noise_percent": -2.0,
    "small_clusters_pct": -1.0,
    "davies_bouldin": -2.0,
}
APPROXIMATED_WEIGHTS = {"silhouette_score": 1.0, "davies_bouldin": -0.5}
TARGET_RANGES = {
    "subcategory_nmi": (0.0, 0.7),
    "silhouette_score": (0.0, 0.6),
    "price_homogeneity": (0.3, 0.9),
    "avg_top_seller_concentration": (0.5, 0.9),
    "num_clusters": (20, 300),
}
MINIMUMS = {"subcategory_nmi": 0.3, "num_clusters": 20, "price_homogeneity": 0.4}
LOWER_IS_BETTER = ("davies_bouldin", "noise_percent", "small_clusters_pct")
NMI_POWER = 1.3
MINIMUM_METHODS = 2
BELOW_MINIMUM_FACTOR = 0.6
RADAR_METRICS = ("silhouette_score", "subcategory_nmi", "avg_top_seller_concentration", "price_homogeneity")
CATEGORY_METRICS = ("num_clusters", "silhouette_score", "subcategory_nmi", "avg_top_seller_concentration", "price_homogeneity", "cluster_density")
REPORT_FIRST = ("silhouette_score", "subcategory_nmi", "num_clusters", "avg_top_seller_concentration", "price_homogeneity")
DASHBOARD_METRICS = ("silhouette_score", "subcategory_nmi", "num_clusters", "price_homogeneity")


def _every():
    """A window over the whole table of methods."""
    return Window.partitionBy(F.lit(0))



def stack_methods(records: Sequence[DataFrame]) -> DataFrame:
    """Metric records under each other; a metric a method lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)


def comparison_table(metrics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per method with its category."""
    return metrics.drop("method_category").join(catalogue.select("method", "method_category"), "method", "left")


def metric_columns(metrics: DataFrame) -> list[str]:
    skip = ("method", "method_category", "metrics_source")
    return [c for c in metrics.columns if c not in skip]


def long_metrics(metrics: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(method, method_category, metric, value) with one row per metric a method has."""
    names = [m for m in (names or metric_columns(metrics)) if m in metrics.columns]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    long = metrics.select("method", "method_category", F.explode(entries).alias("e"))
    return long.select("method", "method_category", "e.metric", "e.value").where("value is not null")


def _min_max(value: Column, window=None) -> tuple[Column, Column]:
    window = window or _every()
    return F.min(value).over(window), F.max(value).over(window)


def business_alignment(metrics: DataFrame) -> DataFrame:
    """Weighted sum of min-max normalised metrics that matter for using the clusters."""
    total = F.lit(0.0)
    for metric, weight in BUSINESS_WEIGHTS.items():
        if metric in metrics.columns:
            value = F.col(metric).cast("double")
            low, high = _min_max(value)
            scaled = (value - low) / F.nullif(high - low, F.lit(0.0)) * weight
            total = total + F.coalesce(scaled, F.lit(0.0))
    return metrics.withColumn("business_alignment", total)


def method_score(metrics: DataFrame) -> DataFrame:
    """Overall score: target ranges where known, min-max elsewhere, penalty below a minimum.

    One method measured on approximated features lowers the weight of the
    geometric metrics for every method.
    """
    if "metrics_source" in metrics.columns:
        approximated = F.max(F.coalesce(F.col("metrics_source") == "approximated_features", F.lit(False))).over(_every())
    else:
        approximated = F.lit(False)
    total = F.lit(0.0)
    for metric, weight in SCORE_WEIGHTS.items():
        if metric not in metrics.columns:
            continue
        value = F.col(metric).cast("double")
        if metric in TARGET_RANGES:
            low, high = TARGET_RANGES[metric]
            scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
        else:
            low, high = _min_max(value)
            distance = high - value if metric in LOWER_IS_BETTER else value - low
            scaled = F.when(F.count(value).over(_every()) > 1, distance / F.nullif(high - low, F.lit(0.0)))
        if metric == "subcategory_nmi":
            scaled = F.pow(scaled, F.lit(NMI_POWER))
        if metric == "noise_percent":
            scaled = F.when(F.col("method_category") == "density-based", scaled)
        factor = F.lit(abs(weight))
        if metric in APPROXIMATED_WEIGHTS:
            factor = F.when(approximated, F.lit(abs(APPROXIMATED_WEIGHTS[metric]))).otherwise(factor)
        total = total + F.when(value.isNotNull(), F.coalesce(scaled * factor, F.lit(0.0))).otherwise(0.0)
    below = F.lit(False)
    for metric, minimum in MINIMUMS.items():
        if metric in metrics.columns:
            below = below | F.coalesce(F.col(metric) < minimum, F.lit(False))
    return metrics.withColumn("overall_score", F.when(below, total * BELOW_MINIMUM_FACTOR).otherwise(total))


def threshold_warnings(metrics: DataFrame) -> DataFrame:
    """Method and metric wherever a value lies below its minimum."""
    minimum = F.create_map(*[F.lit(x) for m, v in MINIMUMS.items() for x in (m, float(v))])
    long = long_metrics(metrics, list(MINIMUMS)).withColumn("minimum", minimum[F.col("metric")])
    return long.where("value < minimum").select("method", "metric", "value", "minimum")


def rank_methods(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("overall_score"), F.asc("method"))
    return scored.select("method", "method_category", "overall_score", F.row_number().over(order).alias("rank"))


def best_per_category(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("method_category").orderBy(F.desc("overall_score"), F.asc("method"))
    best = scored.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("method_category", "method", "overall_score")


def category_comparison(metrics: DataFrame) -> DataFrame:
    """The main metrics of methods that share their category with another method."""
    peers = F.count("*").over(Window.partitionBy("method_category"))
    kept = [m for m in CATEGORY_METRICS if m in metrics.columns]
    return metrics.withColumn("_n", peers).where("_n > 1").select("method_category", "method", *kept)


def radar_normalise(metrics: DataFrame, scope: str = "category") -> DataFrame:
    """Key metrics scaled to 0..1 within each category, or across the best method by NMI of each category."""
    names = [m for m in RADAR_METRICS if m in metrics.columns]
    if len(names) < 3:
        return metrics.limit(0).select("method", "method_category", *names)
    if scope == "best":
        # a category whose methods all lack the metric still needs one method: nulls sort last
        order = Window.partitionBy("method_category").orderBy(F.desc_nulls_last("subcategory_nmi"), F.asc("method"))
        metrics = metrics.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
        window = _every()
    else:
        window = Window.partitionBy("method_category")
    scaled = []
    for m in names:
        value = F.col(m).cast("double")
        low, high = _min_max(value, window)
        better = high - value if m in LOWER_IS_BETTER else value - low
        scaled.append(F.when(high == low, 0.5).otherwise(better / F.nullif(high - low, F.lit(0.0))).alias(m))
    return metrics.select("method", "method_category", *scaled)


# Use case and the metric or score that decides it.
USE_CASES = [
    ("production", "overall_score"),
    ("catalog organization", "overall_score"),
    ("matching existing categories", "subcategory_nmi"),
    ("pricing strategy", "price_homogeneity"),
    ("seller analysis", "avg_top_seller_concentration"),
    ("business alignment", "business_alignment"),
]
CATEGORY_USES = {
    "transformer-based": "semantic understanding",
    "traditional": "large datasets",
    "density-based": "outliers and unusual items",
    "topic-based": "interpretable groups",
}


def recommendations(scored: DataFrame) -> DataFrame:
    """(use_case, method, basis, value): the best method overall, per category and per deciding metric."""
    cases = [(use, m) for use, m in USE_CASES if m in scored.columns]
    entries = F.array(
        *[F.struct(F.lit(use).alias("use_case"), F.lit(m).alias("basis"), F.col(m).cast("double").alias("value")) for use, m in cases],
        F.struct(
            F.create_map(*[F.lit(x) for kv in CATEGORY_USES.items() for x in kv])[F.col("method_category")].alias("use_case"),
            F.lit("overall_score").alias("basis"),
            F.col("overall_score").alias("value"),
        ),
    )
    long = scored.select("method", F.explode(entries).alias("e")).select("method", "e.*")
    order = Window.partitionBy("use_case").orderBy(F.desc("value"), F.asc("method"))
    best = long.where("use_case is not null and value is not null").withColumn("_r", F.row_number().over(order))
    return best.where("_r = 1").select("use_case", "method", "basis", "value")


def format_value(value: Column, whole: Column) -> Column:
    """Whole numbers as they are, others with four decimals, or one from a thousand up."""
    decimals = F.when(F.abs(value) < 1000, F.format_string("%.4f", value)).otherwise(F.format_string("%.1f", value))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(decimals)


def report_rows(scored: DataFrame, catalogue: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """The report as (section, position, key, value) rows.

    ``clusters`` adds the largest clusters of the best method, as given by
    ``describe.largest_clusters``.
    """
    ranked = rank_methods(scored)
    points = F.concat(F.format_string("%.2f", F.col("overall_score")), F.lit(" points"))
    listed = scored.select("method", "method_category", F.col("num_clusters").cast("string").alias("k"))
    text = F.concat(F.col("k"), F.lit(" clusters"))
    if catalogue is not None:
        listed = listed.join(catalogue.select("method", "description"), "method", "left")
        text = F.concat(F.coalesce("description", F.lit("")), F.lit(" ("), F.col("k"), F.lit(" clusters)"))
    by_name = Window.partitionBy(F.lit(0)).orderBy("method_category", "method")
    section = F.lit("methods").alias("section")
    parts = [
        listed.select(section, F.row_number().over(by_name).alias("position"), F.col("method").alias("key"), text.alias("value")),
        ranked.select(F.lit("ranking").alias("section"), F.col("rank").alias("position"), F.col("method").alias("key"), points.alias("value")),
        best_per_category(scored).select(
            F.lit("best by category").alias("section"),
            F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("method_category")).alias("position"),
            F.col("method_category").alias("key"),
            F.concat(F.col("method"), F.lit(" ("), points, F.lit(")")).alias("value"),
        ),
    ]
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("overall_score"), F.asc("method"))
    top = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    names = [m for m in REPORT_FIRST if m in scored.columns]
    names += [m for m in metric_columns(scored) if m not in names and m != "overall_score"]
    types = dict(scored.dtypes)
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"), F.lit(m).alias("key"),
            format_value(F.col(m).cast("double"), F.lit(types[m] in ("int", "bigint"))).alias("value"),
            F.col(m).isNotNull().alias("present"),
        )
        for i, m in enumerate(names)
    ]
    key_rows = top.select(F.explode(F.array(*cells)).alias("e")).where("e.present")
    parts.append(key_rows.select(F.lit("best method metrics").alias("section"), "e.position", "e.key", "e.value"))
    parts.append(
        recommendations(scored).select(
            F.lit("recommendations").alias("section"),
            F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("use_case")).alias("position"),
            F.col("use_case").alias("key"), F.col("method").alias("value"),
        )
    )
    if clusters is not None:
        place = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "cluster", "kind", "rank")
        value = F.concat(F.col("value"), F.coalesce(F.concat(F.lit(": "), F.col("n").cast("string")), F.lit("")))
        key = F.concat(F.lit("cluster "), F.col("cluster").cast("string"), F.lit(" "), F.col("kind"))
        parts.append(clusters.select(F.lit("largest clusters").alias("section"), F.row_number().over(place).alias("position"), key.alias("key"), value.alias("value")))
    return reduce(DataFrame.unionByName, parts)


def report_markdown(rows: DataFrame, title: str = "Clustering evaluation") -> str:
    """The report rows as Markdown text; one short line per row."""
    lines, section = [f"# {title}"], None
    for r in rows.orderBy("section", "position").toLocalIterator():
        if r["section"] != section:
            section = r["section"]
            lines.append(f"\n## {section.capitalize()}\n")
        lines.append(f"- **{r['key']}**: {r['value']}")
    return "\n".join(lines) + "\n"


def chart_data(metrics: DataFrame) -> DataFrame:
    """(chart, method, series, value): the numbers behind the bar, box and dashboard charts."""
    external = [c for c in metrics.columns if any(part in c for part in ("rand_score", "mutual_info", "nmi"))]
    charts = {
        "num_clusters": ["num_clusters"],
        "silhouette": ["silhouette_score"],
        "external_metrics": external,
        "cluster_sizes": ["min_cluster_size", "median_cluster_size", "mean_cluster_size", "max_cluster_size"],
        "dashboard": list(DASHBOARD_METRICS),
    }
    cells = [
        F.struct(F.lit(chart).alias("chart"), F.lit(m).alias("series"), F.col(m).cast("double").alias("value"))
        for chart, names in charts.items()
        for m in names
        if m in metrics.columns
    ]
    long = metrics.select("method", F.explode(F.array(*cells)).alias("e"))
    return long.select("e.chart", "method", "e.series", "e.value").where("value is not null")
