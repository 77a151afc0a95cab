"""What is in each cluster: sizes, frequent values, prices, titles, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislemap.functions.vector import distance
from aislemap.session import small_side


def top_n(df: DataFrame, n: int, by: Sequence[str], *order: Column, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark cuts to ``n`` before the shuffle, so group size does not matter."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def cluster_sizes(df: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("size"))


def crosstab_long(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per pair of values; pairs that do not occur are absent."""
    return df.groupBy(*by, a, b).agg(F.count("*").alias("n"))


def top_k_per_cluster(df: DataFrame, key: str, k: int, cluster: str = "cluster") -> DataFrame:
    """Most frequent ``key`` values per cluster, ties by value."""
    counts = crosstab_long(df.where(F.col(key).isNotNull()), cluster, key)
    return top_n(counts, k, [cluster], F.desc("n"), F.asc(key))


def cluster_price_range(df: DataFrame, cluster: str = "cluster", price: str = "price") -> DataFrame:
    return df.groupBy(cluster).agg(
        F.min(price).alias("price_min"), F.avg(price).alias("price_mean"), F.max(price).alias("price_max")
    )


def cluster_first_titles(df: DataFrame, k: int = 5, cluster: str = "cluster", id_col: str = "listing_id") -> DataFrame:
    """First ``k`` titles per cluster in listing order."""
    return top_n(df.select(cluster, id_col, "title"), k, [cluster], F.asc(id_col))


def cluster_centroids(df: DataFrame, vec: str = "vec", by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Mean vector, row count and mean squared length per cluster."""
    v = array_to_vector(F.col(vec))
    stats = df.groupBy(*by).agg(
        Summarizer.mean(v).alias("m"),
        F.count("*").alias("n"),
        F.avg(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)).alias("mean_square"),
    )
    return stats.select(*by, "n", vector_to_array("m").alias("centroid"), "mean_square")


def with_centroid_distance(df: DataFrame, vec: str = "vec", by: Sequence[str] = ("cluster",), dims: int = 128) -> DataFrame:
    """Each row with the Euclidean distance to the centroid of its own cluster."""
    centers = small_side(cluster_centroids(df, vec, by).select(*by, "centroid"), dims)
    return df.join(centers, list(by)).withColumn("distance", distance(vec, "centroid")).drop("centroid")


def cluster_representatives(df: DataFrame, vec: str = "vec", k: int = 5, cluster: str = "cluster", id_col: str = "listing_id") -> DataFrame:
    """The ``k`` rows nearest to each centroid, ties by id."""
    near = with_centroid_distance(df, vec, [cluster]).drop(vec)
    return top_n(near.withColumn("distance", F.round("distance", 9)), k, [cluster], F.asc("distance"), F.asc(id_col))


def cluster_top_terms(centers: DataFrame, components: DataFrame, k: int = 10, cluster: str = "cluster") -> DataFrame:
    """Back-project reduced centres onto terms and keep the ``k`` largest.

    ``centers``: (cluster, component, value); ``components``: (component, term, loading).
    """
    weights = (
        centers.join(components, "component")
        .groupBy(cluster, "term")
        .agg(F.sum(F.col("value") * F.col("loading")).alias("weight"))
        .withColumn("weight", F.round("weight", 9))
    )
    return top_n(weights, k, [cluster], F.desc("weight"), F.asc("term"))


def sample_key(id_col: str, seed: int) -> Column:
    """A reproducible pseudo-random order over rows."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def cluster_examples(df: DataFrame, k: int = 10, seed: int = 42, cluster: str = "cluster", id_col: str = "listing_id") -> DataFrame:
    """Random titles per cluster with the cluster's name, size and share of all rows."""
    sizes = cluster_sizes(df, [cluster])
    total = sizes.agg(F.sum("size")).scalar()
    sizes = sizes.withColumn("percentage", F.col("size") * 100 / total)
    keyed = df.select(cluster, id_col, "title").withColumn("_k", sample_key(id_col, seed))
    picked = top_n(keyed, k, [cluster], F.asc("_k"), F.asc(id_col)).drop("_k")
    name = F.when(F.col(cluster) == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    return picked.join(sizes, cluster).withColumn("name", name)


def crosstab_row_pct(df: DataFrame, a: str, b: str, zeros: bool = True) -> DataFrame:
    """Share of ``b`` values within each ``a`` value in percent."""
    counts = crosstab_long(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    totals = counts.groupBy(a).agg(F.sum("n").alias("total"))
    if zeros:
        # the distinct values of b as one bounded array instead of a join without keys
        values = counts.select(b).distinct().agg(F.collect_list(b)).scalar()
        grid = totals.withColumn(b, F.explode(values))
        counts = grid.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        counts = counts.join(totals, a)
    return counts.select(a, b, "n", (F.col("n") * 100 / F.col("total")).alias("pct"))


def _most_frequent(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def heatmap_top(df: DataFrame, a: str = "cluster", b: str = "subcategory", top_b: int = 15, max_a: int | None = 20) -> DataFrame:
    """Row percentages for the most frequent ``b`` values and, beyond ``max_a`` clusters, the largest clusters."""
    counts = crosstab_long(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    totals = counts.groupBy(a).agg(F.sum("n").alias("total"))
    if max_a is not None:
        totals = totals.orderBy(F.desc("total"), F.asc(a)).limit(max_a)
    keys = _most_frequent(counts, b, top_b).agg(F.collect_list(b)).scalar()
    grid = totals.withColumn(b, F.explode(keys))
    cells = grid.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cells.select(a, b, (F.col("n") * 100 / F.col("total")).alias("pct"))


def heatmap_top_global(df: DataFrame, a: str = "cluster", b: str = "subcategory", top_b: int = 20) -> DataFrame:
    return heatmap_top(df, a, b, top_b, None)


def seller_share(df: DataFrame, top: int = 10, cluster: str = "cluster", seller: str = "seller") -> DataFrame:
    """Share of each of the largest sellers among them, per cluster."""
    counts = crosstab_long(df.where(F.col(seller).isNotNull()), cluster, seller)
    keys = _most_frequent(counts, seller, top)
    kept = counts.join(keys.select(seller), seller, "left_semi")
    totals = kept.groupBy(cluster).agg(F.sum("n").alias("total"))
    grid = totals.withColumn(seller, F.explode(keys.agg(F.collect_list(seller)).scalar()))
    cells = grid.join(kept, [cluster, seller], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cells.select(cluster, seller, (F.col("n") * 100 / F.col("total")).alias("pct"))


def topic_sizes(df: DataFrame, topic: str = "cluster") -> DataFrame:
    """Rows per topic with the topic count and the outlier count and percentage of the whole table."""
    sizes = cluster_sizes(df, [topic])
    outliers = F.sum(F.when(F.col(topic) == -1, F.col("size")).otherwise(0))
    whole = sizes.agg(
        F.struct(
            F.count_if(F.col(topic) != -1).alias("n_topics"),
            outliers.alias("n_outliers"),
            (outliers * 100 / F.sum("size")).alias("outlier_percent"),
        )
    ).scalar()
    return sizes.withColumn("_w", whole).select(topic, "size", "_w.*")


def cluster_summary(df: DataFrame, sample: DataFrame | None = None, terms: DataFrame | None = None, cluster: str = "cluster", noise_cluster: int | None = None) -> DataFrame:
    """One nested record per cluster.

    ``sample`` has (cluster, rank, title) and defaults to the first titles in listing
    order; ``terms`` has (cluster, rank, term). ``noise_cluster`` names the noise label.
    """

    def ordered(part: DataFrame, value: str, out: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v"))))
        return part.groupBy(cluster).agg(F.transform(rows, lambda r: r["v"]).alias(out))

    def counted(key: str, k: int, out: str) -> DataFrame:
        top = top_k_per_cluster(df, key, k, cluster)
        rows = F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("v"), "n")))
        entries = F.transform(rows, lambda r: F.struct(r["v"], r["n"]))
        return top.groupBy(cluster).agg(F.map_from_entries(entries).alias(out))

    base = df.groupBy(cluster).agg(
        F.count("*").alias("size"),
        F.struct(
            F.min("price").alias("min"), F.avg("price").alias("mean"), F.max("price").alias("max")
        ).alias("price_range"),
    )
    base = base.withColumn("is_noise_cluster", F.col(cluster) == F.lit(noise_cluster) if noise_cluster is not None else F.lit(False))
    parts = [counted("subcategory", 5, "top_subcategories"), counted("seller", 3, "top_sellers")]
    parts.append(ordered(sample if sample is not None else cluster_first_titles(df, 5, cluster), "title", "sample_products"))
    if terms is not None:
        parts.append(ordered(terms, "term", "top_terms"))
    for part in parts:
        base = base.join(part, cluster, "left")
    return base


def largest_clusters(df: DataFrame, clusters: int = 5, per_cluster: int = 3, cluster: str = "cluster") -> DataFrame:
    """The biggest clusters with their leading subcategories and first titles, one row per entry."""
    biggest = cluster_sizes(df, [cluster]).orderBy(F.desc("size"), F.asc(cluster)).limit(clusters)
    inside = df.join(F.broadcast(biggest.select(cluster)), cluster, "left_semi")
    subs = top_k_per_cluster(inside, "subcategory", per_cluster, cluster).select(
        cluster, F.lit("subcategory").alias("kind"), "rank", F.col("subcategory").alias("value"), "n"
    )
    titles = cluster_first_titles(inside, per_cluster, cluster).select(
        cluster, F.lit("title").alias("kind"), "rank", F.col("title").alias("value"), F.lit(None).cast("bigint").alias("n")
    )
    return subs.unionByName(titles).join(F.broadcast(biggest), cluster)
