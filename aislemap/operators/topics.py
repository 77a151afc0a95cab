"""Topic models: sentence vectors, density clusters, merged topics and their words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from aislemap.operators.density import density_cluster
from aislemap.operators.describe import cluster_centroids
from aislemap.operators.features import embed_text, topic_words
from aislemap.operators.vectors import DENSITY_COMPONENTS
from aislemap.session import materialise, small_side

MIN_TOPIC_SIZE = 20


def merge_topics(labelled: DataFrame, vec: str = "vec", topic: str = "cluster") -> DataFrame:
    """Topics whose centroids form a dense pair or group become one, numbered by size."""
    centers = cluster_centroids(labelled.where(F.col(topic) != -1), vec, [topic])
    centers = materialise(centers.select(F.col(topic).cast("bigint").alias("listing_id"), F.col("centroid").alias("vec"), "n"))
    if centers.count() > 2:
        groups = density_cluster(centers, 2, 1).select(F.col("listing_id").alias("t"), "cluster", "n")
    else:
        groups = centers.select(F.col("listing_id").alias("t"), F.lit(-1).alias("cluster"), "n")
    # an unmatched topic stays alone
    key = F.when(F.col("cluster") == -1, -F.col("t") - 1).otherwise(F.col("cluster").cast("bigint"))
    groups = groups.withColumn("key", key)
    totals = groups.groupBy("key").agg(F.sum("n").alias("total"), F.min("t").alias("first"))
    order = totals.agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), "first", "key"))).alias("a"))
    names = order.select(F.posexplode("a").alias("new", "e")).select("new", "e.key")
    mapping = small_side(groups.join(names, "key").select(F.col("t").cast("int").alias(topic), "new"), 2)
    return labelled.join(mapping, topic, "left").withColumn(topic, F.coalesce("new", F.lit(-1))).drop("new")


def topic_model(
    df: DataFrame, text: str = "title", min_topic_size: int = MIN_TOPIC_SIZE, dims: int = DENSITY_COMPONENTS, merge: bool = True,
    encoder: Callable | None = None, id_col: str = "listing_id",
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cluster`` and ``probability``, words per topic); -1 marks outliers."""
    vecs = materialise(embed_text(df, text, encoder, dims, id_col=id_col))
    labelled = materialise(density_cluster(vecs, min_topic_size, min_topic_size, id_col=id_col).drop("probability"))
    if merge:
        labelled = materialise(merge_topics(labelled))
    scored = topic_probability(labelled, id_col=id_col).select(id_col, "cluster", "probability")
    rows = materialise(df.join(scored, id_col))
    return rows, topic_words(rows, text)


def topic_probability(df: DataFrame, vec: str = "vec", topic: str = "cluster", id_col: str = "listing_id") -> DataFrame:
    """Rows with the share of their nearest topic: inverse centroid distances, scaled to sum one.

    Topic centroids are model-sized and travel with the task.
    """
    centers = cluster_centroids(df.where(F.col(topic) != -1), vec, [topic]).orderBy(topic).toPandas()
    if centers.empty:
        return df.withColumn("probability", F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(np.array(centers["centroid"].tolist(), dtype=float))

    @F.pandas_udf("double")
    def share(v: pd.Series) -> pd.Series:
        c = shared.value
        out = []
        x = np.array(v.tolist(), dtype=float)
        step = max(1, 4_000_000 // c.size)
        for s in range(0, len(x), step):
            d = np.sqrt(((x[s : s + step, None, :] - c[None]) ** 2).sum(axis=2))
            nearest = d.min(axis=1, keepdims=True)
            # relative to the nearest centroid, so a row on a centroid needs no special case
            ratio = np.where(d > 0, nearest / np.where(d > 0, d, 1), 1.0)
            out.append(1 / ratio.sum(axis=1))
        return pd.Series(np.concatenate(out) if out else [])

    return df.withColumn("probability", share(vec))
