"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aislemap.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest node.

    Each round takes the smallest label among the neighbours and then the label's own label.
    Hubs only meet in sums that are pre-aggregated, never as groups.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = materialise(lower.join(above, "root", "left").select("node", "was", F.least("root", "top").alias("root")))
        labels = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return labels
