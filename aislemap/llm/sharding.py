"""Shards that all match the mixture: proportional stratified interleaving.

Seeded-shuffled rows are ranked within their source, all rows are put in the order of their
fractional rank, and that order is cut into shards of equal counts. The order is taken from
ranges of (fractional rank, source), so sources of one row, which all have the same rank, are
spread over tasks like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aislemap.llm.common import seeded_rank, whole_row_hash
from aislemap.session import materialise, small_side

SHARDS = 40
SEED = "shards"


def hex_hash(*columns):
    """62 bits of an MD5, which every SQL engine can repeat."""
    digest = F.md5(F.concat_ws("|", *columns).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").bitwiseAND(F.lit((1 << 60) - 1)) * 4


def interleave(docs: DataFrame, shards: int = SHARDS, source: str = "source", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0, no gaps, in the shard).

    Shards differ by at most one row in size, and any source by about one row from its
    share. A null source is a source of its own. Rows with equal ids are ordered by their
    other columns; identical rows are interchangeable. Columns called shard or slot are
    replaced. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    n = docs.count()
    mixed = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("id"), whole_row_hash(docs).alias("tie"))
    mixed = mixed.withColumn("hash", hex_hash(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ranked = seeded_rank(mixed, ["source"], "hash", ["id", "tie"], n)
    ranked = ranked.withColumn("part", (F.col("rank") + 0.5) / F.col("of"))

    # no two rows share part and source, so ranges of both have no group that cannot be cut
    order = [F.col("part"), F.col("source").asc_nulls_last()]
    dealt = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialise(dealt.select("row", F.spark_partition_id().alias("piece"), inside.alias("place")))
    # one row per range
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("piece").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = dealt.join(small_side(starts, 2), "piece").withColumn("at", F.col("start") + F.col("place"))
    placed = placed.withColumn("cut", F.expr(f"(at * {shards}) div {max(n, 1)}"))
    first = F.expr(f"(cut * {n} + {shards - 1}) div {shards}")
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*[F.col(f"row.`{c}`") for c in keep], F.col("cut").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))
