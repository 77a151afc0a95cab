"""Exact dedup with a heavy-hitter split.

Digests of normalised texts that are frequent, found by a Misra-Gries sketch, get their
winner from map-side aggregates and a bounded broadcast. All others are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aislemap.llm.common import SPACES
from aislemap.session import materialise

# A digest is heavy if the sketch gives it at least one row in HEAVY_SHARE; at most this many are broadcast.
HEAVY_SHARE = 500
TRACKED = 4096
# The sketches of the tasks are merged in two levels, so that no task gets them all.
SKETCH_GROUPS = 64


def normalised(text):
    """Text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def heavy_hashes(digests: DataFrame, share: int = HEAVY_SHARE) -> DataFrame:
    """The hashes of frequent digests: at most ``2 * share`` rows. No digest with more than a ``share``-th of the rows is missing."""
    parts = digests.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(hash, {TRACKED})").alias("sketch"), F.count("*").alias("rows")
    )
    # one group, but a grouped aggregate: the sketch functions fail on parts without rows
    found = parts.groupBy(F.floor(F.col("part") / SKETCH_GROUPS).alias("all")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {2 * share})").alias("top"), F.sum("rows").alias("rows")
    )
    top = found.select("rows", F.explode("top").alias("item"))
    return top.where(F.col("item.count") * share >= F.col("rows")).select(F.col("item.item").alias("hash"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: int = HEAVY_SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree without ASCII white space; null and empty texts are equal.
    Of equal texts the longest original stays, then the smallest id (null last). Rows that
    repeat id and text are separate rows, one of which is kept. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    original = F.col(text)
    digest = F.unhex(F.sha2(normalised(original).cast("binary"), 256))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.coalesce(F.char_length(original), F.lit(0)).alias("length"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = materialise(base.withColumn("hash", F.xxhash64("digest")))
    heavy = materialise(heavy_hashes(base, share))
    order = F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))

    # the sketch bounds this side: at most 2 * share hashes and as many winners
    frequent = base.join(F.broadcast(heavy), "hash")
    winners = frequent.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    split = frequent.join(F.broadcast(winners), "digest").select(
        "doc_id", F.col("best.i").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "digest"
    )
    same = Window.partitionBy("digest")
    rest = base.join(F.broadcast(heavy), "hash", "left_anti").withColumn("best", F.min(order).over(same)).withColumn("group_size", F.count("*").over(same))
    rest = rest.select("doc_id", F.col("best.i").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "digest")
    return split.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns. Repeated ids must be told apart by text."""
    decided = exact_dedup(docs, text, doc_id).where("kept").select(F.col("keep_id").alias("stay"))
    return docs.join(decided, F.col(doc_id).eqNullSafe(F.col("stay")), "left_semi")
