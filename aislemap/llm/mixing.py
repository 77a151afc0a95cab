"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within their source. Whole passes and a proportional
part of every length take most of a source's target; a bounded-knapsack dynamic programme
over the lengths that are left meets the rest. Seeded documents fill the counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislemap.llm.common import binary, number_hash, seeded_rank, space_words, whole_row_hash
from aislemap.session import materialise

SHARE = 1.5
WEIGHTS = (3, 1, 2)
CAP = 2
SEED = "mix"
# Words left to the dynamic programme once proportional counts and single documents are taken.
PROGRAMME_WORDS = 1 << 15


def _counts(texts: pa.Array) -> pa.Array:
    return pa.array([len(space_words(t)) for t in binary(texts)], pa.int64())


def count_words(text) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.arrow_udf(_counts, "long")(text)


def targets(totals: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) with ``target``: weights repeat over the sources by code point, null last.

    A target stops at ``cap`` times its source; what is cut off is shared anew by weight among
    the others. The sources fill up in the order of cap by weight, so sums over that order tell which are full.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    df = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(cap))
    df = df.withColumn("budget", F.sum("source_size").over(every) * float(share))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumn("rate", left / open_weight).withColumn("full", F.col("cap") <= F.col("rate") * F.col("weight"))
    # the first source that is not full has the rate of all that are not
    rate = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("rate").alias("r")))).over(every)
    return df.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(rate["r"] * F.col("weight"))).select("source", "source_size", "target")


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, salt: str = "") -> tuple[int, np.ndarray]:
    """Whole passes over all documents, and how many documents of each size to take once more."""
    total = int((sizes * counts).sum())
    extra = np.zeros(len(sizes), np.int64)
    if total == 0:
        return 1, extra
    passes = int(target // total)
    rest = int(round(target - passes * total))
    extra = np.array([int(c) * rest // total for c in counts], np.int64)
    left = rest - int((extra * sizes).sum())
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: xxhash.xxh64_intdigest(f"{salt}|{sizes[i]}"))
    taken = True
    while left > PROGRAMME_WORDS and taken:
        taken = False
        for i in order:
            if extra[i] < counts[i] and sizes[i] <= left - PROGRAMME_WORDS // 2:
                extra[i] += 1
                left -= int(sizes[i])
                taken = True
    return passes, extra + knapsack(sizes, counts - extra, left)


def knapsack(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size, at most ``free``, come closest to ``budget`` from below."""
    chosen = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return chosen
    first = np.full(budget + 1, -1, np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    packs: list[tuple[int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        size, many, pack = int(sizes[i]), int(free[i]), 1
        many = min(many, budget // size) if size else 0
        while many > 0 and not reached[budget]:
            pack = min(pack, many)
            many -= pack
            weight = pack * size
            new = np.zeros_like(reached)
            new[weight:] = reached[: budget + 1 - weight]
            new &= ~reached
            first[new] = len(packs)
            reached |= new
            packs.append((int(i), pack))
            pack *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, pack = packs[first[at]]
        chosen[i] += pack
        at -= pack * int(sizes[i])
    return chosen


def plan_lengths(sized: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """source, size, source_size, target, passes, extra for every length of every source.

    A source has fewer lengths than the root of twice its words, whatever its documents.
    """
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("count"))
    totals = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), **shares)
    totals = totals.withColumnRenamed("source", "of")
    known = lengths.join(totals, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def per_source(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("size")
        salt = f"{seed}|{df['source'].iloc[0]}"
        passes, extra = fit(df["size"].to_numpy(), df["count"].to_numpy(), float(df["target"].iloc[0]), salt)
        return df.assign(passes=passes, extra=extra)[["source", "size", "count", "source_size", "target", "passes", "extra"]]

    return known.groupBy("source").applyInPandas(per_source, "source string, size long, count long, source_size long, target double, passes int, extra long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, size: str | None = None, **shares) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the row, 0 to 2).

    Size is the number of words, or a given column of ``docs``; null text has none, and such rows are taken as often as
    their source is passed over. A null source is a source of its own, the last. Rows with
    equal ids are separate rows. Columns with the names of results are replaced. No rows give no rows.
    """
    words = F.col(size) if size else count_words(F.col(text))
    sized = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), F.col(doc_id).alias("id"), whole_row_hash(docs).alias("tie"), words.alias("size"))
    narrow = materialise(sized.select("source", "size"))
    plan = materialise(plan_lengths(narrow, seed, **shares))
    keyed = sized.withColumn("hash", number_hash(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ranked = seeded_rank(keyed, ["source", "size"], "hash", ["id", "tie"], narrow.count(), plan.select("source", "size", "source_size", "target", "passes", "extra"))
    copies = (F.col("passes") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)).cast("int")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    return ranked.select(*kept, "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, repeated as often as they are taken, with the columns of ``docs``."""
    out = mix(docs, **options).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select(*docs.columns)
