"""Cluster quality measures. ``by`` scores several labelings in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from aislemap.functions.vector import distance, squared_distance, squared_norm
from aislemap.operators import shapes
from aislemap.operators.clean import text_lengths
from aislemap.operators.describe import cluster_centroids, crosstab_long, sample_key, top_n
from aislemap.operators.packing import matrix, meeting, numbers, pack, written
from aislemap.operators.partition import contingency, partition_scores
from aislemap.operators.quantiles import exact_median
from aislemap.session import materialise, small_side, spread

_ALL = "_all"

# Silhouettes compare parts of at most about this many rows.
SILHOUETTE_BLOCK = 4096
# Bytes of cluster shapes that travel to every task.
SHAPE_BYTES = 64 << 20
# Bytes of packed rows that a task compares its parts with, where sums for all clusters are handed on.
RIGHT_BYTES = 64 << 20
# Nanoseconds a pair of rows takes, and the calls for one cluster.
PAIR_TIME, CALL_TIME = 8, 60_000


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def cluster_profile(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", price: str = "price") -> DataFrame:
    """Rows (``n``), variation and relative range of the prices of every cluster, from one pass.

    Measures that need no more take it as ``profile`` in place of the rows.
    """
    mean = F.nullif(F.avg(price), F.lit(0.0))
    return df.groupBy(*by, cluster).agg(
        F.count("*").alias("n"), (F.stddev_samp(price) / mean).alias("cv"), ((F.max(price) - F.min(price)) / mean).alias("range_ratio")
    )


def partition_shape(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", profile: DataFrame | None = None) -> DataFrame:
    """Clusters, rows and rows per cluster."""
    sizes = df.groupBy(*by, cluster).agg(F.count("*").alias("n")) if profile is None else profile
    return sizes.groupBy(*by).agg(
        F.count("*").alias("num_clusters"),
        F.sum("n").alias("num_samples"),
        (F.sum("n") / F.count("*")).alias("cluster_density"),
    )


def cluster_size_stats(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", profile: DataFrame | None = None) -> DataFrame:
    """Spread of the cluster sizes and the share of clusters under one percent of the rows."""
    sizes, keys = _keyed(df.groupBy(*by, cluster).agg(F.count("*").alias("n")) if profile is None else profile, by)
    totals = sizes.groupBy(*keys).agg(F.sum("n").alias("rows"))
    out = (
        sizes.join(totals, keys)
        .groupBy(*keys)
        .agg(
            F.min("n").alias("min_cluster_size"),
            F.max("n").alias("max_cluster_size"),
            F.avg("n").alias("mean_cluster_size"),
            F.median("n").alias("median_cluster_size"),
            F.stddev_samp("n").alias("std_cluster_size"),
            (F.stddev_samp("n") / F.avg("n")).alias("cluster_size_cv"),
            (F.count_if(F.col("n") < F.col("rows") * 0.01) * 100 / F.count("*")).alias("small_clusters_pct"),
        )
    )
    return out if by else out.drop(_ALL)


def seller_concentration(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", seller: str = "seller") -> DataFrame:
    """Mean share of the largest and of the three largest sellers per cluster."""
    cells = crosstab_long(df.where(F.col(seller).isNotNull()), cluster, seller, by)
    group = [*by, cluster]
    totals = cells.groupBy(*group).agg(F.sum("n").alias("total"))
    top = top_n(cells, 3, group, F.desc("n"), F.asc(seller))
    top = top.groupBy(*group).agg(F.max("n").alias("top1"), F.sum("n").alias("top3"))
    shares = top.join(totals, group).select(
        *by, (F.col("top1") / F.col("total")).alias("p1"), (F.col("top3") / F.col("total")).alias("p3")
    )
    return shares.groupBy(*by).agg(
        F.avg("p1").alias("avg_top_seller_concentration"),
        F.avg("p3").alias("avg_top3_seller_concentration"),
        F.count_if(F.col("p1") > 0.8).alias("high_concentration_clusters"),
    )


def price_homogeneity(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", price: str = "price", profile: DataFrame | None = None) -> DataFrame:
    """Mean coefficient of variation, its complement, and mean relative price range."""
    per = cluster_profile(df, by, cluster, price) if profile is None else profile
    return per.groupBy(*by).agg(
        F.avg("cv").alias("avg_price_cv"),
        (1 - F.avg("cv")).alias("price_homogeneity"),
        F.avg("range_ratio").alias("avg_price_range_ratio"),
    )


def centroid_separability(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Mean and least distance between cluster means of price, title length and description length.

    Every cluster looks through one array of all cluster means, so pairs are never rows.
    """
    if "title_length" not in df.columns:
        df = text_lengths(df)
    df, keys = _keyed(df.select(*by, cluster, "price", "title_length", "description_length"), by)
    medians = small_side(exact_median(df, "price", keys, "_median"))
    df = df.join(medians, keys, "left").withColumn("_p", F.coalesce("price", "_median"))
    means = df.groupBy(*keys, cluster).agg(
        F.array(F.avg("_p"), F.avg("title_length"), F.avg("description_length")).alias("c")
    )
    rest = means.groupBy(*keys).agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "c")).alias("others"))
    own = F.col(cluster)
    distances = F.transform(
        F.filter("others", lambda o: o["k"] > own), lambda o: F.sqrt(squared_distance(o["c"], F.col("c")))
    )
    pairs = means.join(rest, keys).select(*keys, distances.alias("d"))
    per = pairs.select(
        *keys, F.aggregate("d", F.lit(0.0), lambda s, x: s + x).alias("s"), F.size("d").alias("n"), F.array_min("d").alias("m")
    )
    out = per.groupBy(*keys).agg(
        (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_centroid_distance"),
        F.coalesce(F.min("m"), F.lit(0.0)).alias("min_centroid_distance"),
    )
    return out if by else out.drop(_ALL)


def noise_percent(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", profile: DataFrame | None = None) -> DataFrame:
    """Share of noise rows in percent: by flag, else by label -1 and then only when there are any."""
    if "is_noise" in df.columns:
        return df.groupBy(*by).agg((F.avg(F.col("is_noise").cast("double")) * 100).alias("noise_percent"))
    share = F.avg(F.when(F.col(cluster) == -1, 1.0).otherwise(0.0)) * 100
    if profile is not None:
        df, share = profile, F.sum(F.when(F.col(cluster) == -1, F.col("n")).otherwise(0)) / F.sum("n") * 100
    return df.groupBy(*by).agg(F.when(share > 0, share).alias("noise_percent"))


def topic_coherence(summary: DataFrame) -> DataFrame:
    """The coherence a summary already carries, under one name; null when it has none."""
    found = [c for c in summary.columns if "coherence" in c.lower()]
    value = F.max(F.col(found[0]).cast("double")) if found else F.lit(None).cast("double")
    return summary.agg(value.alias("topic_coherence"))


def external_metrics(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", truths: Sequence[str] = ("division", "subcategory")) -> DataFrame:
    """Adjusted Rand, adjusted and normalised mutual information against each known grouping.

    All truths are counted in one pass: each row contributes one entry per truth.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("truth"), F.col(t).alias("u")) for t in truths]))
    long = df.select(*by, F.col(cluster).alias("v"), entries.alias("e")).select(*by, "e.truth", "e.u", "v")
    keys = [*by, "truth"]
    scores = partition_scores(contingency(long, "u", "v", keys), keys)

    def pick(truth: str, col: str):
        return F.max(F.when(F.col("truth") == truth, F.col(col)))

    named = (("rand_score", "ari"), ("mutual_info", "ami"), ("nmi", "nmi"))
    return scores.groupBy(*by).agg(*[pick(t, src).alias(f"{t}_{out}") for t in truths for out, src in named])


def method_agreement(a: DataFrame, b: DataFrame, on: str = "title", cluster: str = "cluster", labels: tuple[str, str] = ("traditional", "transformer")) -> DataFrame:
    """Agreement of two methods over listings matched on ``on``; repeated titles match many to many.

    Only (title, label) counts are joined, so a frequent title costs one row per
    pair of labels however many listings carry it.
    """
    left = a.groupBy(on, F.col(cluster).alias("u")).agg(F.count("*").cast("double").alias("n_a"))
    right = b.groupBy(on, F.col(cluster).alias("v")).agg(F.count("*").cast("double").alias("n_b"))
    cells = left.join(right, on).groupBy("u", "v").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))
    counts = [
        (a, F.count_distinct(cluster).alias(f"{labels[0]}_clusters")),
        (b, F.count_distinct(cluster).alias(f"{labels[1]}_clusters")),
    ]
    out = partition_scores(cells).select(F.col("ari").alias("adjusted_rand_score"), F.col("ami").alias("adjusted_mutual_info"))
    for df, expr in counts:
        name = f"{labels[0] if df is a else labels[1]}_clusters"
        out = out.withColumn(name, df.agg(expr).scalar())
    return out


def match_methods(a: DataFrame, b: DataFrame, on: str = "title", cluster: str = "cluster", suffixes: tuple[str, str] = ("_traditional", "_transformer")) -> DataFrame:
    """Inner join of two labelings; with ``on='title'`` repeated titles fan out, with an id they do not.

    The result can be far larger than both inputs, so a small input is spread over all cores first.
    """
    left = spread(a.select(on, F.col(cluster).alias(cluster + suffixes[0])))
    right = b.select(on, F.col(cluster).alias(cluster + suffixes[1]))
    return left.join(right, on)


# ---- measures in a vector space -------------------------------------------------


def calinski_harabasz(df: DataFrame, vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """Between over within dispersion, from one pass: counts, mean vectors and mean squared lengths."""
    stats = cluster_centroids(df, vec, [cluster])
    mean = Summarizer.mean(array_to_vector("centroid"), F.col("n").cast("double"))
    whole = stats.agg(vector_to_array(mean).alias("g")).scalar()
    stats = stats.withColumn("g", whole)
    between = F.sum(F.col("n") * squared_distance("centroid", "g"))
    within = F.sum(F.col("n") * (F.col("mean_square") - squared_norm("centroid")))
    k, n = F.count("*"), F.sum("n")
    score = F.when(within > 0, between * (n - k) / (within * (k - 1))).otherwise(1.0)
    return stats.agg(score.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to centroid distance."""
    centers = small_side(cluster_centroids(df, vec, [cluster]).select(cluster, "centroid"), 128)
    spread = df.join(centers, cluster).groupBy(cluster).agg(F.avg(distance(vec, "centroid")).alias("s"))
    centers = centers.join(spread, cluster).select(F.col(cluster).alias("k"), "s", F.col("centroid").alias("c"))
    everyone = centers.agg(F.collect_list(F.struct("k", "s", "c"))).scalar()
    centers = centers.withColumn("others", everyone)
    own, s, c = F.col("k"), F.col("s"), F.col("c")

    def ratio(o):
        d = F.sqrt(squared_distance(o["c"], c))
        return F.when(d > 0, (o["s"] + s) / d).otherwise(0.0)

    worst = F.array_max(F.transform(F.filter("others", lambda o: o["k"] != own), ratio))
    return centers.select(worst.alias("w")).agg(F.avg("w").alias("davies_bouldin"))


def _parts(sizes: list[tuple], limit: int) -> list[tuple]:
    """(keys, place, part, pieces, rows) of each (keys, rows): parts of whole clusters of one labeling; larger clusters are cut into parts of their own."""
    out, part, filled, labeling = [], 0, 0, None
    for place, (*keys, n) in enumerate(sizes):
        if filled and (filled + n > limit or keys[:-1] != labeling):
            part, filled = part + 1, 0
        pieces, labeling = -(-n // limit), keys[:-1]
        out.append((*keys, place, part, pieces, n))
        filled += n
        if pieces > 1:
            part, filled = part + pieces, 0
    return out


def _distances(x: np.ndarray, wide: np.ndarray, square: np.ndarray, y: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``. ``wide`` and ``turned`` are both with what a product of them needs to give squares."""
    norms = turned[-1]
    d2 = wide @ turned
    # the expansion loses digits for near copies: those are measured directly
    r, c = np.divmod(np.flatnonzero(d2 <= 1e-6 * (square.max() + norms.max())), len(y))
    close = d2[r, c] <= 1e-6 * (square[r] + norms[c])
    r, c = r[close], c[close]
    d2[r, c] = ((x[r] - y[c]) ** 2).sum(axis=1)
    return np.sqrt(d2, out=d2)


def _segments(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of sorted places, and where each starts, with the end."""
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return places[starts], np.r_[starts, len(places)]


def _shapes(parts: DataFrame, counts: np.ndarray, limit: int) -> np.ndarray:
    """A shape per cluster, from packed and sorted parts: whole clusters inside the task, those that are cut from sums around their means."""
    cut = np.flatnonzero(counts > limit)

    def pieces(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = numbers(batch.column(0), row)
                x = matrix(batch.column(1), row, len(own))
                there, at = _segments(own)
                found = [(int(p), m.tobytes()) for p, m in ((p, each(p, x[s:e])) for p, s, e in zip(there, at, at[1:])) if m is not None]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([m for _, m in found], pa.binary())], names=["place", "m"])

    def measured(each) -> DataFrame:
        return parts.select("place", "x").mapInArrow(lambda batches: pieces(batches, each), "place int, m binary")

    centres: dict[int, np.ndarray] = {}
    if len(cut):
        sums: dict[int, np.ndarray] = {}
        for r in measured(lambda p, x: x.sum(axis=0) if counts[p] > limit else None).collect():
            sums[r["place"]] = sums.get(r["place"], 0) + np.frombuffer(r["m"])
        centres = {p: m / counts[p] for p, m in sums.items()}

    def own_shape(p: int, x: np.ndarray) -> np.ndarray | None:
        if counts[p] > limit:
            return None
        centre = x.mean(axis=0)
        return shapes.shape(shapes.moments(x, centre), centre)

    found = measured(own_shape)
    if len(cut):
        def joined(table: pa.Table) -> pa.Table:
            place = table.column("place")[0].as_py()
            total = sum(np.frombuffer(m.as_buffer()) for m in table.column("m"))
            return pa.table([table.column("place")[:1], pa.array([shapes.shape(total, centres[place]).tobytes()], pa.binary())], names=["place", "m"])

        apart = measured(lambda p, x: shapes.moments(x, centres[p]) if counts[p] > limit else None)
        found = found.unionByName(apart.groupBy("place").applyInArrow(joined, "place int, m binary"))
    return np.vstack([np.frombuffer(r["m"]) for r in sorted(found.collect(), key=lambda r: r["place"])])


def silhouette_rows(
    df: DataFrame, vec: str = "vec", cluster: str = "cluster", id_col: str = "listing_id", scored: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """(id, cluster, silhouette) by plain Euclidean distance to every row.

    Rows are packed into parts of bounded size that hold whole clusters where these are small enough, and
    parts are read where they meet, not shuffled. A row is compared with its own cluster and with every
    other one that can have the least mean distance from it by the shapes of the clusters; a part meets the parts of
    these. A task hands on, per row, the sum over its own cluster, the least mean over the others it has wholly
    seen, and a sum for each cluster that is cut. Where the shapes are too many to travel, all clusters are compared.
    ``scored`` limits the rows that get a value (by id), never the rows they are compared with.
    ``by`` names a column that tells labelings apart; rows are compared inside theirs, and it stays in the result.
    """
    spark, limit = df.sparkSession, SILHOUETTE_BLOCK
    keys = ["m", "k"] if by else ["k"]
    given = {"m": by, "k": cluster}
    points = materialise(df.select(F.col(id_col).alias("i"), *[F.col(given[c]).alias(c) for c in keys], F.col(vec).alias("x")))
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys)
    sizes = sorted(tuple(r) for r in points.groupBy(*keys).agg(F.count("*").alias("n")).collect())
    counts = np.array([s[-1] for s in sizes], dtype=float)
    # clusters that several parts hold, by their place among all clusters
    cut = np.flatnonzero(counts > limit)
    plan = _parts(sizes, limit)
    dealt = F.broadcast(spark.createDataFrame(plan, f"{kinds}, place int, part long, pieces long, n long"))

    def packed(rows: DataFrame) -> DataFrame:
        piece = F.col("part") + F.pmod(F.xxhash64("i"), F.col("pieces"))
        return pack(rows.join(dealt, keys).select(piece.alias("part"), "i", "place", "x"), "part", "x", "place")

    right = packed(points)
    left = right if scored is None else packed(points.join(scored.select(F.col(id_col).alias("i")), "i", "left_semi"))
    # the labeling of every cluster as the places where it starts and ends
    labeling = np.unique([s[:-2] for s in sizes], axis=0, return_inverse=True)[1].ravel() if by else np.zeros(len(sizes), int)
    start, end = np.searchsorted(labeling, labeling), np.searchsorted(labeling, labeling, side="right")
    first, pieces = np.array([p[-3] for p in plan], dtype=np.int64), np.array([p[-2] for p in plan], dtype=np.int64)
    row = right.select((F.octet_length("x") / 8 / F.size("place")).cast("int")).first()
    fits = row is not None and len(sizes) * 8 * shapes.width(row[0]) <= SHAPE_BYTES
    known = _shapes(right, counts, limit) if fits else None
    shared = spark.sparkContext.broadcast((counts, cut, start, end, first, pieces, known))
    kind_of_id = points.schema["i"].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts with the clusters each row is compared with, as bits, and the parts that hold them."""
        _, _, start, end, first, pieces, known = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = numbers(batch.column("place"), row)
                lo, hi = start[own[0]], end[own[0]]
                if known is None:
                    need, there = b"", np.arange(lo, hi)
                else:
                    need = shapes.reachable(matrix(batch.column("x"), row, len(own)), own - lo, known[lo:hi])
                    need, there = np.packbits(need, axis=1).tobytes(), lo + np.flatnonzero(need.any(axis=0))
                targets = np.unique(np.concatenate([np.arange(first[p], first[p] + pieces[p]) for p in there]))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (batch.column("i")[row].values, pa.array(own), pa.array(targets))]
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(row, 1), *lists, batch.column("x").slice(row, 1), pa.array([need], pa.binary())], names=["part", "i", "place", "targets", "x", "need"])

    left = written(left.mapInArrow(asked, f"part long, i array<{kind_of_id}>, place array<int>, targets array<long>, x binary, need binary"))
    met = meeting(left, right.select(F.col("part").alias("part2"), F.col("place").alias("place2"), F.col("x").alias("x2")), F.array_contains("targets", F.col("part2")))
    names = ["part", "i", "place", "own", "best", "at", "s"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cut, start, end, *_ = shared.value
        held = None

        def handed(held) -> pa.RecordBatch:
            part, ids, own, *_, need, seen, mine, best, apart = held
            lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), c) for c in (ids, pa.array(own))]
            # sums of clusters that are cut, where they matter and a piece was met
            at = np.flatnonzero(need[:, cut[seen] - start[own[0]]])
            rows, cols = np.divmod(at, max(1, len(seen)))
            found = mine, best, rows * len(cut) + seen[cols], apart[rows, seen[cols]]
            return pa.RecordBatch.from_arrays([pa.array([part]), *lists, *[pa.array([m.tobytes()], pa.binary()) for m in found]], names=names)

        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                part = cols["part"][row].as_py()
                if held is None or held[0] != part:
                    if held is not None:
                        yield handed(held)
                    own = numbers(cols["place"], row)
                    x, lo, hi = matrix(cols["x"], row, len(own)), start[own[0]], end[own[0]]
                    bits = np.frombuffer(cols["need"][row].as_buffer(), np.uint8)
                    need = np.unpackbits(bits.reshape(len(own), -1), axis=1)[:, : hi - lo].astype(bool) if len(bits) else np.ones((len(own), hi - lo), bool)
                    square = (x**2).sum(axis=1)
                    wide = np.column_stack([x, square, np.ones(len(x))])
                    held = part, cols["i"][row].values, own, x, wide, square, need, np.empty(0, int), np.zeros(len(own)), np.full(len(own), np.inf), np.zeros((len(own), len(cut)))
                *some, x, wide, square, need, seen, mine, best, apart = held
                own, lo = some[-1], start[some[-1][0]]
                theirs = numbers(cols["place2"], row)
                y = matrix(cols["x2"], row, len(theirs))
                turned = np.vstack([-2 * y.T, np.ones(len(y)), (y**2).sum(axis=1)])
                there, starts = _segments(theirs)
                whole = counts[there] <= limit
                held = *some, x, wide, square, need, np.union1d(seen, np.searchsorted(cut, there[~whole])).astype(int), mine, best, apart
                asks = need[:, there - lo]
                if PAIR_TIME * float(asks.sum(axis=0) @ np.diff(starts)) + CALL_TIME * len(there) < PAIR_TIME * len(x) * len(y):
                    # few pairs matter: rows meet the clusters that they are compared with, one after the other
                    for j, place in enumerate(there):
                        rows, at = np.flatnonzero(asks[:, j]), slice(starts[j], starts[j + 1])
                        step = max(1, (1 << 20) // (at.stop - at.start))
                        for s in range(0, len(rows), step):
                            r = rows[s : s + step]
                            total = _distances(x[r], wide[r], square[r], y[at], turned[:, at]).sum(axis=1)
                            if whole[j]:
                                same = own[r] == place
                                mine[r] += np.where(same, total, 0.0)
                                best[r] = np.minimum(best[r], np.where(same, np.inf, total / counts[place]))
                            else:
                                apart[r, np.searchsorted(cut, place)] += total
                    continue
                for s in range(0, len(x), 256):
                    at = slice(s, s + 256)
                    total = np.add.reduceat(_distances(x[at], wide[at], square[at], y, turned), starts[:-1], axis=1)
                    same = own[at][:, None] == there[None, :]
                    mine[at] += np.where(same & whole, total, 0.0).sum(axis=1)
                    best[at] = np.minimum(best[at], np.where(same | ~whole, np.inf, total / counts[there]).min(axis=1))
                    apart[at, np.searchsorted(cut, there[~whole])] += total[:, ~whole]
        if held is not None:
            yield handed(held)

    def finish(table: pa.Table) -> pa.Table:
        counts, cut, *_ = shared.value
        ids, own = table.column("i")[0].values, numbers(table.column("place"), 0)

        def all_of(name: str, kind=float) -> list[np.ndarray]:
            return [np.frombuffer(m.as_buffer(), kind) for m in table.column(name)]

        mine, best = np.sum(all_of("own"), axis=0), np.min(all_of("best"), axis=0)
        at, cells = np.concatenate(all_of("at", np.int64)), len(own) * len(cut)
        apart = np.where(np.bincount(at, minlength=cells) > 0, np.bincount(at, np.concatenate(all_of("s")), cells), np.inf).reshape(len(own), len(cut))
        same = own[:, None] == cut[None, :]
        mine = mine + np.where(same, apart, 0.0).sum(axis=1)
        best = np.minimum(best, np.where(same, np.inf, apart / counts[cut]).min(axis=1, initial=np.inf))
        a = mine / np.maximum(counts[own] - 1, 1)
        return pa.table([ids, pa.array(own), pa.array(a), pa.array(best)], names=["i", "place", "a", "b"])

    seen = written(met.select("part", "i", "place", "x", "need", "place2", "x2").mapInArrow(sums, f"part long, i array<{kind_of_id}>, place array<int>, own binary, best binary, at binary, s binary"))
    found = seen.groupBy("part").applyInArrow(finish, f"i {kind_of_id}, place int, a double, b double")
    total = found.join(dealt.select(*keys, "place", "n"), "place")
    # without another cluster there is no value
    total = total.withColumn("b", F.when(F.col("b") < float("inf"), F.col("b"))).withColumn("top", F.greatest("a", "b"))
    value = F.when((F.col("n") > 1) & (F.col("top") > 0), (F.col("b") - F.col("a")) / F.col("top")).otherwise(0.0)
    return total.select(*([F.col("m").alias(by)] if by else []), F.col("i").alias(id_col), F.col("k").alias(cluster), value.alias("silhouette"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "listing_id") -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed."""
    picked = df.select(id_col, sample_key(id_col, seed).alias("_k")).orderBy("_k", id_col).limit(n).select(id_col)
    return df.join(F.broadcast(picked), id_col, "left_semi")


def silhouette(
    df: DataFrame, vec: str = "vec", cluster: str = "cluster", id_col: str = "listing_id", seed: int = 42, sample: int | None = None, by: str | None = None
) -> DataFrame:
    """Mean silhouette of all rows, or of a seeded ``sample`` of them compared with all rows; per labeling with ``by``."""
    scored = sample_rows(df, sample, seed, id_col) if sample else None
    return silhouette_rows(df, vec, cluster, id_col, scored, by).groupBy(*([by] if by else [])).agg(F.avg("silhouette").alias("silhouette_score"))


def silhouettes(df: DataFrame, vec: str = "vec", clusters: str = "clusters", id_col: str = "listing_id") -> DataFrame:
    """(model, silhouette_score): mean silhouettes of several labelings with few clusters in all, given as an array of labels per row.

    Every two rows are measured once for all labelings. Rows are sorted by their labels, so that
    the rows of a part that all labelings keep together are added up before they are added to the clusters.
    """
    spark = df.sparkSession
    points = materialise(df.select(F.col(id_col).alias("i"), F.col(clusters).alias("c"), F.col(vec).alias("x")))
    sizes = sorted(tuple(r) for r in points.select(F.posexplode("c").alias("m", "k")).groupBy("m", "k").agg(F.count("*").alias("n")).collect())
    models, counts = np.array([m for m, _, _ in sizes], dtype=int), np.array([n for _, _, n in sizes], dtype=float)
    n = int(counts[models == 0].sum())
    # every label by its place among the clusters of all labelings
    place = F.create_map(*[F.lit(v) for at, (m, k, _) in enumerate(sizes) for v in (f"{m} {k}", at)]) if sizes else F.lit(None)
    placed = points.withColumn("c", F.transform("c", lambda k, m: F.element_at(place, F.concat_ws(" ", m, k))))
    placed = materialise(placed.repartitionByRange(max(1, -(-n // SILHOUETTE_BLOCK)), "c", "i").withColumn("part", F.spark_partition_id()))
    packed = pack(placed, "part", "x")
    size = int(packed.agg(F.sum(F.octet_length("x"))).first()[0] or 0)
    # a task hands on sums for all its rows and clusters, so few tasks share the rows of a part
    right = packed.select(F.col("c").alias("c2"), F.col("x").alias("x2")).coalesce(max(4, size // RIGHT_BYTES))
    shared = spark.sparkContext.broadcast((models, counts))

    def labels(column: pa.Array, row: int) -> np.ndarray:
        lists = column[row].values
        return lists.flatten().to_numpy(zero_copy_only=False).astype(int).reshape(len(lists), -1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, _ = shared.value
        held = None

        def handed(held) -> pa.RecordBatch:
            part, own, *_, total = held
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["part", "c", "s"])

        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                part = cols["part"][row].as_py()
                if held is None or held[0] != part:
                    if held is not None:
                        yield handed(held)
                    own = labels(cols["c"], row)
                    x = matrix(cols["x"], row, len(own))
                    square = (x**2).sum(axis=1)
                    held = part, own, x, np.column_stack([x, square, np.ones(len(x))]), square, np.zeros((len(x), len(models)))
                _, own, x, wide, square, total = held
                theirs = labels(cols["c2"], row)
                order = np.lexsort(theirs.T)
                theirs, y = theirs[order], matrix(cols["x2"], row, len(theirs))[order]
                starts = np.flatnonzero(np.r_[True, (theirs[1:] != theirs[:-1]).any(axis=1)])
                member = np.zeros((len(starts), len(models)))
                member[np.arange(len(starts))[:, None], theirs[starts]] = 1
                turned = np.vstack([-2 * y.T, np.ones(len(y)), (y**2).sum(axis=1)])
                for s in range(0, len(x), 256):
                    at = slice(s, s + 256)
                    total[at] += np.add.reduceat(_distances(x[at], wide[at], square[at], y, turned), starts, axis=1) @ member
        if held is not None:
            yield handed(held)

    def finish(table: pa.Table) -> pa.Table:
        models, counts = shared.value
        own = np.frombuffer(table.column("c")[0].as_buffer(), int).reshape(-1, models[-1] + 1)
        total = sum(np.frombuffer(m.as_buffer()) for m in table.column("s")).reshape(len(own), -1)
        mean, out = total / counts, []
        for m in range(own.shape[1]):
            mine = own[:, m]
            a = total[np.arange(len(own)), mine] / np.maximum(counts[mine] - 1, 1)
            b = np.where((models == m) & (np.arange(len(models)) != mine[:, None]), mean, np.inf).min(axis=1)
            top = np.maximum(a, b)
            value = np.divide(b - a, top, out=np.zeros(len(own)), where=(counts[mine] > 1) & (top > 0) & np.isfinite(b))
            # without another cluster there is no value
            out.append((m, float(value.sum()), int((np.isfinite(b) | (counts[mine] == 1)).sum())))
        return pa.table([pa.array(v) for v in zip(*out)], names=["model", "total", "n"])

    met = meeting(packed.select("part", "c", "x"), right)
    seen = written(met.mapInArrow(sums, "part int, c binary, s binary"))
    found = seen.groupBy("part").applyInArrow(finish, "model long, total double, n long")
    return found.groupBy("model").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("silhouette_score"))


def silhouette_fast(df: DataFrame, vec: str = "vec", cluster: str = "cluster") -> float:
    """Spark ML's silhouette (squared Euclidean), linear in the rows; not the same number as ``silhouette``."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    data = df.select(array_to_vector(vec).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(data)


def basic_cluster_metrics(df: DataFrame, vec: str = "vec", cluster: str = "cluster", id_col: str = "listing_id") -> DataFrame:
    """Silhouette, Davies-Bouldin, Calinski-Harabasz, noise share and clusters without noise."""
    whole = df.agg(F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("num_clusters"))
    parts = [
        (silhouette(df, vec, cluster, id_col), "silhouette_score", "silhouette"),
        (davies_bouldin(df, vec, cluster), "davies_bouldin", "davies_bouldin"),
        (calinski_harabasz(df, vec, cluster), "calinski_harabasz", "calinski_harabasz"),
        (noise_percent(df.drop("is_noise"), (), cluster), "noise_percent", "noise_percentage"),
    ]
    for part, src, out in parts:
        whole = whole.withColumn(out, part.select(src).scalar())
    return whole
