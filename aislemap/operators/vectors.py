"""Reduction, sampling, nearest neighbours and block-wise search over vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import PCA
from pyspark.ml.stat import Summarizer
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window, functions as F

from aislemap.functions.vector import unit
from aislemap.operators.packing import matrix, meeting, numbers, pack, written
from aislemap.operators.quality import sample_rows
from aislemap.operators.quantiles import exact_quantiles
from aislemap.session import materialise

seeded_sample = sample_rows

# Default numbers of components.
SVD_COMPONENTS, DENSITY_COMPONENTS = 100, 20


@dataclass
class Reduction:
    """Reduced vectors (id, vec), singular values and the term side of the decomposition."""

    vectors: DataFrame
    singular_values: np.ndarray
    components: np.ndarray  # features x k

    def term_loadings(self, spark, terms: list[str]) -> DataFrame:
        """(component, term, loading) for the first ``len(terms)`` features."""
        part = self.components[: len(terms)]
        wide = pd.DataFrame({"term": terms, "v": [row.tolist() for row in part]})
        df = spark.createDataFrame(wide, "term string, v array<double>")
        return df.select("term", F.posexplode("v").alias("component", "loading"))


def truncated_svd(df: DataFrame, k: int = SVD_COMPONENTS, vec: str = "features", id_col: str = "listing_id") -> Reduction:
    """Uncentred rank-``k`` projection of ML vectors, signs fixed.

    The largest entry of every component is positive, so repeated runs agree.
    """
    rows = MLUtils.convertVectorColumnsFromML(df.select(F.col(id_col).cast("bigint"), vec), vec)
    rows.persist()
    try:
        matrix = IndexedRowMatrix(rows)
        svd = matrix.computeSVD(k, computeU=False)
        v = np.array(svd.V.toArray())
        strongest = np.abs(v).argmax(axis=0)
        v = v * np.where(v[strongest, np.arange(v.shape[1])] < 0, -1.0, 1.0)
        projected = matrix.multiply(DenseMatrix(v.shape[0], v.shape[1], v.flatten(order="F").tolist()))
        # rows stay in the JVM: (index, vector)
        out = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
        out = MLUtils.convertVectorColumnsToML(out, "vector")
        vectors = materialise(out.select(F.col("index").alias(id_col), vector_to_array("vector").alias("vec")))
    finally:
        rows.unpersist()
    return Reduction(vectors, np.array(svd.s.toArray()), v)


def explained_variance(original: DataFrame, reduced: DataFrame, vec: str = "vec") -> DataFrame:
    """Share of the total variance kept by each component, and their sum.

    Both tables have an array of doubles; ``original`` holds the full vectors.
    """

    def variances(df: DataFrame) -> DataFrame:
        v = Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(vec)))
        row = df.agg(v.alias("s")).select(vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n"))
        # Spark's variance divides by n - 1
        return row.select(F.transform("v", lambda x: x * (F.col("n") - 1) / F.col("n")).alias("v"))

    total = variances(original).select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).scalar()
    kept = variances(reduced).withColumn("total", total)
    return kept.select(F.posexplode(F.transform("v", lambda x: x / F.col("total"))).alias("component", "ratio"))


def project_2d(df: DataFrame, vec: str = "vec", id_col: str = "listing_id") -> DataFrame:
    """(id, x, y): the two leading principal components, for plotting."""
    rows = df.select("*", array_to_vector(F.col(vec)).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    pc = model.pc.toArray()
    signs = np.where(pc[np.abs(pc).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)
    p = vector_to_array("_p")
    keep = [c for c in df.columns if c != vec]
    return model.transform(rows).select(*keep, (p[0] * float(signs[0])).alias("x"), (p[1] * float(signs[1])).alias("y"))


def zoom_bounds(df: DataFrame, cluster: str = "cluster", min_points: int = 10) -> DataFrame:
    """Plot limits from the 2.5 and 97.5 percentiles of non-noise points, padded by a tenth of the range."""
    points = df.where(F.col(cluster) != -1)
    x = exact_quantiles(points, "x", [0.025, 0.975], names=["x0", "x1"]).select(F.struct("x0", "x1")).scalar()
    y = exact_quantiles(points, "y", [0.025, 0.975], names=["y0", "y1"]).select(F.struct("y0", "y1")).scalar()
    row = points.agg(F.count("*").alias("n")).withColumn("qx", x).withColumn("qy", y).select("n", "qx.*", "qy.*")
    enough = F.col("n") >= min_points
    cells = []
    for axis in ("x", "y"):
        low, high = F.col(axis + "0"), F.col(axis + "1")
        pad = (high - low) * 0.1
        cells += [F.when(enough, low - pad).alias(axis + "_min"), F.when(enough, high + pad).alias(axis + "_max")]
    return row.select(*cells)


# ---- block-wise search ----------------------------------------------------------
#
# Points are sorted into cells around pivots and cells are cut into blocks of
# bounded size. A block is compared with another block only if the triangle
# inequality over their pivots leaves room for a better partner, so the search is
# exact, and only the best partners of each point leave a task. Blocks are written
# once and read where they meet; their vectors are shuffled once, into blocks.

BLOCK_ROWS = 1024
# Squared lengths that single precision can hold with room for products.
LARGEST_SINGLE = 1e24


@dataclass
class Blocks:
    points: DataFrame  # id, vec and further columns, with block
    summary: pd.DataFrame  # block, pivot, radius, rows, least size
    pivots: np.ndarray


def make_blocks(df: DataFrame, id_col: str = "id", vec: str = "vec", block_rows: int | None = None, rows: int | None = None) -> Blocks:
    """Assign every point to its nearest pivot and cut each cell into blocks of about ``block_rows``.

    Pivots are points drawn in hash order, so dense regions get many of them and
    no cell grows with the data's skew. Their number grows with the root of the
    ``rows``, which are counted if not given.
    """
    spark, block_rows = df.sparkSession, block_rows or BLOCK_ROWS
    n = df.count() if rows is None else rows
    if n <= block_rows:
        # one block has no other to be told from
        only = pd.DataFrame({"block": [0], "cell": [0], "radius": [0.0], "rows": [n], "least": [1]})
        return Blocks(df.withColumn("block", F.lit(0).cast("bigint")), only, np.zeros((1, 1)))
    m = int(max(1, min(n // block_rows, np.sqrt(n))))
    chosen = sample_rows(df.select(id_col, vec), m, 7, id_col).toPandas()
    pivots = np.array(chosen[vec].tolist(), dtype=float).reshape(len(chosen), -1)
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, far double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        p = shared.value
        x = np.array(v.tolist(), dtype=float)
        d2 = (x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * x @ p.T
        cell = d2.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": np.sqrt(((x - p[cell]) ** 2).sum(1))})

    placed = df.withColumn("_n", nearest(vec)).select("*", "_n.cell", "_n.far").drop("_n")
    placed = materialise(placed)
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
    pieces = [(r["cell"], -(-r["n"] // block_rows)) for r in counts.collect()]
    # a row per pivot, so at most the root of the rows
    split = F.broadcast(spark.createDataFrame(pieces, "cell int, pieces long"))
    sub = F.pmod(F.xxhash64(id_col), F.col("pieces"))
    placed = placed.join(split, "cell").withColumn("block", F.col("cell").cast("bigint") * 1_000_000 + sub).drop("pieces")
    least = F.min("size") if "size" in df.columns else F.lit(1)
    summary = placed.groupBy("block", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("rows"), least.alias("least")).toPandas()
    return Blocks(placed.drop("cell", "far"), summary.sort_values("block").reset_index(drop=True), pivots)


def block_search(
    blocks: Blocks, kernel: str, k: int = 1, id_col: str = "id", vec: str = "vec", extra: tuple[str, ...] = (),
    bound: str | None = None, ask: str | None = None,
) -> DataFrame:
    """(id, other, value): the ``k`` best partners of every point, exactly.

    Kernels: ``knn`` (distance), ``ward`` (merge cost from centroids and sizes in
    ``extra[0]``), ``foreign`` (mutual reachability to another component, with core
    distances and components in ``extra``). Ties go to the lower pair of ids.
    ``bound`` names a column with a known upper bound of the best value, ``ask`` a
    boolean column: only points where it is true search, among all points.
    """
    spark = blocks.points.sparkSession
    info = blocks.summary
    meta = spark.sparkContext.broadcast(
        (info["block"].to_numpy(), info["cell"].to_numpy(), info["radius"].to_numpy(), info["least"].to_numpy(), blocks.pivots)
    )
    cols = [id_col, vec, *extra, *([bound] if bound else []), *([ask] if ask else [])]
    packed = pack(blocks.points.select("block", *cols), "block", vec)
    single = len(info) == 1  # then nothing is left to compare

    def unpack(batch: pa.RecordBatch, row: int, prefix: str = ""):
        ids = numbers(batch.column(prefix + id_col), row)
        return ids, matrix(batch.column(prefix + vec), row, len(ids)), [numbers(batch.column(prefix + e), row) for e in extra]

    def values(d2, left, right):
        """The value that is minimised, from squared distances, in their precision. It never falls as they grow."""
        if kernel == "knn":
            return np.sqrt(d2)
        if kernel == "ward":
            a, b = left[0].astype(d2.dtype), right[0].astype(d2.dtype)
            return a * b / (a + b) * d2
        cores = np.maximum(left[0].astype(d2.dtype), right[0].astype(d2.dtype))
        return np.where(left[1] == right[1], np.inf, np.maximum(cores, np.sqrt(d2)))

    def best(left, right, limit, same=False):
        """Up to k best partners per left row, and those as good up to rounding: (row, other id, value). ``same``: both are one block.

        All pairs are looked at in single precision, from below: what rounding can add to a squared
        distance is taken off. Pairs that may be good enough are measured exactly.
        """
        ids_l, x, ex_l = left
        ids_r, y, ex_r = right
        rows, others, found = [], [], []
        # around a point of the block, squares are hardly larger than the distances
        middle = x.mean(axis=0)
        u, v = x - middle, y - middle
        square, norms = (u**2).sum(1), (v**2).sum(1)
        kind = np.float32 if max(square.max(), norms.max()) < LARGEST_SINGLE else np.float64
        lost = np.finfo(kind).eps * (x.shape[1] + 6) * (np.sqrt(square) + np.sqrt(norms.max())) ** 2
        turned = np.vstack([-2 * v.T, np.ones(len(v)), norms]).astype(kind)
        wide = np.column_stack([u, square - lost, np.ones(len(u))]).astype(kind)

        def exact(s, r, c):
            return values(((x[s + r] - y[c]) ** 2).sum(1), [e[s + r] for e in ex_l], [e[c] for e in ex_r])

        for s in range(0, len(x), 256):
            d2 = wide[s : s + 256] @ turned
            rough = values(np.maximum(d2, 0, out=d2), [e[s : s + 256][:, None] for e in ex_l], [e[None, :] for e in ex_r])
            if same:
                rough[ids_l[s : s + 256][:, None] == ids_r[None, :]] = np.inf

            def candidates(cut):
                # up to rounding; they are measured exactly, in an order that is the same from both sides
                slack = 1e-6 * (1 + np.where(np.isfinite(cut), np.abs(cut), 0))
                most = np.finfo(kind).max
                return np.flatnonzero(rough <= np.where(np.isfinite(cut), np.minimum(cut + slack, most), most).astype(kind)[:, None])

            cut = limit[s : s + 256]
            near = candidates(cut) if np.isfinite(cut).all() else None
            if near is None or len(near) > 4 * k * len(rough):
                # the k that look best are measured; none of the k best is worse than the worst of them
                kk = min(k, rough.shape[1])
                near = np.flatnonzero(rough <= np.partition(rough, kk - 1, axis=1)[:, kk - 1 : kk])
                r, c = np.divmod(near, len(y))
                measured = np.where(np.isfinite(rough[r, c]), exact(s, r, c), np.inf)
                near = candidates(np.minimum(np.maximum.reduceat(measured, np.searchsorted(r, np.arange(len(rough)))), cut))
            if not len(near):
                continue
            r, c = np.divmod(near, len(y))
            rows.append(r + s)
            others.append(ids_r[c])
            found.append(exact(s, r, c))
        if not rows:
            return np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        return np.concatenate(rows), np.concatenate(others), np.concatenate(found)

    def keep(row, other, value, ids, room):
        """The k smallest values per row by (value, lower id, higher id)."""
        a = np.minimum(ids[row], other)
        b = np.maximum(ids[row], other)
        order = np.lexsort((b, a, np.round(value, 12), row))
        row, other, value = row[order], other[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        take = place < room
        return row[take], other[take], value[take]

    def tightened(row, value, limit):
        """Where a row has k partners, the value of the last bounds what can still matter."""
        last = np.full(len(limit), -np.inf)
        np.maximum.at(last, row, value)
        return np.where(np.bincount(row, minlength=len(limit)) >= k, np.minimum(last, limit), limit)

    def reach(block: int, sizes: list) -> np.ndarray:
        """Least possible value from a block's searching points to every block."""
        names, cells, radius, least, pivots = meta.value
        at = int(np.searchsorted(names, block))
        gap = np.sqrt(((pivots[cells] - pivots[cells[at]]) ** 2).sum(1))
        low = np.maximum(gap - radius - radius[at], 0.0)
        if kernel == "ward":
            # the cost grows with both sizes
            smallest, theirs = float(sizes[0].min()), least.astype(float)
            low = smallest * theirs / (smallest + theirs) * low * low
        return low

    def lists(*arrays) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), pa.array(m)) for m in arrays]

    def own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points of a block that search, their best partners inside it, and which other blocks could hold better ones."""
        for batch in batches:
            for row in range(batch.num_rows):
                block, here = batch.column("block")[row].as_py(), unpack(batch, row)
                on = np.asarray(numbers(batch.column(ask), row), dtype=bool) if ask else np.ones(len(here[0]), bool)
                if not on.any():
                    continue
                mine = here[0][on], here[1][on], [e[on] for e in here[2]]
                limit = numbers(batch.column(bound), row)[on] if bound else np.full(len(mine[0]), np.inf)
                r, o, v = keep(*best(mine, here, limit, True), mine[0], k)
                worst = tightened(r, v, limit)
                names = meta.value[0]
                targets = names[(reach(block, mine[2]) <= worst.max() * (1 + 1e-9)) & (names != block)]
                facts = lists(mine[0], *mine[2], targets.astype(np.int64), worst, mine[0][r], o, v)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([mine[1].tobytes()], pa.binary()), *facts], names=local_cols)

    local_cols = ["block", vec, id_col, *extra, "_targets", "_worst", "_ids", "_others", "_values"]
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    given = ", ".join(f"{c} {types[c]}" for c in ("block", vec, id_col, *extra))
    local = packed.mapInArrow(own_block, f"{given}, _targets array<long>, _worst array<double>, _ids array<long>, _others array<long>, _values array<double>")
    local = local if single else written(local)
    inside = local.select(F.explode(F.arrays_zip("_ids", "_others", "_values")).alias("z")).select(
        F.col("z._ids").alias("id"), F.col("z._others").alias("other"), F.col("z._values").alias("value")
    )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best partners in the other blocks of the task; what a block has found bounds the rest of its search."""
        at = mine = None
        none = np.empty(0, int), np.empty(0, np.int64), np.empty(0)

        def merged(held, fresh):
            return keep(*[np.concatenate(m) for m in zip(held, *fresh)], mine[0], k) if fresh else held

        def handed(held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(m) for m in (mine[0][held[0]], held[1], held[2])], names=["id", "other", "value"])

        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                if block != at:
                    if at is not None:
                        yield handed(merged(held, fresh))
                    at, mine, limit = block, unpack(batch, row), numbers(batch.column("_worst"), row)
                    held, fresh, low = none, [], reach(block, mine[2])
                if low[np.searchsorted(meta.value[0], batch.column("r_block")[row].as_py())] > limit.max() * (1 + 1e-9):
                    continue
                more = best(mine, unpack(batch, row, "r_"), limit)
                if len(more[0]):
                    fresh.append(more)
                # sorted once enough has come together to make the bounds tighter
                if sum(len(m[0]) for m in fresh) >= 2 * k * len(limit):
                    held, fresh = merged(held, fresh), []
                    limit = tightened(held[0], held[2], limit)
        if at is not None:
            yield handed(merged(held, fresh))

    if single:
        found = inside
    else:
        left = local.where(F.size("_targets") > 0).select("block", id_col, vec, *extra, "_worst", "_targets")
        right = packed.select(*[F.col(c).alias("r_" + c) for c in ("block", id_col, vec, *extra)])
        pairs = meeting(left, right, F.array_contains("_targets", F.col("r_block"))).drop("_targets")
        found = inside.unionByName(written(pairs.mapInArrow(across, "id bigint, other bigint, value double")))
    low_id, high_id = F.least("id", "other"), F.greatest("id", "other")
    order = Window.partitionBy("id").orderBy(F.round("value", 12), low_id, high_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_graph(df: DataFrame, k: int = 15, metric: str = "euclidean", vec: str = "vec", id_col: str = "listing_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour_id, distance, rank): the exact ``k`` nearest other rows, ties by id.

    Rows with the same vector are searched once and carry their ``k + 1`` lowest
    ids, which is all that copies can contribute to any neighbour list.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    shape = unit(vec) if metric == "cosine" else F.col(vec)
    points = df.select(F.col(id_col).cast("bigint").alias("id"), shape.alias("vec"))
    lowest = Window.partitionBy("vec").orderBy("id")
    # the cut at k + 1 happens before the shuffle, so copies cost nothing
    copies = points.withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= k + 1)
    groups = copies.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = materialise(groups.select(F.col("ids")[0].alias("id"), "vec", "ids"))
    blocks = make_blocks(groups, "id", "vec", block_rows)
    near = block_search(blocks, "knn", k).select(F.col("id").alias("gid"), F.col("other").alias("oid"), "value")
    itself = groups.select(F.col("id").alias("gid"), F.col("id").alias("oid"), F.lit(0.0).alias("value"))
    members = groups.select(F.col("id").alias("oid"), "ids")
    # candidates per distinct vector, cut to the k + 1 that can matter
    cand = near.unionByName(itself).join(members, "oid").select("gid", "value", F.explode("ids").alias("neighbour_id"))
    place = Window.partitionBy("gid").orderBy(F.round("value", 12), "neighbour_id")
    cand = cand.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
    lists = cand.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour_id", "value"))).alias("list"))
    mine = points.join(groups.select(F.col("id").alias("gid"), "vec"), "vec").select("id", "gid")
    others = F.filter("list", lambda e: e["neighbour_id"] != F.col("id"))
    rows = mine.join(lists, "gid").select("id", F.posexplode(F.slice(others, 1, k)).alias("p", "e"))
    value = F.col("e.value") if metric == "euclidean" else F.col("e.value") * F.col("e.value") / 2
    return rows.select("id", F.col("e.neighbour_id").alias("neighbour_id"), value.alias("distance"), (F.col("p") + 1).alias("rank"))
