"""Agreement of two labelings, from their contingency counts only.

The rows are read once to count label pairs; every index then needs just the
pair counts and the two sets of marginal counts. ``by`` scores several labelings
(for example one per method) in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from aislemap.functions.maths import log_factorial, log_gamma
from aislemap.session import materialise

_ALL = "_all"
_EPS = 2.220446049250313e-16


def contingency(df: DataFrame, u: str, v: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., u, v, n) for the true label ``u`` and the predicted label ``v``."""
    return df.groupBy(*by, F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").cast("double").alias("n"))


def _keys(cells: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key stands in when there is nothing to group by; the joined sides then have one row."""
    return (cells, list(by)) if by else (cells.withColumn(_ALL, F.lit(0)), [_ALL])


def _sums(counts: DataFrame, keys: list[str], tag: str) -> DataFrame:
    n = F.col("n")
    return counts.groupBy(*keys).agg(
        F.sum("n").alias(f"total_{tag}"),
        F.count("*").alias(f"k_{tag}"),
        F.sum(n * (n - 1) / 2).alias(f"pairs_{tag}"),
        F.sum(n * F.log(n)).alias(f"nlogn_{tag}"),
    )


def expected_mutual_info(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information expected by chance with the marginals held fixed.

    Equal marginals are grouped first. By Bernstein's bound the hypergeometric
    weight further than 14 standard deviations and 70 from its mean is below 1e-39,
    far under the last digit of the sum, so only that stretch of overlaps is added.
    """
    cells, keys = _keys(cells, by)

    def marginal(col: str, out: str) -> DataFrame:
        sizes = cells.groupBy(*keys, col).agg(F.sum("n").alias(out))
        return sizes.groupBy(*keys, out).agg(F.count("*").cast("double").alias(f"m_{out}"))

    total = cells.groupBy(*keys).agg(F.sum("n").alias("t"))
    pairs = marginal("u", "a").join(marginal("v", "b"), keys).join(total, keys)
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    mean = a * b / t
    reach = 14 * F.sqrt(mean * (1 - F.greatest(a, b) / t)) + 70
    first = F.greatest(F.lit(1.0), a + b - t, F.floor(mean - reach)).cast("bigint")
    last = F.least(a, b, F.ceil(mean + reach)).cast("bigint")
    fixed = (
        log_factorial(a) + log_factorial(b) + log_factorial(t - a) + log_factorial(t - b) - log_factorial(t)
    )
    # a few pairs unfold into many terms: spread them by a fixed number of partitions
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("fixed", fixed).repartition(parts, "a", "b").withColumn("nij", F.explode(F.when(first <= last, F.sequence(first, last))))
    n = F.col("nij").cast("double")
    log_weight = (
        F.col("fixed") - log_factorial(n) - log_factorial(a - n) - log_factorial(b - n) - log_gamma(t - a - b + n + 1)
    )
    term = n / t * F.log(t * n / (a * b)) * F.exp(log_weight)
    out = pairs.groupBy(*keys).agg(F.sum(F.col("m_a") * F.col("m_b") * term).alias("emi"))
    return out if by else out.drop(_ALL)


def partition_scores(cells: DataFrame, by: Sequence[str] = (), adjusted: bool = True) -> DataFrame:
    """ARI, NMI, homogeneity, completeness, V-measure, purity parts and, if asked, AMI."""
    # the pair counts are small next to the rows and feed six aggregations
    keyed, keys = _keys(materialise(cells), by)
    rows = keyed.groupBy(*keys, "u").agg(F.sum("n").alias("n"))
    cols = keyed.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    s = _sums(keyed, keys, "uv").join(_sums(rows, keys, "u"), keys).join(_sums(cols, keys, "v"), keys)
    t = F.col("total_uv")
    h_u = F.greatest(F.log(t) - F.col("nlogn_u") / t, F.lit(0.0))
    h_v = F.greatest(F.log(t) - F.col("nlogn_v") / t, F.lit(0.0))
    h_uv = F.log(t) - F.col("nlogn_uv") / t
    s = s.withColumns({"n": t, "h_u": h_u, "h_v": h_v})
    mi = F.col("h_u") + F.col("h_v") - h_uv
    s = s.withColumn("mi", F.when(mi < 1e-12, 0.0).otherwise(mi))
    trivial = (F.col("k_u") == 1) & (F.col("k_v") == 1)
    mean_h = (F.col("h_u") + F.col("h_v")) / 2
    chance = F.col("pairs_u") * F.col("pairs_v") / (t * (t - 1) / 2)
    best = (F.col("pairs_u") + F.col("pairs_v")) / 2
    s = s.withColumns(
        {
            "ari": F.when(best == chance, 1.0).otherwise((F.col("pairs_uv") - chance) / (best - chance)),
            "nmi": F.when(trivial, 1.0).when(F.col("mi") == 0, 0.0).otherwise(F.col("mi") / mean_h),
            "homogeneity": F.when(F.col("h_u") == 0, 1.0).otherwise(F.col("mi") / F.col("h_u")),
            "completeness": F.when(F.col("h_v") == 0, 1.0).otherwise(F.col("mi") / F.col("h_v")),
        }
    )
    h, c = F.col("homogeneity"), F.col("completeness")
    s = s.withColumn("v_measure", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)))
    if adjusted:
        emi = expected_mutual_info(keyed, keys)
        spare = (F.col("h_u") + F.col("h_v")) / 2 - F.col("emi")
        spare = F.when(spare < 0, F.least(spare, F.lit(-_EPS))).otherwise(F.greatest(spare, F.lit(_EPS)))
        s = s.join(emi, keys).withColumn("ami", F.when(trivial, 1.0).otherwise((F.col("mi") - F.col("emi")) / spare))
    return s if by else s.drop(_ALL)


def purity(cells: DataFrame, by: Sequence[str] = (), noise: int | None = -1) -> DataFrame:
    """Rows in the majority class of their cluster over all rows; noise never counts as right."""
    majority = cells.groupBy(*by, "v").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    counted = F.col("top") if noise is None else F.when(F.col("v") == noise, 0.0).otherwise(F.col("top"))
    return majority.groupBy(*by).agg((F.sum(counted) / F.sum("n")).alias("purity"))


def division_recovery(df: DataFrame, truth: str = "division", cluster: str = "cluster", max_noise: float = 0.5) -> DataFrame:
    """How well clusters recover a known division; a warning instead when most rows are noise."""
    cells, keys = _keys(materialise(contingency(df, truth, cluster)), ())
    noise = cells.groupBy(*keys).agg(
        (F.sum(F.when(F.col("v") == -1, F.col("n")).otherwise(0.0)) / F.sum("n")).alias("noise_share")
    )
    scores = partition_scores(cells, keys, adjusted=False).join(purity(cells, keys), keys).join(noise, keys)
    bad = F.col("noise_share") > max_noise
    named = {
        "adjusted_rand_index": "ari", "normalized_mutual_info": "nmi", "homogeneity": "homogeneity",
        "completeness": "completeness", "v_measure": "v_measure", "purity": "purity",
    }
    return scores.select(
        *[F.when(~bad, F.col(src)).alias(out) for out, src in named.items()],
        F.when(bad, "not scored: most rows are noise").alias("warning"),
    )
