"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Tree paths over text statistics become conjunctive rules, a lasso logistic fit keeps few of
them, and what it keeps is one Spark expression over the statistics of every whole text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aislemap.llm.common import WordHasher, binary, held_out, labelled, rolling, space_words
from aislemap.llm.trees import boost, sigmoid

# Labelled rows that the fit may see, chosen by a hash of the id.
LABELLED = 20_000
TREES, DEPTH = 40, 3
LASSO = 2e-3
STEPS = 600
THRESHOLD = 0.3

STATISTICS = [
    "words", "chars", "word_length", "longest_word", "upper", "digits", "symbols", "exclamations", "non_ascii", "lines", "line_length",
    "repeated_lines", "distinct_words", "top_word", "echo", "repeated_pairs", "repeated_runs", "symbol_words", "upper_words", "sentences",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in b"#$%&*+<=>@\\^_`{|}~/"]] = True
_PLAIN = bytes(c for c in range(256) if not _MARK[c])
_NOT_UPPER = bytes(c for c in range(256) if not _UPPER[c])


def _repeated(values: np.ndarray) -> float:
    """The share of the values that are further copies of another."""
    return 1 - len(np.unique(values)) / len(values) if len(values) else 0.0


def _repeated_nearby(hashes: np.ndarray, block: int = 64) -> float:
    """The mean share of repeats in blocks of neighbours, which unlike the share in the text does not grow with its length."""
    if len(hashes) <= block:
        return _repeated(hashes)
    whole = hashes[: len(hashes) // block * block].reshape(-1, block)
    blocks = np.sort(np.vstack([whole, hashes[-block:]]), axis=1)
    return float((blocks[:, 1:] == blocks[:, :-1]).sum(axis=1).mean() / block)


def statistics(text: bytes | None, hasher: WordHasher) -> list[float]:
    """The STATISTICS of a whole text; null and empty texts have zeros."""
    words = space_words(text)
    if not words:
        return [0.0, float(len(text or b""))] + [0.0] * (len(STATISTICS) - 2)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    chars = int(size - counts[128:192].sum())
    letters = int(counts[_LETTER].sum() + counts[192:].sum())
    hashes = hasher(text)
    _, times = np.unique(hashes, return_counts=True)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(n), float(chars), float(lengths.mean()), float(lengths.max()),
        float(counts[_UPPER].sum()) / max(letters, 1), float(counts[_DIGIT].sum()) / size, float(counts[_MARK].sum()) / size,
        float(counts[33]) / n, float(counts[128:].sum()) / size, float(len(lines)), chars / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), 1 - _repeated_nearby(hashes), float(times.max()) / n,
        float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0, _repeated_nearby(rolling(hashes, 2)), _repeated(rolling(hashes, 8)),
        sum(1 for w in words if w.translate(None, _PLAIN)) / n, sum(1 for w in words if len(w.translate(None, _NOT_UPPER)) > 1) / n,
        float(counts[46]) / n,
    ]


def _measure(texts: pa.Array) -> pa.Array:
    hasher = WordHasher(lower=False)
    rows = np.array([statistics(t, hasher) for t in binary(texts)]).reshape(len(texts), len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], names=STATISTICS)


def measured(text) -> Column:
    """A struct of the STATISTICS of a text."""
    return F.arrow_udf(_measure, "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">").asNondeterministic()(text)


class Rules:
    """A start value and weighted conjunctions of (statistic, is above, threshold)."""

    def __init__(self, start: float, rules: list[tuple[float, tuple]]):
        self.start, self.rules = start, rules

    def column(self, stats: Column) -> Column:
        """The probability of good quality as an expression over the struct of statistics."""
        total = F.lit(self.start)
        for weight, conditions in self.rules:
            parts = [stats[STATISTICS[f]] > t if above else stats[STATISTICS[f]] <= t for f, above, t in conditions]
            total = total + F.when(reduce(and_, parts), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for weight, conditions in self.rules:
            total += weight * holds(conditions, x)
        return sigmoid(total)


def holds(conditions: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(and_, [x[:, f] > t if above else x[:, f] <= t for f, above, t in conditions])


def _shortened(conditions: tuple) -> tuple:
    """One bound per statistic and side, in order."""
    bounds: dict = {}
    for f, above, t in conditions:
        pick = max if above else min
        bounds[f, above] = pick(bounds.get((f, above), t), t)
    return tuple((f, above, t) for (f, above), t in sorted(bounds.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, steps: int = STEPS) -> Rules:
    """Rules from boosted trees with lasso logistic weights, by accelerated proximal gradient steps."""
    start, grown = boost(x, y, trees, depth, bins=48)
    found = list(dict.fromkeys(_shortened(p) for t in grown for p in t.paths()))
    matrix, kept, seen = [], [], set()
    for rule in found:
        column = holds(rule, x)
        if column.tobytes() not in seen and 0 < column.sum() < len(x):
            seen.add(column.tobytes())
            matrix.append(column)
            kept.append(rule)
    if not kept:
        return Rules(start, [])
    m = np.array(matrix, np.float32).T
    scale = np.maximum(m.std(axis=0), 1e-3)
    m = (m - m.mean(axis=0)) / scale
    weights, ahead, bias, pace = np.zeros(m.shape[1]), np.zeros(m.shape[1]), start, 1.0
    # the largest curvature of the logistic loss, by power steps
    v = np.ones(m.shape[1], np.float32)
    for _ in range(20):
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(m) / (float(np.linalg.norm(m.T @ (m @ v))) + 1e-9)
    for _ in range(steps):
        off = sigmoid(m @ ahead.astype(np.float32) + bias) - y
        moved = ahead - step * (m.T @ off.astype(np.float32)) / len(m)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0)
        bias -= 2.0 * float(off.mean())
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, weights, pace = new + (pace - 1) / following * (new - weights), new, following
    means = np.array([c.mean() for c in matrix])
    weights = weights / scale
    rules = [(float(w), r) for w, r in zip(weights, kept) if abs(w) > 1e-9]
    return Rules(float(bias - (weights * means).sum()), rules)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Rules:
    """Rules fitted on at most ``most`` labelled rows outside the held-out fifth. No labels give the score 0.5."""
    rows = labelled(docs, labels, "quality", most).select("doc_id", "y", measured(F.col("text")).alias("s")).select("doc_id", "y", "s.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS], kind="stable")
    return fit_rules(rows[STATISTICS].to_numpy(float).reshape(len(rows), len(STATISTICS)), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, rules: Rules, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    Null texts are scored as empty ones. No rows give no rows.
    """
    scored = docs.select(F.struct("*").alias("row"), measured(F.col(text)).alias("stats")).withColumn("score", rules.column(F.col("stats")))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return scored.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    return score_quality(docs, fit_quality(docs, labels)).withColumn("held_out", held_out("doc_id"))
