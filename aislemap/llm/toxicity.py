"""Toxicity: a factorisation machine over hashed terms.

Besides a weight, each term has a short vector; the product of two vectors is what the pair
adds to the score, so that an insult beside the mention of a group may count for more than
the two alone. Terms are chosen by their own effect, or by that of a product with another
frequent term on what the others leave unexplained. Fitted on a bounded sample of labelled rows, applied to every whole text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aislemap.llm.common import binary, held_out, labelled, lower_words
from aislemap.llm.trees import sigmoid

# Labelled rows that the fit may see, chosen by a hash of the id.
LABELLED = 20_000
SLOTS = 1 << 20
# Terms are words and their first bytes, so that forms of a word count together.
BEGINNINGS = (4, 5, 6)
# Terms enter when their counts in toxic and other rows differ by this chi-square, the strongest first.
CHI_SQUARE, TERMS = 8.0, 4096
# Pairs of the most frequent terms are asked whether they explain what the machine so far does not:
# their terms enter too where the score test reaches this many standard deviations.
FREQUENT, LEAST_ROWS, DEVIATIONS = 2048, 10, 6.0
# Rows whose terms the driver holds side by side.
BLOCK = 1024
FACTORS, ROUNDS, RATE, RIDGE = 4, 60, 0.2, 1e-3


class TermSlots(dict):
    """Hash slots of a word and of its beginnings, remembered up to a number of words."""

    limit = 1 << 19

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        terms = [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]
        value = self[word] = tuple(xxhash.xxh64_intdigest(t, 1) % SLOTS for t in terms)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """The sorted slots of the terms of a text."""
        return np.unique(np.fromiter(chain.from_iterable(self[w] for w in set(lower_words(text))), np.int64))


def _slots(texts: pa.Array) -> pa.Array:
    known = TermSlots()
    return pa.array([known.of(t) for t in binary(texts)], pa.list_(pa.int32()))


class Machine:
    """A start value, the weight and the vector of each known term (a hash slot)."""

    def __init__(self, start: float, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.start, self.terms, self.weights, self.vectors = start, terms, weights, vectors
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    def score(self, known: np.ndarray) -> float:
        """The score of the numbers of the known terms of a text."""
        v = self.vectors[known]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.start + float(self.weights[known].sum()) + pairs


def _rows_of(slots: list[np.ndarray]) -> np.ndarray:
    """Rows that hold each slot, added up ``BLOCK`` rows at a time."""
    out = np.zeros(SLOTS)
    for at in range(0, len(slots), BLOCK):
        out += np.bincount(np.concatenate(slots[at : at + BLOCK]), minlength=SLOTS)
    return out


def _screened(slots: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Slots whose document counts differ between the labels."""
    n1, n = y.sum(), len(y)
    here = _rows_of([s for s, t in zip(slots, y) if t])
    both = _rows_of(slots)
    other = both - here
    cross = (here * (n - n1 - other) - other * (n1 - here)) ** 2
    chi = n * cross / np.maximum(both * (n - both) * n1 * (n - n1), 1)
    order = np.lexsort((np.arange(SLOTS), -chi))[:TERMS]
    return np.sort(order[chi[order] >= CHI_SQUARE])


def _paired(slots: list[np.ndarray], y: np.ndarray, machine: Machine) -> np.ndarray:
    """Slots of frequent terms whose products with another term explain the errors of ``machine``."""
    rows_of = _rows_of(slots)
    order = np.lexsort((np.arange(SLOTS), -rows_of))[:FREQUENT]
    names = np.sort(order[rows_of[order] >= LEAST_ROWS])
    errors, spread = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
    for at in range(0, len(slots), BLOCK):
        part = slots[at : at + BLOCK]
        held = np.zeros((len(part), len(names)), np.float32)
        for row, s in zip(held, part):
            row[np.flatnonzero(np.isin(names, s, assume_unique=True))] = 1
        p = sigmoid(np.array([machine.score(k[k >= 0]) for k in (machine.place[s] for s in part)], float))
        errors += held.T @ (held * (y[at : at + BLOCK] - p).astype(np.float32)[:, None])
        spread += held.T @ (held * (p * (1 - p)).astype(np.float32)[:, None])
    found = np.abs(errors) >= DEVIATIONS * np.sqrt(np.maximum(spread, 1))
    np.fill_diagonal(found, False)
    return names[found.any(axis=1)]


def fit_machine(slots: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, batch: int = 256, seed: int = 1) -> Machine:
    """A machine of the terms that matter by themselves and of those that matter only beside another.

    One label alone leaves a constant.
    """
    nothing = np.empty(0, np.int64)
    if len(np.unique(y)) < 2:
        return _descend(slots, y, nothing, rounds, batch, seed)
    alone = _screened(slots, y)
    machine = _descend(slots, y, alone, rounds, batch, seed)
    terms = np.union1d(alone, _paired(slots, y, machine))
    return machine if len(terms) == len(alone) else _descend(slots, y, terms, rounds, batch, seed)


def _descend(slots: list[np.ndarray], y: np.ndarray, terms: np.ndarray, rounds: int, batch: int, seed: int) -> Machine:
    """Adaptive gradient steps on the logistic loss with a ridge, over the slots ``terms``."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(terms):
        return Machine(start, terms, np.empty(0), np.empty((0, FACTORS)))
    rng = np.random.default_rng(seed)
    machine = Machine(start, terms, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), FACTORS)))
    known = [p[p >= 0] for p in (machine.place[s] for s in slots)]
    w, v = machine.weights, machine.vectors
    past_w, past_v, past_b = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), 1e-6
    order = np.arange(len(y))
    for _ in range(rounds):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            flat = np.concatenate([known[r] for r in rows]) if len(rows) else np.empty(0, np.int64)
            of = np.repeat(np.arange(len(rows)), [len(known[r]) for r in rows])
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, of, v[flat])
            squares = np.bincount(of, (v[flat] ** 2).sum(axis=1), len(rows))
            score = machine.start + np.bincount(of, w[flat], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            off = sigmoid(score) - y[rows]
            gw = np.bincount(flat, off[of], len(w)) / len(rows) + RIDGE * w / len(w)
            gv = np.zeros_like(v)
            np.add.at(gv, flat, off[of, None] * (sums[of] - v[flat]))
            gv = gv / len(rows) + RIDGE * v
            gb = float(off.mean())
            past_w += gw**2
            past_v += gv**2
            past_b += gb**2
            w -= RATE * gw / np.sqrt(past_w)
            v -= 0.1 * RATE * gv / np.sqrt(past_v)
            machine.start -= RATE * gb / np.sqrt(past_b)
    return machine


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Machine:
    """A machine fitted on at most ``most`` labelled rows outside the held-out fifth. No labels give the score 0.5."""
    rows = labelled(docs, labels, "toxic", most).select("doc_id", "y", F.arrow_udf(_slots, "array<int>")("text").alias("slots")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    if not len(rows):
        return fit_machine([], np.empty(0))
    # views of one array: as Python numbers they would fill the driver
    lists = rows["slots"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return fit_machine(np.split(lists.flatten().to_numpy(), ends[:-1]), rows["y"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    Null texts are scored as empty ones, which have no terms. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(texts: pa.Array) -> pa.Array:
        machine, slots, out = shared.value, TermSlots(), []
        for raw in binary(texts):
            found = machine.place[slots.of(raw)]
            out.append(machine.score(found[found >= 0]))
        return pa.array(sigmoid(np.array(out, float)), pa.float64())

    scored = docs.select(F.struct("*").alias("row")).withColumn("score", F.arrow_udf(score, "double").asNondeterministic()(F.col(f"row.`{text}`")))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return scored.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    return score_toxicity(docs, fit_toxicity(docs, labels)).withColumn("held_out", held_out("doc_id"))
