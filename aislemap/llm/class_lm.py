"""A Brown class language model: exchange clustering, class bigrams and word emissions.

The probability of a token is that of its class after the class before, times that of the
token in its class. The commonest words are units of their own; every other word, seen or
not, belongs to the unit of its last three bytes, so all words have a class without a
table of all words in every task. Exchange clustering moves units between classes: per
round one pass counts the classes beside every unit, and each unit takes the class that
raises the likelihood of the class bigrams most. A share of the units, another one each
time, moves per round, and the best assignment of all rounds stays.

A class gives its words (n - D) / N and its unseen words together D * types / N, so the
probabilities of all words and the one unseen word of each class add up to one. D comes
from the words seen once and twice.

Null text is empty, and has only its end token. A null ``doc_id`` counts as the empty id,
which is held out. Rows that repeat an id are scored one by one. Without training rows
every token is unseen.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from aislemap.llm.common import batches, binary, mix
from aislemap.session import materialise

CLASSES, ROUNDS = 64, 10
# Words that are exchanged one by one; endings that gather all other words.
UNITS, ENDINGS = 1 << 14, 1 << 12
# Commonest words whose counts travel with the tasks; the counts of others are joined.
KNOWN = 1 << 17
# The weight of the class frequencies in the class bigrams.
SHARE = 1.0
# Words of one task that are counted before they are passed on; tokens of one row of units.
HELD, RUN = 500_000, 1 << 20
# Units of one row of counts, and rows that one task adds up.
BLOCK, FAN_IN = 256, 32

_LOW = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
# The end token; words are never empty.
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_LOW).split() if text else []


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) & (ENDINGS - 1)


def learns(doc_id: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, mod 10, is not 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 != 0


_WORDS = pa.schema([("word", pa.binary()), ("ending", pa.int32()), ("n", pa.int64())])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, n) of all tokens; the end token is the empty word."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in parts:
            for text in binary(part.column("text")):
                held.update(tokens(text))
                held[END] += 1
                if len(held) > HELD:
                    yield from batches(((w, ending(w), n) for w, n in held.items()), _WORDS)
                    held.clear()
        yield from batches(((w, ending(w), n) for w, n in held.items()), _WORDS)

    found = texts.select("text").mapInArrow(count, "word binary, ending int, n long")
    return materialise(found.groupBy("word", "ending").agg(F.sum("n").alias("n")))


class Units:
    """Numbers of the units: the commonest words, then the endings, then the end token."""

    def __init__(self, words: list[bytes]):
        self.of = {w: i for i, w in enumerate(words)}
        self.words = len(words)
        self.end = self.words + ENDINGS
        self.count = self.end + 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get, rest = self.of.get, self.words
        return np.fromiter((u if (u := get(w)) is not None else rest + ending(w) for w in words), np.int32, len(words))


def unit_rows(texts: DataFrame, units: Units) -> DataFrame:
    """(units): the training texts as runs of unit numbers, every text between two end tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        end = np.array([units.end], np.int32)
        held, size = [end], 1

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<u2").tobytes()], pa.binary())], names=["units"])

        for part in parts:
            for text in binary(part.column("text")):
                held += [units.numbers(tokens(text)), end]
                size += len(held[-2]) + 1
                if size >= RUN:
                    yield out()
                    held, size = [end], 1
        if size > 1:
            yield out()

    rows = materialise(texts.select("text").mapInArrow(number, "units binary"))
    shared.destroy()
    return rows


_COUNTS = pa.schema([("block", pa.int32()), ("task", pa.int64()), ("counts", pa.binary())])


def neighbour_counts(rows: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """(block, counts): per unit how often each class stands before it and after it, and how often it follows itself.

    A row holds ``BLOCK`` units. The rows of the tasks are added up ``FAN_IN`` at a time.
    """
    shared = rows.sparkSession.sparkContext.broadcast(classes)
    n_units, width = len(classes), 2 * k + 1

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = shared.value, None
        for part in parts:
            for row in binary(part.column("units")):
                u = np.frombuffer(row, "<u2").astype(np.int64)
                c = classes[u]
                if total is None:
                    total = [np.zeros(n_units * k, np.int64), np.zeros(n_units * k, np.int64), np.zeros(n_units, np.int64)]
                total[0] += np.bincount(u[1:] * k + c[:-1], minlength=n_units * k)
                total[1] += np.bincount(u[:-1] * k + c[1:], minlength=n_units * k)
                total[2] += np.bincount(u[1:][u[1:] == u[:-1]], minlength=n_units)
        if total is not None:
            full = np.concatenate([total[0].reshape(-1, k), total[1].reshape(-1, k), total[2][:, None]], axis=1)
            task = TaskContext.get().partitionId()
            blocks = range(0, n_units, BLOCK)
            yield from batches(((b // BLOCK, task, _packed(full[b : b + BLOCK])) for b in blocks), _COUNTS, 16)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(row.as_py()), np.int64) for row in table.column("counts"))
        first = [table.column(c)[0].as_py() for c in ("block", "task")]
        return pa.table([pa.array([first[0]], pa.int32()), pa.array([first[1]], pa.int64()), pa.array([_packed(total)], pa.binary())], _COUNTS)

    schema, tasks = "block int, task long, counts binary", rows.rdd.getNumPartitions()
    found = rows.mapInArrow(count, schema)
    while True:
        found = found.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("block", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = materialise(found.select("block", "counts"))
    shared.destroy()
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Most counts are small or zero."""
    return zlib.compress(counts.tobytes(), 1)


def _unpack(counts: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(counts), np.int64).reshape(-1, 2 * k + 1)
    return x[:, :k].astype(float), x[:, k : 2 * k].astype(float), x[:, 2 * k].astype(float)


def class_bigrams(blocks: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often each class follows each class: a matrix of fixed size from every block of units."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, counts in zip(part.column("block").to_pylist(), binary(part.column("counts"))):
                _, after, _ = _unpack(counts, k)
                total = np.zeros((k, k))
                np.add.at(total, classes[block * BLOCK : block * BLOCK + len(after)], after)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    rows = blocks.mapInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r["m"]).reshape(k, k) for r in rows), np.zeros((k, k)))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def likelihood(m: np.ndarray) -> float:
    """The part of the log likelihood of the class bigrams that depends on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def best_classes(before: np.ndarray, after: np.ndarray, self_: np.ndarray, own: np.ndarray, m: np.ndarray, free: int, which: np.ndarray) -> np.ndarray:
    """The class, of the first ``free``, in which each unit of ``which`` makes the likelihood largest while all others stay."""
    k = len(m)
    out, rows, cols = own.copy(), m.sum(1), m.sum(0)
    for u in np.flatnonzero(which).tolist():
        follows, leads = after[u].sum(), before[u].sum()
        if not follows and not leads:
            continue
        a, s = own[u], self_[u]
        # a unit's own class counts itself; without it
        right, left = after[u].copy(), before[u].copy()
        right[a] -= s
        left[a] -= s
        rest = m.copy()
        rest[a] -= right
        rest[:, a] -= left
        rest[a, a] -= s
        rows[a] -= follows
        cols[a] -= leads
        gain = (_xlogx(rest + right) - _xlogx(rest)).sum(1) + (_xlogx(rest + left[:, None]) - _xlogx(rest)).sum(0)
        d = np.arange(k)
        corner = rest[d, d]
        gain += _xlogx(corner + right + left + s) - _xlogx(corner) - (_xlogx(corner + right) - _xlogx(corner)) - (_xlogx(corner + left) - _xlogx(corner))
        gain -= _xlogx(rows + follows) - _xlogx(rows) + _xlogx(cols + leads) - _xlogx(cols)
        rows[a] += follows
        cols[a] += leads
        best = int(gain[:free].argmax())
        out[u] = best if gain[best] > gain[a] + 1e-9 else a
    return out


def chosen(units: np.ndarray, step: int, share: float) -> np.ndarray:
    """A share of the units, another one in each step."""
    return (mix(units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)) >> np.uint64(11)) < share * 2**53


def exchange(rows: DataFrame, units: Units, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigrams); the end token is the last of ``k`` classes alone.

    Units that follow each other into a class overshoot. If a round makes the likelihood
    smaller, the next one starts again from the best classes and moves half as many units.
    """
    end, share = units.end, 0.5
    classes = np.arange(units.count) % (k - 1)
    classes[end] = k - 1
    best = None
    for step in range(rounds + 1):
        blocks = neighbour_counts(rows, classes, k)
        m = class_bigrams(blocks, classes, k)
        value = likelihood(m)
        if best is None or value > best[0]:
            best = (value, classes, m, blocks)
        else:
            share /= 2
        if step == rounds:
            break
        classes = _moved(*best[1:], end, step, share)
    return best[1], best[2]


def _moved(classes: np.ndarray, m: np.ndarray, blocks: DataFrame, end: int, step: int, share: float) -> np.ndarray:
    """The classes after a share of the units has moved; a row of fixed size from every block of units."""
    k = len(m)

    def move(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, counts in zip(part.column("block").to_pylist(), binary(part.column("counts"))):
                before, after, self_ = _unpack(counts, k)
                at = np.arange(block * BLOCK, block * BLOCK + len(self_))
                moved = best_classes(before, after, self_, classes[at], m, k - 1, chosen(at, step, share) & (at != end))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([moved.tobytes()], pa.binary())], names=["block", "classes"])

    out = classes.copy()
    for r in blocks.mapInArrow(move, "block int, classes binary").collect():
        new = np.frombuffer(r["classes"], np.int64)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(new)] = new
    return out


class Model:
    """What scoring needs besides the counts of rarer words; its size does not grow with the corpus."""

    def __init__(self, vocabulary: DataFrame, units: Units, known: list[tuple[bytes, int]], classes: np.ndarray, bigrams: np.ndarray):
        k = len(bigrams)
        facts = vocabulary.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
        self.n, self.types = facts[0] or 0, facts[1]
        self.discount = facts[2] / (facts[2] + 2 * facts[3]) if facts[2] and facts[3] else 0.5
        self.units, self.classes, self.end = units, classes, k - 1
        # words and places per class: units that are words, and endings of all others
        self.class_n, self.class_types = np.zeros(k), np.zeros(k)
        by_ending = vocabulary.where(F.col("word") != F.lit(END)).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
        per = np.zeros((ENDINGS, 2))
        for r in by_ending:
            per[r["ending"]] = r["n"], r["types"]
        for word, n in known[: units.words]:
            per[ending(word)] -= n, 1
            self.class_n[classes[units.of[word]]] += n
            self.class_types[classes[units.of[word]]] += 1
        np.add.at(self.class_n, classes[units.words : units.end], per[:, 0])
        np.add.at(self.class_types, classes[units.words : units.end], per[:, 1])
        share = (self.class_n + 1) / (self.class_n.sum() + k)
        self.step = np.log10((bigrams + SHARE * share[None, :]) / (bigrams.sum(1, keepdims=True) + SHARE))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unseen = np.where(self.class_n > 0, np.log10(self.discount * self.class_types / self.class_n), 0.0)
            self.scale = np.where(self.class_n > 0, np.log10(self.class_n), 0.0)
        self.known = {w: i for i, (w, _) in enumerate(known)}
        self.known_n = np.array([n for _, n in known], float)
        self.known_unit = units.numbers([w for w, _ in known])
        self.base_scale = np.log10(self.n + 0.1 * (self.types + 1))
        self.end_n = 0

    def seen(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log10(n - self.discount) - self.scale[of]


_SCORED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()),
     ("rare", pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int32()), ("class", pa.int32())])))]
)


def commonest(vocabulary: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``KNOWN`` words with their counts, the commonest first, and none without all others of its count.

    Counts are put in steps of a 32nd power of two, of which there are some 1,400 at most.
    """
    words = vocabulary.where(F.col("word") != F.lit(END)).select("word", "n", F.floor(32 * F.log2(F.col("n"))).alias("step"))
    total, least = 0, None
    for r in words.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > KNOWN:
            break
        least = r["step"]
    if least is None:
        return []
    found = words.where(F.col("step") >= least).select("word", "n").collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def fit_class_lm(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model learnt from the rows that ``learns`` tells, and the counts of all their words."""
    texts = docs.where(learns()).select("text")
    vocabulary = count_words(texts)
    known = commonest(vocabulary)
    units = Units([w for w, _ in known[:UNITS]])
    labels, bigrams = exchange(unit_rows(texts, units), units, classes + 1, rounds)
    model = Model(vocabulary, units, known, labels, bigrams)
    end = vocabulary.where(F.col("word") == F.lit(END)).select("n").first()
    model.end_n = end["n"] if end else 0
    return model, vocabulary


def score_class_lm(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rarer words leave the task once per document and word, meet their count by a join and
    come back as sums; the commonest, which would be hot keys, do not.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        task, at = TaskContext.get().partitionId() << 36, 0
        get, end, k = model.known.get, model.units.end, model.end
        base_known = np.log10(model.known_n + 0.1) - model.base_scale
        own_known = model.seen(model.known_n, model.classes[model.known_unit])
        base_end = np.log10(model.end_n + 0.1) - model.base_scale

        def rows() -> Iterator[tuple]:
            nonlocal at
            for part in parts:
                for doc_id, out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), binary(part.column("text"))):
                    words = tokens(text)
                    number = np.fromiter((-1 if (i := get(w)) is None else i for w in words), np.int64, len(words))
                    common = number >= 0
                    path = np.empty(len(words) + 2, np.int64)
                    path[0] = path[-1] = k
                    unit = np.zeros(len(words), np.int64)
                    unit[common] = model.known_unit[number[common]]
                    rare = Counter(words[i] for i in np.flatnonzero(~common).tolist())
                    # a word that is not among the commonest is never a unit of its own
                    of = {w: int(model.classes[model.units.words + ending(w)]) for w in rare}
                    path[1:-1] = model.classes[unit]
                    for i in np.flatnonzero(~common).tolist():
                        path[i + 1] = of[words[i]]
                    seen = number[common]
                    base = float(base_known[seen].sum() + base_end)
                    own = float(model.step[path[:-1], path[1:]].sum() + own_known[seen].sum())
                    known = len(seen) + (model.end_n > 0)
                    yield task + at, doc_id, out, len(words) + 1, known, base, own, [{"word": w, "m": m, "class": of[w]} for w, m in rare.items()]
                    at += 1

        yield from batches(rows(), _SCORED, 2048)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learns()).alias("held_out"), "text")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<struct<word:binary,m:int,class:int>>"
    scored = materialise(rows.mapInArrow(score, schema))
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m", "r.class")
    rare = rare.join(vocabulary.select("word", "n"), "word", "left")

    def per_class(values: np.ndarray) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("class"))

    base = F.log10(F.coalesce("n", F.lit(0)) + 0.1) - float(model.base_scale)
    own = F.when(F.col("n").isNull(), per_class(model.unseen)).otherwise(F.log10(F.col("n") - float(model.discount)) - per_class(model.scale))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("m") * base).alias("rare_base"), F.sum(F.col("m") * own).alias("rare_own"), F.sum(F.when(F.col("n").isNotNull(), F.col("m"))).alias("rare_known")
    )
    full = scored.drop("rare").join(sums, "row", "left")
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("own") + F.coalesce("rare_own", F.lit(0.0))).alias("score"),
    )


def class_lm(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """All rows scored by a model learnt from nine tenths of them."""
    docs = docs.select("doc_id", "text")
    return score_class_lm(docs, *fit_class_lm(docs, classes, rounds))
