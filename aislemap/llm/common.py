"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aislemap.session import small_side

# The ASCII characters that separate words, in Spark and in bytes.
WORD_SEPARATORS = "".join(chr(i) for i in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SPACES = " \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(
    (string.ascii_uppercase + WORD_SEPARATORS).encode(), (string.ascii_lowercase + " " * len(WORD_SEPARATORS)).encode()
)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def term_words(c) -> Column:
    """Words of letters and digits with A-Z lower-cased; null text has none."""
    spaced = F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase + WORD_SEPARATORS, string.ascii_lowercase + " " * len(WORD_SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """The words of ``term_words`` as UTF-8."""
    return text.translate(_LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 16
_SPACED = bytes.maketrans(SPACES.encode(), b" " * len(SPACES))


class WordHasher:
    """64-bit hashes of all words of a text from one running sum over its bytes.

    ``lower`` hashes the words of ``lower_words``, otherwise those of ``space_words``. A
    hash depends on the bytes of the word alone, wherever it stands.
    """

    def __init__(self, lower: bool):
        self.table = _LOWER if lower else _SPACED
        self._grow(_PIECE)

    def _grow(self, size: int) -> None:
        one = np.ones(1, np.uint64)
        self.powers = np.concatenate([one, np.cumprod(np.full(size, _BASE, np.uint64))])
        self.inverse = np.concatenate([one, np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])

    def __call__(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        text, parts, at = text.translate(self.table), [], 0
        while len(text) - at > _PIECE:
            cut = text.rfind(b" ", at, at + _PIECE)
            cut = text.find(b" ", at + _PIECE) if cut < 0 else cut
            if cut < 0:
                break
            parts.append(self._piece(text[at:cut]))
            at = cut + 1
        parts.append(self._piece(text[at:]))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _piece(self, text: bytes) -> np.ndarray:
        if len(text) >= len(self.powers):
            self._grow(2 * len(text))
        raw = np.frombuffer(text, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        np.not_equal(raw, 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * self.powers[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """A hash of every run of ``n`` neighbouring words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(base) + hashes[i : i + len(out)]
    return mix(out)


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of up to ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def held_out(doc_id) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text, mod 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows outside the held-out fifth, chosen by a hash of the id.

    An id that several documents have gives one row, with the lowest of their texts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(F.lit("labels"), "doc_id"), "doc_id").limit(most)
    # bounded by ``most``
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return joined.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.max("y").alias("y"))


def number_hash(*columns) -> Column:
    """A hash between 0 and 2**62 - 1."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def cell_bits(rows: int) -> int:
    """Cells per key grow with the root of the rows, and so do the rows in a cell."""
    return max(0, math.ceil(math.log2(max(1.0, math.sqrt(rows) / 4))))


def seeded_rank(df: DataFrame, keys: list[str], order: str, ties: list, rows: int, per_key: DataFrame | None = None) -> DataFrame:
    """Adds ``rank`` (from 0, in the order of a ``number_hash`` column), ``of`` (rows of the key) and the columns of ``per_key``.

    No key is gathered in one task: rows are ranked in cells of neighbouring hashes, and
    the counts of the cells before give the rest. Ties are broken by the columns given.
    """
    bits = cell_bits(rows)
    named = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    here = [f"key{i}" for i in range(len(keys))]
    packed = df.select(F.struct("*").alias("row"), *named, F.shiftright(F.col(order), 62 - bits).alias("cell"))
    counts = packed.groupBy(*here, "cell").count()
    key = Window.partitionBy(*here)
    counts = counts.select(
        *[F.col(k).alias(f"c{k}") for k in here],
        F.col("cell").alias("ccell"),
        F.coalesce(F.sum("count").over(key.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(key).alias("of"),
    )
    more = [c for c in per_key.columns if c not in keys] if per_key is not None else []
    if per_key is not None:
        # the counts are joined first, so that the rows need one exchange only
        given = per_key.select(*[F.col(k).alias(f"g{h}") for k, h in zip(keys, here)], *more)
        counts = counts.join(given, reduce(and_, [F.col(f"c{k}").eqNullSafe(F.col(f"g{k}")) for k in here])).drop(*[f"g{k}" for k in here])
    # a row per key and cell, so that the rows are exchanged once, for the ranks
    counts = small_side(counts, len(counts.columns))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in here], F.col("cell") == F.col("ccell"))
    inside = Window.partitionBy(*here, "cell").orderBy(F.col(f"row.{order}"), *[F.col(f"row.{t}") for t in ties])
    ranked = packed.withColumn("place", F.row_number().over(inside)).join(counts, same)
    return ranked.select("row.*", (F.col("before") + F.col("place") - 1).alias("rank"), "of", *more)


def whole_row_hash(df: DataFrame) -> Column:
    """Tells rows apart that share an id; maps and variants, which cannot be hashed, stay out."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")
