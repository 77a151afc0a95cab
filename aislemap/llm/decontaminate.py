"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every run of ten words of every item (short items whole), fenced by
spaces, and reads each normalised text once. Hits are mapped back to the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislemap.llm.common import binary, lower_words
from aislemap.session import materialise

WINDOW = 10
# An automaton holds the items of one block; more items make more blocks, read one after the other.
BLOCK_CHARS = 16 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_RESULT = "n_words:long,n_hit:long,items:array<string>,words:array<struct<first:int,last:int>>,chars:array<struct<first:int,last:int>>"
_NAMES = ["n_words", "n_hit", "items", "words", "chars"]


def patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[bytes, list[int]]:
    """Fenced word runs and the numbers of the items that hold them."""
    found: dict[bytes, list[int]] = {}
    for number, (_, text) in enumerate(items):
        words = lower_words(text)
        size = min(window, len(words))
        runs = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else ()
        for run in runs:
            found.setdefault(b" " + run + b" ", []).append(number)
    return found


class Scanner:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.automaton = ahocorasick.Automaton()
        for run, numbers in patterns(items, window).items():
            self.automaton.add_word(run.decode("latin-1"), (len(run), run.count(b" ") - 1, numbers))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words (first, last) and the ids of the items."""
        if not words or not len(self.automaton):
            return [], set()
        ends, numbers = [], set()
        for end, (length, size, of) in self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            ends.append((end - length + 1, size))
            numbers.update(of)
        if not ends:
            return [], set()
        # the fence before word i stands at starts[i]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        firsts = np.searchsorted(starts, [s for s, _ in ends]).tolist()
        return merge([(f, f + size - 1) for f, (_, size) in zip(firsts, ends)]), {self.ids[n] for n in numbers}


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, last) that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def original_chars(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point ranges (first, last) of word runs in the original text."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    point = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    return [{"first": int(point[places[a][0]]), "last": int(point[places[b][1] - 1])} for a, b in runs]


# the automaton that this Python worker built last, by broadcast
_BUILT: dict[tuple, Scanner] = {}


def _scan(shared, key: str, window: int):
    schema = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("words", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("chars", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ])

    def scan(texts: pa.Array, before: pa.Array, items: pa.Array) -> pa.Array:
        if (key, window) not in _BUILT:
            _BUILT.clear()
            _BUILT[key, window] = Scanner(shared.value, window)
        scanner = _BUILT[key, window]
        rows = []
        for raw, runs, ids in zip(binary(texts), before.to_pylist(), items.to_pylist()):
            words = lower_words(raw)
            new, names = scanner.hits(words)
            if runs:
                new, names = merge(new + [(r["first"], r["last"]) for r in runs]), names | set(ids)
            rows.append({
                "n_words": len(words), "n_hit": sum(b - a + 1 for a, b in new), "items": sorted(names),
                "words": [{"first": a, "last": b} for a, b in new], "chars": original_chars(raw, new) if new else [],
            })
        return pa.array(rows, schema)

    # otherwise a filter on the result would scan every text twice
    return F.arrow_udf(scan, f"struct<{_RESULT}>").asNondeterministic()


def item_blocks(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size; items are split over blocks by hash."""
    known = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-2 * chars // BLOCK_CHARS))
    if count == 1:
        yield [(r["id"], r["text"].encode()) for r in known.distinct().collect()]
        return
    for block in range(count):
        part = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).distinct()
        yield [(r["id"], r["text"].encode()) for r in part.toLocalIterator()]


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), words and chars (hit ranges), contaminated.

    Null or empty texts have no words and are clean. Empty or null items match nothing;
    items with equal ids count once; a null id is the empty string. No items leave every
    document clean, no documents give no rows. Columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast(f"struct<{_RESULT}>").alias("found"))
    for number, block in enumerate(item_blocks(items, item_text, item_id)):
        found = _scan(spark.sparkContext.broadcast(block), uuid.uuid4().hex, window)
        # one automaton at a time in the Python workers
        out = (materialise(out) if number else out).withColumn("found", found(F.col(f"row.`{text}`"), F.col("found.words"), F.col("found.items")))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in (*_NAMES, "contaminated")]
    return out.select(*kept, *[F.col(f"found.{n}") for n in _NAMES], (F.col("found.n_hit") > 0).alias("contaminated"))
