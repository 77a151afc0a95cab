"""Repeated-passage removal by De Bruijn compaction.

Nodes are the word k-mers that are smallest by hash in some window; every window of
``window`` words holds one, and equal windows hold the same. Edges are the exact words from
one node of a document to the next. A node is inner if all its occurrences have the same
edges on both sides; runs of inner nodes are the nonbranching paths, so each run occurs
whole wherever one of its nodes occurs, and is compacted to one span. Spans, and the windows
that no span holds, are then verified by a digest of their words and counted by it. What a
document repeats itself is found inside it, so only nodes of several documents are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aislemap.llm.common import WordHasher, binary, mix, rolling, space_words
from aislemap.session import materialise

WINDOW = 35
K = 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_nodes(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """For every window of words, the start of its smallest k-mer (the first of equals)."""
    kmers = rolling(hashes, k)
    width = window - k + 1
    if len(kmers) < width:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(kmers, width).argmin(axis=1) + np.arange(len(kmers) - width + 1)


def edge_hashes(hashes: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the words from each node to the end of the next; the first and last edge run to the ends of the document."""
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(hashes), _BASE))])
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(hashes), _INVERSE))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1])])
    first = np.concatenate([[0], nodes])
    last = np.concatenate([nodes + k, [len(hashes)]])
    out = mix((sums[last] - sums[first]) * inverse[first] + mix((last - first).astype(np.uint64)))
    out[0] = mix(out[:1] + np.uint64(1))[0]
    out[-1] = mix(out[-1:] + np.uint64(2))[0]
    return out


def _digest(words: list[bytes]) -> tuple[int, int]:
    """96 bits of the words."""
    value = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (value >> 64) - (1 << 63), (value & ((1 << 32) - 1)) - (1 << 31)


_NODES = pa.schema([
    ("doc_id", pa.string()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha256", pa.string()),
    ("nodes", pa.list_(pa.int64())), ("sides", pa.list_(pa.int64())),
])
_NODES_SQL = "doc_id string, text_hash long, n_words long, n_removed long, sha256 string, nodes array<long>, sides array<long>"
_UNITS = pa.schema([("row", pa.int64()), ("high", pa.int64()), ("low", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
_UNITS_SQL = "row long, high long, low int, start int, length int"
_KEPT_SQL = "struct<n_removed:long,sha256:string,spans:array<struct<start:int,length:int>>>"


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def own_repeats(words: list[bytes], hashes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Windows (start, end) whose words start at another place of the same document too."""
    rolled = rolling(hashes, window)
    _, of, times = np.unique(rolled, return_inverse=True, return_counts=True)
    seen: dict[tuple[int, int], list[int]] = {}
    for start in np.flatnonzero(times[of] > 1).tolist():
        seen.setdefault(_digest(words[start : start + window]), []).append(start)
    return [(start, start + window) for starts in seen.values() if len(starts) > 1 for start in starts]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans (start, end) that touch or overlap become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def outside(words: list[bytes], spans: list[list[int]]) -> list[bytes]:
    """The words in none of the merged spans."""
    kept, at = [], 0
    for start, end in spans:
        kept += words[at:start]
        at = end
    return kept + words[at:]


def graph_nodes(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row per document: its different nodes, a hash of the edges on both sides of each (null if they differ
    within the document), and what is left of it without windows that it repeats itself."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for part in parts:
            columns: list[list] = [[], [], [], [], []]
            for raw in binary(part.column(2)):
                words = space_words(raw)
                hashes = hasher(raw)
                places = np.unique(window_nodes(hashes, window, k))
                kept, nodes, sides = words, np.empty(0, np.uint64), np.empty(0, object)
                if len(places):
                    edges = edge_hashes(hashes, places, k)
                    around = mix(edges[:-1] + _BASE * edges[1:])
                    nodes, first, of = np.unique(rolling(hashes, k)[places], return_index=True, return_inverse=True)
                    mixed = np.zeros(len(nodes), bool)
                    np.logical_or.at(mixed, of, around != around[first][of])
                    sides = pa.array(around[first].view(np.int64), mask=mixed)
                    if len(nodes) < len(places):
                        kept = outside(words, merged(own_repeats(words, hashes, window)))
                for held, value in zip(columns, (len(words), len(words) - len(kept), _sha(kept), nodes.view(np.int64), sides)):
                    held.append(value)
            sides = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[4]])]), pa.int32()),
                pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array([], pa.int64()) for x in columns[4]] or [pa.array([], pa.int64())]),
            )
            arrays = [pa.array(c, f.type) for c, f in zip(columns[:4], list(_NODES)[2:6])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays, sides], schema=_NODES)

    return docs.mapInArrow(find, _NODES_SQL)


def shared_nodes(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, marks) for documents with nodes that other documents have; a mark is a node and whether it is inner."""
    nodes = found.select("doc_id", "text_hash", F.explode(F.arrays_zip("nodes", "sides")).alias("n"))
    nodes = nodes.select("doc_id", "text_hash", F.col("n.nodes").alias("node"), F.col("n.sides").alias("side"))
    degrees = nodes.groupBy("node").agg(F.count("*").alias("times"), F.count("side").alias("sided"), F.min("side").alias("low"), F.max("side").alias("high"))
    degrees = degrees.where("times > 1").select("node", ((F.col("sided") == F.col("times")) & (F.col("low") == F.col("high"))).alias("inner"))
    return nodes.drop("side").join(degrees, "node").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("node", "inner")).alias("marks"))


def document_units(hashes: np.ndarray, marks: dict[int, bool], window: int, k: int) -> list[tuple[int, int]]:
    """Spans and windows (start, length) that may repeat in other documents and must be counted."""
    own = window_nodes(hashes, window, k)
    places = np.unique(own)
    states = [marks.get(h) for h in rolling(hashes, k)[places].view(np.int64).tolist()]
    shared = np.array([s is not None for s in states], bool)
    inner = np.array([bool(s) for s in states], bool)
    before = np.concatenate([[0], places[:-1]])
    after = np.concatenate([places[1:] + k, [len(hashes)]])
    # a run of inner nodes reaches from the node before it to the end of the node after it
    opens = inner & ~np.concatenate([[False], inner[:-1]])
    closes = inner & ~np.concatenate([inner[1:], [False]])
    starts, ends = before[opens], after[closes]
    run = np.cumsum(opens) - 1
    spans = [(int(s), int(e - s)) for s, e in zip(starts, ends) if e - s >= window]
    index = np.searchsorted(places, own)
    loose, held = shared[index], inner[index]
    first = np.arange(len(own))[held]
    of = run[index[held]]
    loose[first[(first >= starts[of]) & (first + window <= ends[of])]] = False
    return spans + [(int(i), window) for i in np.flatnonzero(loose)]


def count_units(texts: DataFrame, window: int, k: int) -> DataFrame:
    """Every span and loose window of documents with marks, by the digest of its words; what a document repeats counts once."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for part in parts:
            rows: list[list] = [[], [], [], [], []]
            for row, raw, marks in zip(part.column(0).to_pylist(), binary(part.column(1)), part.column(2).to_pylist()):
                words, seen = space_words(raw), set()
                for start, length in document_units(hasher(raw), {m["node"]: m["inner"] for m in marks}, window, k):
                    digest = _digest(words[start : start + length])
                    if digest not in seen:
                        seen.add(digest)
                        for held, value in zip(rows, (row, *digest, start, length)):
                            held.append(value)
                if len(rows[0]) > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _UNITS.types)], schema=_UNITS)
                    rows = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _UNITS.types)], schema=_UNITS)

    return texts.mapInArrow(find, _UNITS_SQL)


def _keep_words(window: int):
    def keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
        hasher, rows = WordHasher(lower=False), []
        for raw, found in zip(binary(texts), spans.to_pylist()):
            words = space_words(raw)
            gone = merged(own_repeats(words, hasher(raw), window) + [(s["start"], s["start"] + s["length"]) for s in found or ()])
            kept = outside(words, gone)
            rows.append({"n_removed": len(words) - len(kept), "sha256": _sha(kept), "spans": [{"start": s, "length": e - s} for s, e in gone]})
        return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))]))

    return F.arrow_udf(keep, _KEPT_SQL)


def shared_spans(docs: DataFrame, found: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The texts that share nodes (row, doc_id, text_hash, text, marks), and (row, spans) of what they share with others."""
    marks = materialise(shared_nodes(found)).select(F.col("doc_id").alias("marked"), F.col("text_hash").alias("hash"), "marks")
    same = F.col("doc_id").eqNullSafe(F.col("marked")) & (F.col("text_hash") == F.col("hash"))
    texts = docs.join(marks, same).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "text", "marks")
    texts = materialise(texts)
    units = materialise(count_units(texts.select("row", "text", "marks"), window, k))
    often = units.groupBy("high", "low").agg(F.count("*").alias("times")).where("times > 1").select("high", "low")
    spans = units.join(often, ["high", "low"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return texts, materialise(spans)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words around it starts anywhere else too, in the
    same or another document, all judged on the input. Words are runs of anything but ASCII
    white space; null and shorter texts lose nothing. Rows that repeat id and text are
    separate documents and so repeat each other. No rows give no rows; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType
    base = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    found = materialise(graph_nodes(base, window, k))
    texts, spans = shared_spans(base, found, window, k)
    cut = texts.select("row", "doc_id", "text_hash", "text").join(spans, "row")
    cut = materialise(cut.select("doc_id", "text_hash", _keep_words(window)("text", "spans").alias("kept")).select("doc_id", "text_hash", "kept.n_removed", "kept.sha256"))
    # rows that repeat id and text have the same result
    cut = cut.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("marked"), F.col("text_hash").alias("hash"), F.col("n_removed").alias("gone"), F.col("sha256").alias("left"))
    same = F.col("doc_id").eqNullSafe(F.col("marked")) & (F.col("text_hash") == F.col("hash"))
    return found.drop("nodes", "sides").join(cut, same, "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_words", F.coalesce("gone", "n_removed").alias("n_removed"), F.coalesce("left", "sha256").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with their texts cut, and ``spans`` (start word and length of what went).

    Texts without repeated windows stay as they are; of others the words that stay are
    joined by one space. Null texts stay null. A column called spans is replaced.
    """
    base = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    found = materialise(graph_nodes(base, window, k))
    texts, spans = shared_spans(base, found, window, k)
    cut = texts.select("row", "doc_id", "text_hash").join(spans, "row").dropDuplicates(["doc_id", "text_hash"])
    cut = cut.select(F.col("doc_id").alias("marked"), F.col("text_hash").alias("hash"), "spans")
    keyed = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("marked")) & (F.col("text_hash") == F.col("hash"))
    done = keyed.join(cut, same, "left").withColumn("kept", _keep_words(window)(F.col(f"doc.`{text}`"), F.col("spans")))

    def left(column: pa.Array, gone: pa.Array) -> pa.Array:
        rows = zip(column.to_pylist(), gone.to_pylist())
        return pa.array([b" ".join(outside(space_words(t.encode()), [[s["start"], s["start"] + s["length"]] for s in g])).decode() if t and g else t for t, g in rows], pa.string())

    done = done.withColumn("left", F.arrow_udf(left, "string")(F.col(f"doc.`{text}`"), F.col("kept.spans")))
    return done.select(*[F.col("left").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "spans"], F.col("kept.spans").alias("spans"))
