"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

Every text draws samples from its weighted shingles (improved consistent weighted sampling);
two texts draw the same sample as often as their weighted Jaccard similarity says. Bands of
samples give candidates, which are verified by the exact similarity of the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from aislemap.llm.common import WordHasher, binary, mix, rolling
from aislemap.llm.components import components
from aislemap.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
# A shingle in this share of the documents or less has the full weight, one plus STRENGTH; it falls from there to one
# at all documents. A strong fall would make near copies of a text with thousands of copies look less alike than others.
RARE, STRENGTH = 0.01, 0.25
# Neighbours are paired in parts of about this many members, so that no bucket is ordered in one task.
PART = 1000
# Shingles whose documents are counted in one pass.
COUNTED = 1 << 20
# Members of a bucket are compared wholly in blocks of at least this many, which grow with the root of the members.
BLOCK = 128
# A pair that shares a bucket is left uncompared if it agrees in so few samples that similar pairs do so with this probability.
MISSED = 1e-5
_CHUNK = 1 << 14


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the word runs of a text, given its word hashes, and how often each occurs; a shorter text is one run."""
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    size = min(size, len(hashes))
    return np.unique(rolling(hashes, size) + np.uint64(size), return_counts=True)


class Weights:
    """Term frequency times inverse document frequency, between 1 and 1 + STRENGTH for a single occurrence."""

    def __init__(self, frequent: list[tuple[int, int]], documents: int, rare: float):
        pairs = sorted((h & ((1 << 64) - 1), n) for h, n in frequent)
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        share = np.array([n for _, n in pairs], float) / max(documents, 1)
        self.idf = 1 + STRENGTH * np.log(1 / np.clip(share, rare, 1)) / np.log(1 / rare)

    def of(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(found), 1.0 + STRENGTH)
        if len(self.hashes) and len(found):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[at] == found
            idf[hit] = self.idf[at[hit]]
        return counts * idf


class Sampler:
    """Improved consistent weighted sampling: one (shingle, level) pair per function.

    Each shingle and function has a step r and a rank c, both Gamma(2, 1), and a phase. The
    level is floor(ln(weight) / r + phase), and the shingle with the least
    c * exp(-r * (level - phase) - r) is drawn.
    """

    def __init__(self, functions: int):
        odd = mix(np.arange(1, 2 * functions + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
        self.a, self.b = odd[:functions, None], odd[functions:, None]

    def _draws(self, found: np.ndarray) -> list[np.ndarray]:
        """Four 32-bit draws per function (row) and shingle (column): two for the step, two for the rank."""
        x = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)[None, :] * self.a
        x += (found >> np.uint64(32)).astype(np.uint32)[None, :] * self.b
        out = []
        for factor in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1):
            x = x ^ (x >> np.uint32(15))
            x *= np.uint32(factor)
            out.append(x)
        return out

    @staticmethod
    def _rough(x: np.ndarray) -> np.ndarray:
        """Draws as single-precision numbers between 0 and 1."""
        x = x >> np.uint32(9)
        x |= np.uint32(0x3F800000)
        out = x.view(np.float32)
        out -= np.float32(1 - 2.0**-24)
        return out

    @staticmethod
    def _rank(draws: list[np.ndarray], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value by which the least is drawn, and the level."""
        u = [((d >> np.uint32(9)).astype(np.float64) + 0.5) * 2.0**-23 for d in draws]
        bits = mix((draws[1].astype(np.uint64) << np.uint64(32)) | draws[3].astype(np.uint64))
        phase = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        r = -np.log(u[0] * u[1])
        level = np.floor(logs / r + phase)
        return -np.log(u[2] * u[3]) * np.exp(-r * (level - phase) - r), level

    def samples(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A hash of the sample of every function, for shingles in ascending order."""
        functions = len(self.a)
        best, out = np.full(functions, np.inf), np.zeros(functions, np.uint64)
        for start in range(0, len(found), _CHUNK):
            part, weight = found[start : start + _CHUNK], weights[start : start + _CHUNK]
            logs, draws = np.log(weight), self._draws(part)
            # the value is at least (1 - v1 v2) u1 u2 / weight, which spares the logarithms of nearly all
            bound = self._rough(draws[2])
            bound *= self._rough(draws[3])
            np.subtract(np.float32(1 + 1e-6), bound, out=bound)
            bound *= self._rough(draws[0])
            bound *= self._rough(draws[1])
            bound *= (1 / weight).astype(np.float32)[None, :]
            # values are exponential with the weight as rate, so the least is rarely above this; else all bounds below the least count
            rows, limit = np.arange(functions), np.minimum(best, 3 / weight.sum())
            for again in (False, True):
                row, col = np.nonzero(bound[rows] <= (limit[rows] * 1.00001).astype(np.float32)[:, None])
                if len(row):
                    at = rows[row]
                    value, level = self._rank([d[at, col] for d in draws], logs[col])
                    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    least = np.minimum.reduceat(value, heads)
                    hit = np.flatnonzero(value == np.repeat(least, np.diff(np.append(heads, len(row)))))
                    hit = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
                    hit = hit[value[hit] < best[at[hit]]]
                    best[at[hit]] = value[hit]
                    out[at[hit]] = mix(part[col[hit]] + mix(level[hit].astype(np.int64).view(np.uint64)))
                rows = np.flatnonzero(best > limit)
                if again or not len(rows):
                    break
                limit = best.copy()
                open_ = rows[~np.isfinite(best[rows])]
                first = bound[open_].argmin(axis=1)
                limit[open_] = self._rank([d[open_, first] for d in draws], logs[first])[0]
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger; two empty texts are alike."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 1.0


def _documents_of(docs: DataFrame, wanted, floor: float, size: int) -> DataFrame:
    """(hash, documents) per block of documents: shingles in a share ``floor`` of the block, or the wanted ones."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for part in parts:
            texts = binary(part.column(0))
            found = [shingles(hasher(t), size)[0] for t in texts]
            hashes, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            if wanted is None:
                keep = counts >= max(1.0, floor * len(texts))
            else:
                sought = wanted.value
                keep = np.zeros(len(hashes), bool)
                if len(sought) and len(hashes):
                    keep = sought[np.minimum(np.searchsorted(sought, hashes), len(sought) - 1)] == hashes
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["hash", "documents"])

    return docs.mapInArrow(count, "hash long, documents long")


def frequent_shingles(docs: DataFrame, text: str, documents: int, rare: float = RARE, size: int = SHINGLE) -> list[tuple[int, int]]:
    """All shingles in more than a share ``rare`` of the documents, with their exact counts.

    Such a shingle has that share in at least one block, so the first pass misses none; the
    second counts what the first found. There are at most (mean shingles per document / rare).
    """
    texts = docs.select(F.col(text))
    local = materialise(_documents_of(texts, None, rare, size).groupBy("hash").agg(F.sum("documents").alias("documents")))
    passes = -(-local.count() // COUNTED)
    out: list[tuple[int, int]] = []
    for number in range(passes):
        part = local.where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == number).select("hash")
        sought = np.sort(np.fromiter((r[0] for r in part.toLocalIterator()), np.int64)).view(np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(sought))
        counted = _documents_of(texts, shared, rare, size).groupBy("hash").agg(F.sum("documents").alias("documents"))
        out += [tuple(r) for r in counted.where(F.col("documents") > rare * documents).collect()]
    return out


_SAMPLED = pa.schema([("doc_id", pa.string()), ("row", pa.int64()), ("text_hash", pa.int64()), ("node", pa.string()), ("samples", pa.binary())])


def _sampled(base: DataFrame, weights, functions: int, size: int) -> DataFrame:
    """Every document with the digest of its words (``node``) and its samples, 32 bits of each; none without words."""

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sampler = WordHasher(lower=True), Sampler(functions)
        for part in parts:
            nodes, drawn = [], []
            for raw in binary(part.column(3)):
                words = hasher(raw)
                nodes.append(xxhash.xxh3_128_hexdigest(words.tobytes()))
                found, counts = shingles(words, size)
                drawn.append(sampler.samples(found, weights.value.of(found, counts)).astype("<u4").tobytes() if len(found) else b"")
            arrays = [part.column(0), part.column(1), part.column(2), pa.array(nodes), pa.array(drawn, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SAMPLED)

    return base.mapInArrow(draw, "doc_id string, row long, text_hash long, node string, samples binary")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of each bucket: everyone with its centre, and with the one before in its part.

    The centre is the member that meets most others over all its buckets, as the text that
    the others were copied from does. Pairs grow with the members, not with their square,
    and no bucket is gathered as a whole.
    """
    firsts = members.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("m"), "node")).alias("first"))
    joined = members.join(firsts.select("bucket", F.col("first.node").alias("first")), "bucket")
    joined = joined.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART)))
    joined = joined.withColumn("before", F.lag("node").over(Window.partitionBy("bucket", "part").orderBy(F.desc("met"), "node")))
    pairs = joined.withColumn("other", F.explode(F.array_distinct(F.array_compact(F.array("first", "before")))))
    return _ordered(pairs)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, weights, size: int) -> DataFrame:
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        hasher, seen = WordHasher(lower=True), {}

        def bag(text: bytes):
            if text not in seen:
                if len(seen) > 64:
                    seen.clear()
                found, counts = shingles(hasher(text), size)
                seen[text] = found, weights.value.of(found, counts)
            return seen[text]

        return pa.array([weighted_jaccard(bag(a), bag(b)) for a, b in zip(binary(left), binary(right))], pa.float64())

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.arrow_udf(compare, "double")("text_a", "text_b").alias("similarity"))


def least_agreement(functions: int, similarity: float, missed: float = MISSED) -> int:
    """The samples in which a pair of this similarity agrees, but for a probability of at most ``missed``."""
    below = 0.0
    for n in range(functions + 1):
        below += math.comb(functions, n) * similarity**n * (1 - similarity) ** (functions - n)
        if below > missed:
            return n
    return functions


def _blocks(members: DataFrame, roots: DataFrame, samples: DataFrame) -> DataFrame:
    """The members of every bucket that holds several classes, once for each block pair (i, j) they belong to.

    The largest class is cut into blocks of its own, which do not meet each other. Members
    outside it meet all blocks. Blocks grow with the root of the members, so n members that
    are all of different classes make n * sqrt(n) / 4 rows, and no task gets a whole bucket.
    """
    classes = members.join(roots, "node", "left").select("bucket", "band", "node", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    counted = classes.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    open_ = counted.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("classes")).where("classes > 1")

    def blocks(n):
        return F.ceil(n / F.greatest(F.lit(BLOCK), F.ceil(4 * F.sqrt(n)))).cast("int")

    open_ = open_.select("bucket", F.col("m.root").alias("main"), blocks(F.col("all") - F.col("m.n")).alias("others"), blocks(F.col("m.n")).alias("mains"))
    here, spot = F.col("root") == F.col("main"), F.xxhash64("node", "bucket")
    part = F.when(here, F.col("others") + F.pmod(spot, F.col("mains"))).otherwise(F.pmod(spot, F.col("others"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(here, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    dealt = classes.join(open_, "bucket").withColumn("part", part).join(samples, "node")
    dealt = dealt.select("bucket", F.explode(meets).alias("with"), "part", "band", "node", "root", "samples")
    return dealt.select("bucket", F.least("with", "part").alias("i"), F.greatest("with", "part").alias("j"), "part", "band", "node", "root", "samples")


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block pair after the other, from batches in the order of (bucket, i, j)."""
    held, last = [], None
    for part in parts:
        keys = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _close(run: pa.Table, bands: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs of a block pair that may be similar, how often they agree, and the class of every position.

    Pairs are of different classes, and only the first bucket that both are in has them.
    """
    i, j, part, band, root = (run.column(c).to_numpy() for c in ("i", "j", "part", "band", "root"))
    drawn = np.frombuffer(b"".join(run.column("samples").to_pylist()), "<u4").reshape(len(root), -1)
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found = []
    step = max(1, (1 << 22) // (drawn.shape[1] * max(1, len(right))))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        equal = drawn[some][:, None, :] == drawn[right][None, :, :]
        agree = equal.sum(axis=2)
        near = (agree >= least) & (root[some][:, None] != root[right][None, :])
        if i[0] == j[0]:
            near &= some[:, None] < right[None, :]
        x, y = np.nonzero(near)
        first = equal[x, y].reshape(len(x), bands, drawn.shape[1] // bands).all(axis=2).argmax(axis=1) == band[0]
        x, y = x[first], y[first]
        found.append((some[x], right[y], agree[x, y]))
    return *(np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*found)), root


_BLOCKS = "bucket long, i int, j int, part int, band int, node string, root long, samples binary"


def _open_links(members: DataFrame, roots: DataFrame, samples: DataFrame, texts: DataFrame, weights, bands: int, least: int, similarity: float, size: int) -> DataFrame:
    """Similar pairs (a < b) of a bucket and of different classes; one link between two classes in a block pair is enough.

    All pairs are met in blocks and never become rows. Those that agree in enough samples
    are compared by the whole texts, which only members of such pairs bring along.
    """

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for run in _runs(parts):
            x, y, _, _ = _close(run, bands, least)
            if len(x):
                held.append(run.take(np.unique(np.concatenate([x, y]))))
                rows += len(held[-1])
            if rows >= _CHUNK:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for run in _runs(parts):
            x, y, agree, root = _close(run, bands, least)
            order = np.lexsort((-agree, x))
            nodes, bags = run.column("node").to_pylist(), []
            for text in binary(run.column("text").combine_chunks()):
                found, counts = shingles(hasher(text), size)
                bags.append((found, weights.value.of(found, counts)))
            all_, place = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
            ids = np.split(place, np.cumsum([len(b[0]) for b in bags])[:-1])
            sums = [float(b[1].sum()) for b in bags]
            parent = {r: r for r in root.tolist()}

            def top(r: int) -> int:
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            own, last, links = np.zeros(len(all_)), -1, []
            for p, q in zip(x[order].tolist(), y[order].tolist()):
                a, b = top(int(root[p])), top(int(root[q]))
                if a == b or min(sums[p], sums[q]) < similarity * max(sums[p], sums[q]) - 1e-6:
                    continue
                if p != last:
                    if last >= 0:
                        own[ids[last]] = 0
                    own[ids[p]] = bags[p][1]
                    last = p
                low = float(np.minimum(own[ids[q]], bags[q][1]).sum())
                # sums in another order may differ in the last digits
                if low + 1e-6 >= similarity * (sums[p] + sums[q] - low) and weighted_jaccard(bags[p], bags[q]) >= similarity:
                    parent[a] = b
                    links.append(sorted((nodes[p], nodes[q])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in links]), pa.array([k[1] for k in links])], names=["a", "b"])

    near = materialise(_dealt(_blocks(members, roots, samples)).mapInArrow(meet, _BLOCKS))
    return _dealt(near.join(texts, "node").select("bucket", "i", "j", "part", "band", "node", "root", "samples", "text")).mapInArrow(compare, "a string, b string")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, and text_hash (of the exact text).

    Texts with the same words are copies; other texts are linked when the weighted Jaccard
    similarity of their five-word shingles is at least ``similarity``, and classes are what
    links connect. The smallest id of a class (null last) names it and is kept; of rows that
    repeat an id one is kept. Texts without words are copies of each other, null ones included.
    Texts under five words are one shingle. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    base = docs.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"),
    )
    documents = docs.count()
    weights = spark.sparkContext.broadcast(Weights(frequent_shingles(docs, text, documents, RARE, size), documents, RARE))
    sampled = materialise(_sampled(base, weights, bands * rows, size))
    one = sampled.groupBy("node").agg(F.min(F.struct("text_hash", "doc_id", "samples")).alias("s"))
    keys = [F.xxhash64(F.lit(b), F.substring("s.samples", 4 * rows * b + 1, 4 * rows)) for b in range(bands)]
    members = one.where(F.length("s.samples") > 0).select("node", F.posexplode(F.array(*keys)).alias("band", "bucket"))
    members = materialise(members.join(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    members = materialise(members.join(met, "node"))
    pairs = materialise(_first_pairs(members))

    wanted = members.select("node").distinct().join(one.select("node", F.col("s.text_hash").alias("hash"), F.col("s.doc_id").alias("id")), "node")
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    texts = materialise(base.drop("row").join(wanted, here).select("node", "text").dropDuplicates(["node"]))
    checked = materialise(_verified(pairs, texts, weights, size))
    roots = components(checked.where(F.col("similarity") >= similarity))
    links = checked.where(F.col("similarity") >= similarity).select("a", "b")
    samples = one.select("node", F.col("s.samples").alias("samples"))
    least = least_agreement(bands * rows, similarity)
    more = materialise(_open_links(members, roots, samples, texts, weights, bands, least, similarity, size))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = sampled.select("doc_id", "row", "text_hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.withColumn("id", F.col("doc_id").cast(kind))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"))).alias("best"), F.count("*").alias("class_size"))
    return named.join(best, "root").select(
        F.col("id").alias("doc_id"), F.col("best.i").alias("class_id"), "class_size", (F.col("row") == F.col("best.r")).alias("kept"), "text_hash"
    )


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents of which each class keeps one, with their columns. Rows that repeat id and text count once."""
    kept = near_duplicates(docs, text, doc_id, **options).where("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    keyed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    stay = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    return stay.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
