"""Phrase collocations, counted level by level in hash tries.

Words become 64-bit numbers per language, so that a phrase is a run of numbers. Every
task keeps the runs it meets in a trie: the first word leads to a hash container of the
rests, and a container that grows too large bursts into one container per next word.
When the trie is full, whole subtrees leave it as sorted runs, and Spark adds up the runs
of all tasks per prefix. A phrase can only be frequent if the two phrases that lack its
first or last word are, so each length is counted at places where a bit map of the
frequent shorter phrases, of a fixed size, has both. A bit set by another phrase costs
time, never a result.

Null text is empty, null language counts as ``und``. All texts are read whole.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislemap.llm.common import WordHasher, binary, mix, rolling
from aislemap.session import materialise, spread

# The characters that end a piece of text.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
LONGEST, LEAST_COUNT, BEST, PERCENT = 5, 100, 2000, 100
NO_LANGUAGE = "und"
# A container bursts beyond this many phrases; a trie or counter beyond that many spills.
BURST, TRIE_ENTRIES = 4096, 600_000
# Bits of the map of frequent phrases.
MAP_BITS = 24
# Texts of one language are read together up to this size.
BUFFER = 1 << 22

_TABLE = bytes.maketrans((string.ascii_uppercase + PIECE_ENDS + "\t").encode(), (string.ascii_lowercase + "\n" * len(PIECE_ENDS) + " ").encode())


def _buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    """(language, texts) with pieces parted by line feeds and words by blanks."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), binary(batch.column("text"))):
            if not text:
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= most:
                yield lang, b"\n".join(held.pop(lang)).translate(_TABLE)
                del sizes[lang]
    for lang, texts in held.items():
        yield lang, b"\n".join(texts).translate(_TABLE)


def _salt(lang: str, seed: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}|{lang}".encode(), digest_size=8).digest(), "big"))


def _numbers(hashes: np.ndarray, lang: str, seed: int) -> np.ndarray:
    return mix(hashes ^ _salt(lang, seed))


def _places(text: bytes, k: int) -> np.ndarray:
    """Where ``k`` neighbouring words lie in one piece."""
    raw = np.frombuffer(text, np.uint8)
    word = np.zeros(len(raw) + 1, bool)
    np.logical_and(raw != 32, raw != 10, out=word[1:])
    starts = np.flatnonzero(word[1:] & ~word[:-1])
    piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
    return piece[: len(piece) - k + 1] == piece[k - 1 :] if len(piece) >= k else np.empty(0, bool)


class HatTrie:
    """Counts of runs of 8-byte numbers: tries over the first numbers, hash containers of the rest."""

    def __init__(self, burst: int):
        self.root: dict = {}
        self.burst, self.entries = burst, 0
        self.tries: set[int] = set()

    def add(self, run: bytes, n: int = 1) -> None:
        node, at = self.root, 8
        while True:
            head = run[at - 8 : at]
            below = node.get(head)
            if below is None:
                below = node[head] = {}
            if id(below) not in self.tries:
                break
            node, at = below, at + 8
        rest = run[at:]
        seen = below.get(rest)
        if seen is None:
            below[rest] = n
            self.entries += 1
            if len(below) > self.burst and len(rest) > 8:
                node[head] = self._burst(below)
        else:
            below[rest] = seen + n

    def _burst(self, container: dict[bytes, int]) -> dict:
        """A trie node over the next number; ends stay in containers below it."""
        node: dict = {}
        for rest, n in container.items():
            node.setdefault(rest[:8], {})[rest[8:]] = n
        self.tries.add(id(node))
        return node

    def _drain(self, node: dict, path: bytes) -> Iterator[tuple[bytes, bytes, int]]:
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            if id(node) in self.tries:
                self.tries.discard(id(node))
                stack += [(node[head], path + head) for head in sorted(node, reverse=True)]
            else:
                self.entries -= len(node)
                for rest in sorted(node):
                    yield path[:8], path[8:] + rest, node[rest]

    def _weight(self, head: bytes) -> int:
        node = self.root[head]
        return sum(len(x) for x in node.values()) if id(node) in self.tries else len(node)

    def spill(self, keep: int = 0) -> Iterator[tuple[bytes, bytes, int]]:
        """(prefix, rest, count) of the largest subtrees, each as a sorted run, until ``keep`` runs are left."""
        for head in sorted(self.root, key=lambda h: (-self._weight(h), h)) if keep else sorted(self.root):
            if self.entries <= keep and keep:
                return
            yield from self._drain(self.root.pop(head), head)


_RUNS = pa.schema([("prefix", pa.binary()), ("rest", pa.binary()), ("n", pa.int64())])
_WORDS = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")


def frequent_words(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(id, lang, word, n, others): words with ``least`` places, and per language a row without word that has them all.

    ``others`` tells that further words have the same number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        hasher = WordHasher(False)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in words.items():
                named = sorted(counts)
                ids = _numbers(hasher(b" ".join(named)), lang, seed).view(np.int64)
                total = [(int(_salt(lang, seed).view(np.int64)), lang, None, sum(counts.values()))]
                yield from _batches(iter(total), _WORDS)
                yield from _batches(zip(ids.tolist(), [lang] * len(named), [w.decode() for w in named], [counts[w] for w in named]), _WORDS)
            words.clear()

        for lang, text in _buffers(batches, BUFFER):
            words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > TRIE_ENTRIES:
                yield from out()
        yield from out()

    found = texts.mapInArrow(count, "id long, lang string, word string, n long").repartition("id")
    found = found.groupBy("id", F.col("word").isNull().alias("total"), "lang", "word").agg(F.sum("n").alias("n"))
    found = found.groupBy("id", "total").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"), (F.count("*") > 1).alias("others"))
    return materialise(found.where(F.col("total") | (F.col("n") >= least)).drop("total"))


def bit_map(slots: DataFrame) -> np.ndarray:
    """A map of ``MAP_BITS`` address bits with the given ``slot`` numbers set; at most 2**MAP_BITS / 64 rows reach the driver."""
    cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _slot(numbers: np.ndarray, address_bits: int) -> np.ndarray:
    return numbers >> np.uint64(64 - address_bits)


def _is_set(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = _slot(numbers, 5 + len(bits).bit_length())
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _run_hash(words: np.ndarray, k: int) -> np.ndarray:
    return words if k == 1 else rolling(words, k)


def slots(phrases: DataFrame, k: int) -> DataFrame:
    """The map places of phrases of ``k`` words, given as ``key``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            words = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64)
            hashes = words if k == 1 else _run_hash(words, k)[::k] if len(keys) else words
            yield pa.RecordBatch.from_arrays([pa.array(_slot(hashes, MAP_BITS).astype(np.int64))], names=["slot"])

    return phrases.select("key").mapInArrow(place, "slot long")


def count_runs(texts: DataFrame, k: int, bits: np.ndarray, least: int, seed: int) -> DataFrame:
    """(key, n) of all runs of ``k`` words inside a piece with at least ``least`` places."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hasher, bits, size = HatTrie(BURST), WordHasher(False), shared.value, 8 * k
        for lang, text in _buffers(batches, BUFFER):
            words = _numbers(hasher(text), lang, seed)
            if len(words) < k:
                continue
            known = _is_set(bits, _run_hash(words, k - 1))
            places = np.flatnonzero(_places(text, k) & known[:-1] & known[1:])
            raw = words.astype(">u8").tobytes()
            add = trie.add
            for at in (places * 8).tolist():
                add(raw[at : at + size])
            if trie.entries > TRIE_ENTRIES:
                yield from _batches(trie.spill(TRIE_ENTRIES // 2), _RUNS)
        yield from _batches(trie.spill(), _RUNS)

    runs = texts.mapInArrow(count, "prefix binary, rest binary, n long")
    summed = runs.groupBy("prefix", "rest").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = materialise(summed.select(F.concat("prefix", "rest").alias("key"), "n"))
    shared.destroy()
    return out


def _key(word_id) -> Column:
    """A number as 8 bytes, as in the runs."""
    return F.unhex(F.lpad(F.hex(word_id), 16, "0"))


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """((id, lang, word, n), (key, k, n)): the frequent words and phrases; words without ``word`` hold a language's total."""
    texts = spread(_texts(docs))
    for seed in range(8):
        words = frequent_words(texts, least, seed)
        # a number that stands for two words would mix their counts: count again with other numbers
        if words.where("others").isEmpty():
            break
    else:
        raise ValueError("words cannot be told apart by their numbers")
    level = words.where("word is not null").select(_key(F.col("id")).alias("key"), "n")
    phrases = level.select("key", F.lit(1).alias("k"), "n")
    for k in range(2, longest + 1):
        level = count_runs(texts, k, bit_map(slots(level, k - 1)), least, seed)
        phrases = phrases.unionByName(level.select("key", F.lit(k).alias("k"), "n"))
    return words.drop("others"), phrases


def score_phrases(words: DataFrame, phrases: DataFrame, best: int = BEST, percent: int = PERCENT) -> DataFrame:
    """The ``best`` phrases of each language with their weakest cut.

    A longer phrase that keeps ``percent`` of a shorter one's places keeps at least as much
    of every phrase between them, so one more word is all that has to be looked at.
    """
    phrases = materialise(phrases)
    candidates = phrases.where("k >= 2")
    names = words.where("word is not null").select(_key(F.col("id")).alias("word_key"), "lang", "word")
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    inner = candidates.where("k >= 3").select(F.explode(F.array(F.expr("substring(key, 9)"), F.expr("substring(key, 1, (k - 1) * 8)"))).alias("key"), F.col("n").alias("longer"))
    inner = inner.groupBy("key").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inner, "key", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("n"), F.lit(True))).drop("longer")
    cuts = kept.select("key", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.expr("substring(key, 1, cut * 8)").alias("left_key"), F.expr("substring(key, cut * 8 + 1)").alias("right_key"))
    count = phrases.select("key", "n")
    cuts = cuts.join(count.select(F.col("key").alias("left_key"), F.col("n").alias("l")), "left_key")
    cuts = cuts.join(count.select(F.col("key").alias("right_key"), F.col("n").alias("r")), "right_key")
    cuts = cuts.withColumn("word_key", F.expr("substring(key, 1, 8)")).join(names.select("word_key", "lang"), "word_key").join(totals, "lang")

    def big(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    # up to 38 digits: exact up to some 10**17 words
    cuts = cuts.withColumn("x", big("a") * big("total") * F.lit(1000).cast("decimal(4,0)")).withColumn("y", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("x div y"))
    weakest = cuts.groupBy("lang", "key", "k", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    scored = materialise(weakest.select("lang", "key", "k", "a", "c.l", "c.r", F.col("total").alias("n"), "c.score"))
    # phrases are spelt once it is known, but for ties, which ones come first
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ranked = scored.withColumn("near", F.rank().over(first)).where(F.col("near") <= best)
    spelt = ranked.select("key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at")).withColumn("word_key", F.expr("substring(key, at * 8 + 1, 8)"))
    spelt = spelt.join(names.select("word_key", "word"), "word_key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelt = ranked.join(spelt.select("key", F.array_join("w.word", " ").alias("phrase")), "key")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, best: int = BEST, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language that say most as a whole."""
    return score_phrases(*count_phrases(docs, longest, least), best, percent)
