"""The prefix trie of conversations, built as ternary search trees over ranges of turn sequences.

Turns become numbers of a dictionary, conversations become rows of numbers, and equal
rows are counted before anything is sorted. Sorted by their numbers, the rows are dealt
to shards by range. A shard builds one ternary search tree per block of sequences, the
median sequence first, and walks it with a stack. Only the nodes on the path of the
first and of the last sequence of a block can have members elsewhere: they are merged
with the next block in the shard, and those on the edges of a shard with its
neighbours, 64 shards at a time.

Null role or text counts as empty. Turns are ordered by ``turn`` with null first, ties by
role, the first 64 characters of the text and the digest of the whole turn. Rows without
``conv_id`` belong to no conversation. Without conversations there is no node, not even
the root. One conversation is one row of numbers, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from aislemap.session import materialise, small_side

# A tree holds sequences of at most about this many turns in all.
BLOCK_TURNS = 1 << 19
# Shards whose edges are merged by one task of a round.
FAN_IN = 64
# Ids of members that are joined to one text before they are hashed in order.
CELL = 1024
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = b"\0" * 16


def encode_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): per conversation the dictionary numbers and text bytes of its turns, in order.

    The dictionary holds each distinct (role, text) once, known by its SHA-256. Texts are not shuffled.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    slim = materialise(
        turns.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
            F.substring(text, 1, 64).alias("opening"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
        )
    )
    numbers = materialise(slim.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))
    coded = slim.join(numbers, "digest")
    entry = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "opening", "digest", "id", "size")
    row = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return materialise(row.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")))


def rebuild(own: DataFrame, block: int = 5, most: int = 8) -> DataFrame:
    """Every conversation with its first h turns taken from the first conversation of its block of ids.

    h is the CRC-32 of the decimal id modulo ``most`` + 1; where that conversation is shorter or
    absent, fewer turns or none come from it, and the own turns after the first h follow.
    """
    first = F.col("conv_id") - F.col("conv_id") % block
    heads = own.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.array().cast("array<bigint>")

    def joined(head: str, tail: str):
        return F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")), F.slice(tail, F.col("h") + 1, F.size(tail)))

    both = own.withColumn("first", first).withColumn("h", h).join(heads, F.col("first") == F.col("head_id"), "left")
    return both.select("conv_id", joined("head_ids", "ids").alias("ids"), joined("head_sizes", "sizes").alias("sizes"))


class TernaryTree:
    """Sequences of numbers with what is known of those that end at a node.

    Node 0 is the empty sequence. ``low`` and ``high`` lead to other numbers at the same
    place of a sequence, ``equal`` to the next place.
    """

    def __init__(self):
        self.number, self.low, self.high, self.equal = [-1], [0], [0], [0]
        self.size, self.n, self.conv, self.ends = [0], [0], [None], [None]

    def _node(self, number: int, size: int) -> int:
        for column, value in zip((self.number, self.low, self.high, self.equal, self.size, self.n, self.conv, self.ends), (number, 0, 0, 0, size, 0, None, None)):
            column.append(value)
        return len(self.number) - 1

    def insert(self, ids: list[int], sizes: list[int], n: int, conv: int, ends: str) -> None:
        number, low, high, equal, at = self.number, self.low, self.high, self.equal, 0
        for x, size in zip(ids, sizes):
            if not equal[at]:
                at = self._link(equal, at, x, size)
                continue
            at = equal[at]
            while number[at] != x:
                side = low if x < number[at] else high
                at = side[at] or self._link(side, at, x, size)
        self.n[at], self.conv[at], self.ends[at] = n, conv, ends

    def _link(self, side: list[int], at: int, number: int, size: int) -> int:
        side[at] = self._node(number, size)
        return side[at]

    def insert_sorted(self, rows: list[tuple]) -> None:
        """Medians first, so that the numbers at one place form a balanced tree."""
        spans = [(0, len(rows))]
        while spans:
            a, b = spans.pop()
            if a < b:
                middle = (a + b) // 2
                self.insert(*rows[middle])
                spans += [(middle + 1, b), (a, middle)]

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, place of its parent in this order, depth), parents first and in order of the sequences."""
        yield 0, -1, 0
        stack, place = [(self.equal[0], 0, 1, False)], 0
        while stack:
            node, parent, depth, open_ = stack.pop()
            if not node:
                continue
            if not open_:
                stack += [(self.high[node], parent, depth, False), (node, parent, depth, True), (self.low[node], parent, depth, False)]
                continue
            place += 1
            yield node, parent, depth
            stack.append((self.equal[node], place, depth + 1, False))


def _child_key(parent: bytes, number: int) -> bytes:
    return hashlib.blake2b(parent + number.to_bytes(8, "big", signed=True), digest_size=16).digest()


class Open:
    """A node that may still get members: its sums so far, without those of its open children."""

    __slots__ = ("depth", "key", "parent", "n", "conv", "children", "leaves", "saved", "size", "ends", "edge")

    def __init__(self, depth, key, parent, n, conv, children, leaves, saved, size, ends, edge):
        self.depth, self.key, self.parent, self.n, self.conv, self.children = depth, key, parent, n, conv, children
        self.leaves, self.saved, self.size, self.ends, self.edge = leaves, saved, size, ends, edge

    def row(self) -> tuple:
        return tuple(getattr(self, c) for c in self.__slots__)


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


class Seam:
    """Joins open nodes that arrive in order, and closes those that have been left.

    Nodes marked ``edge`` lie on the path of the very first sequence and stay open, since
    members may come before it.
    """

    def __init__(self, closes_all: bool = False):
        self.path: list[Open] = []
        self.kept: list[Open] = []
        self.closed: list[tuple] = []
        self.closes_all = closes_all

    def add(self, x: Open) -> None:
        if x.depth < len(self.path):
            at = self.path[x.depth]
            if at.key == x.key:
                at.n, at.conv, at.children = at.n + x.n, _least(at.conv, x.conv), at.children + x.children
                at.leaves, at.saved, at.ends = at.leaves + x.leaves, at.saved + x.saved, at.ends or x.ends
                return
            self._leave(x.depth)
        self.path.append(x)

    def _leave(self, depth: int) -> None:
        while len(self.path) > depth:
            x = self.path.pop()
            if x.edge and not self.closes_all:
                self.kept.append(x)
                continue
            leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.size
            if self.path:
                up = self.path[-1]
                up.n, up.conv, up.children = up.n + x.n, _least(up.conv, x.conv), up.children + 1
                up.leaves, up.saved = up.leaves + leaves, up.saved + saved
            self.closed.append((x.conv, x.depth, None, x.n, x.children, leaves, saved, x.ends or _NO_ENDS, x.key, x.parent))

    def end(self) -> list[Open]:
        """What stays open: the first path, then what the last one has besides."""
        if self.closes_all:
            self._leave(0)
        edge = [x for x in self.path if x.edge] + self.kept[::-1]
        return sorted(edge, key=lambda x: x.depth) + [x for x in self.path if not x.edge]


def grow_block(rows: list[tuple], seam: Seam, first: bool) -> list[tuple]:
    """Closed nodes of a block of sorted sequences; the rest goes to the seam."""
    tree = TernaryTree()
    tree.insert_sorted(rows)
    order = list(tree.walk())
    start, last = rows[0][0], rows[-1][0]
    keys = {0: _ROOT}
    for place in range(1, len(start) + 1):
        keys[place] = _child_key(keys[place - 1], start[place - 1])
    on_first, at = len(start), 0
    # the last sequence's path: at each depth the node that comes last in order
    for place in range(len(order) - 1, -1, -1):
        depth = order[place][2]
        if depth == len(last) - at and depth:
            keys.setdefault(place, b"")
            at += 1
    for place in sorted(keys):
        node, parent, _ = order[place]
        if not keys[place]:
            keys[place] = _child_key(keys[parent], tree.number[node])
    m = len(order)
    n, conv = [tree.n[v] for v, _, _ in order], [tree.conv[v] for v, _, _ in order]
    children, leaves, saved = [0] * m, [0] * m, [0] * m
    for place in range(m - 1, -1, -1):
        if place in keys:
            continue
        node, up, _ = order[place]
        leaves[place] = leaves[place] or 1
        saved[place] += (n[place] - 1) * tree.size[node]
        n[up], conv[up], children[up] = n[up] + n[place], _least(conv[up], conv[place]), children[up] + 1
        leaves[up], saved[up] = leaves[up] + leaves[place], saved[up] + saved[place]
    closed = []
    for place, (node, up, depth) in enumerate(order):
        if place in keys:
            parent = keys[up] if up >= 0 else None
            edge = first and place <= on_first
            seam.add(Open(depth, keys[place], parent, n[place], conv[place], children[place], leaves[place], saved[place], tree.size[node], tree.ends[node], edge))
            continue
        known, parent = (conv[up], None) if up not in keys else (None, keys[up])
        closed.append((conv[place], depth, known, n[place], children[place], leaves[place], saved[place], tree.ends[node] or _NO_ENDS, None, parent))
    return closed


_CLOSED = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()),
]
_OPEN = [("size", pa.int64()), ("edge", pa.bool_()), ("shard", pa.int64()), ("place", pa.int64())]
_ROWS = pa.schema(_CLOSED + _OPEN)
_SCHEMA = ", ".join(f"{f.name} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary', pa.bool_(): 'boolean'})[f.type]}" for f in _ROWS)


def _batch(closed: list[tuple], open_: list[Open], shard: int) -> pa.RecordBatch:
    rows = [(*r, None, None, None, None) for r in closed]
    rows += [(x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.ends, x.key, x.parent, x.size, x.edge, shard, i) for i, x in enumerate(open_)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, sizes, members, lowest member, digest of the members) of the distinct sequences of a sorted shard."""
    held = None
    for batch in batches:
        for ids, sizes, n, conv, text in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "n", "conv", "members")]):
            if held and held[0] == ids:
                held[4].update(b",")
                held[2], held[3] = held[2] + n, min(held[3], conv)
            else:
                if held:
                    yield (*held[:4], held[4].hexdigest())
                held = [ids, sizes, n, conv, hashlib.sha256()]
            held[4].update(text.encode())
    if held:
        yield (*held[:4], held[4].hexdigest())


def prefix_trie(own: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences in (conv_id, ids, sizes); see the module for its columns' meaning.

    ``conv_id`` is the lowest member, ``ends_sha256`` the digest of the members that end at the
    node. The digest of a node is read in order of its members, so one task reads all of them,
    as texts of up to ``CELL`` ids.
    """
    cells = own.withColumn("cell", F.floor(F.col("conv_id") / CELL)).groupBy("ids", "sizes", "cell").agg(F.array_sort(F.collect_list("conv_id")).alias("m"))
    cells = materialise(
        cells.select("ids", "sizes", "cell", F.size("m").cast("long").alias("n"), F.col("m")[0].alias("conv"), F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))
    )
    sorted_ = cells.repartitionByRange("ids").sortWithinPartitions("ids", "cell")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seam, block, turns, first = Seam(), [], 0, True
        shard = TaskContext.get().partitionId()
        for row in _sequences(batches):
            block.append(row)
            turns += len(row[0]) + 1
            if turns >= BLOCK_TURNS:
                closed = grow_block(block, seam, first) + seam.closed
                block, turns, first, seam.closed = [], 0, False, []
                if closed:
                    yield _batch(closed, [], shard)
        closed = (grow_block(block, seam, first) if block else []) + seam.closed
        seam.closed = []
        open_ = seam.end()
        if closed or open_:
            yield _batch(closed, open_, shard)

    grown = materialise(sorted_.mapInArrow(grow, _SCHEMA))
    done, edges = grown.where("shard is null"), grown.where("shard is not null")
    while True:
        last = (edges.agg(F.max("shard").alias("last")).first()["last"] or 0) < FAN_IN
        merged = materialise(edges.withColumn("group", F.floor(F.col("shard") / FAN_IN)).groupBy("group").applyInArrow(_merge(last), _SCHEMA))
        done = done.unionByName(merged.where("shard is null"))
        if last:
            break
        edges = merged.where("shard is not null")
    named = small_side(done.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")), 4)
    columns = [f for f, _ in _CLOSED[:8]]
    return done.join(named, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent")).select(*columns)


def _merge(last: bool):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending"), ("place", "ascending")])
        seam, group, start = Seam(last), table.column("group")[0].as_py(), table.column("shard")[0].as_py()
        for r in table.to_pylist():
            edge = r["edge"] and r["shard"] == start
            seam.add(Open(r["depth"], r["key"], r["parent_key"], r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["size"], r["ends_sha256"], edge))
        open_ = seam.end()
        return pa.Table.from_batches([_batch(seam.closed, open_, group)], _ROWS) if seam.closed or open_ else _ROWS.empty_table()

    return merge


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of a table of (conv_id, turn, role, text)."""
    return prefix_trie(encode_turns(turns))
