"""The prefix trie against plain Python, with blocks and merges small enough to meet every seam."""

import hashlib
import random
import zlib

import pytest

from aislemap.llm import conversation_trie as ct


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", (text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}

    def below(p):
        yield p
        for q in kids[p]:
            yield from below(q)

    rows = set()
    for p, members in nodes.items():
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below(p))
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        rows.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def table(n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 3:
            continue  # some blocks have no first conversation
        turns = rng.choice([0, 1, 1, 2, 3, 5, 9, 14])
        for t in range(turns):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello é", "x" * 70, "z" * rng.randrange(4)])))
    hot = [(t, "user", f"again {t}") for t in range(4)]
    rows += [(c, *t) for c in range(1000, 1000 + n, 5) for t in hot]
    rows += [(2000, t, "user", "deep" + str(t % 3)) for t in range(120)] + [(2005, t, "user", "deep" + str(t % 3)) for t in range(110)]
    rows += [(5, None, "user", None), (7, None, None, "no role"), (None, 1, "user", "no conversation"), (8, 3, None, None), (rows[0])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as n", "'x' as key").repartition(5)


@pytest.mark.parametrize("block,fan_in,cell,parts", [(1 << 19, 64, 1024, 4), (7, 2, 3, 13), (1, 3, 1, 9)])
def test_trie_is_exact(spark, monkeypatch, block, fan_in, cell, parts):
    for name, value in (("BLOCK_TURNS", block), ("FAN_IN", fan_in), ("CELL", cell)):
        monkeypatch.setattr(ct, name, value)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = table()
        got = ct.prefix_trie(ct.rebuild(ct.encode_turns(frame(spark, rows)))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(rebuilt(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_turnless_and_empty(spark):
    # 3 borrows from an absent conversation 0 more turns than it has
    rows = [(c, 0, "user", "only") for c in (3, 8, 13)]
    got = {tuple(r) for r in ct.prefix_trie(ct.rebuild(ct.encode_turns(frame(spark, rows)))).collect()}
    assert got == brute(rebuilt(rows)) and any(r[1] == 0 and r[3] == 3 for r in got)
    assert ct.conversation_trie(frame(spark, [])).count() == 0
    assert {(r["conv_id"], r["depth"], r["n_convs"]) for r in ct.conversation_trie(frame(spark, rows)).collect()} == {(3, 0, 3), (3, 1, 3)}


def test_medians_keep_a_level_flat():
    tree = ct.TernaryTree()
    tree.insert_sorted([([i], [1], 1, i, "") for i in range(1000)])
    depth, deepest, stack = 0, 0, [(tree.equal[0], 1)]
    while stack:
        node, depth = stack.pop()
        if node:
            deepest = max(deepest, depth)
            stack += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest <= 11 and [tree.number[v] for v, _, d in tree.walk() if d] == list(range(1000))
