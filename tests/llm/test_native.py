"""Exact dedup, shards, license scan and decontamination on odd rows, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from aislemap.llm.decontaminate import decontaminate
from aislemap.llm.exact_dedup import exact_dedup, heavy_hashes, kept_documents
from aislemap.llm.license_scan import scan_licenses
from aislemap.llm.sharding import interleave

SPACE = re.compile("[\x20\x09-\x0d]")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_exact_dedup(spark, make):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", " a\tb ", "c", "é", "é", " ", ""]) if rng.random() < 0.5 else f"own {i}") for i in range(300)]
    rows += [(900 + i, "hot text" + " " * (i % 7)) for i in range(400)] + [(2000, None), (None, "a b"), (None, None), (3, "x" * 100000)] + [rows[0], rows[1], rows[1]]
    docs = make(rows).withColumn("hash", F.lit(1)).withColumn("row", F.lit(2)).withColumn("digest", F.lit("x"))
    out = exact_dedup(docs.repartition(5), share=20).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d if d is not None else 0))
    want = Counter()
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for m in members:
            want[(None if m[1] else m[2], keep, len(members), sha)] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup(make([])).count() == 0
    assert kept_documents(make([(1, "a"), (2, " a"), (3, "b")])).orderBy("doc_id").select("doc_id").collect() == [(2,), (3,)]


def test_heavy_hashes_miss_nothing(spark):
    df = spark.range(50000).select(F.when(F.col("id") % 5 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(-2)).otherwise(F.col("id")).alias("hash"))
    found = {r["hash"] for r in heavy_hashes(df.repartition(40), 100).collect()}
    assert {-1, -2} <= found and len(found) <= 200


def test_shards(make):
    rng = random.Random(2)
    rows = [(i, f"t{i}", rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(2003)] + [(None, "x", "a"), (4, "t4", "hot"), (4, "other", "a")]
    docs = make(rows)
    out = interleave(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted((str(d), t) for d, t, _ in rows)
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r)
    sizes = [len(per[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(per) == set(range(40))
    share = Counter(r[2] for r in rows)
    for members in per.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        for s, n in share.items():
            assert abs(sum(r["source"] == s for r in members) - n / 40) <= 2
    place = lambda rows: sorted((str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in rows)
    assert place(out) == place(interleave(docs.repartition(9)).collect())
    few = interleave(make([(1, "a", "x"), (2, None, None)]).withColumn("shard", F.lit("old")), shards=5).collect()
    assert len({r["shard"] for r in few}) == 2 and all(r["slot"] == 0 for r in few)
    assert interleave(make([])).count() == 0


def test_shards_of_tiny_sources(make):
    # sources of one row all have the fractional rank 0.5, those of two rows 0.25 and 0.75
    rows = [(i, f"t{i}", f"one {i:04d}") for i in range(1500)] + [(5000 + i, f"u{i}", f"two {i // 2:04d}") for i in range(400)] + [(9000, "n", None)] * 3
    out = interleave(make(rows)).collect()
    hashed = lambda i: int(hashlib.md5(f"shards|{i}".encode()).hexdigest()[:15], 16)
    sources = defaultdict(list)
    for i, _, s in rows:
        sources[s].append((hashed(i), i))
    order = sorted(((k + 0.5) / len(m), s is None, s or "", i) for s, m in sources.items() for k, (_, i) in enumerate(sorted(m)))
    want = Counter()
    for at, (_, _, _, i) in enumerate(order):
        shard = at * 40 // len(rows)
        want[(i, shard, at - (shard * len(rows) + 39) // 40)] += 1
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out) == want


def test_license_scan(make):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rng = random.Random(3)
    word = lambda: rng.choice("under the mit license apache version 2 cc by nc CC-BY-NC Under x é2 license,".split())
    rows = [(i, rng.choice([" ", "\n", ", "]).join(word() for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (None, "cc by nc"), (902, "cc"), (903, "cc by nc " * 3000), rows[7], (904, "Kelvin CC BY NC")]
    notice = "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and its associated documentation files (the Software), to deal in the Software without any restriction"
    rows.append((905, "start " + notice))
    out = scan_licenses(make(rows).withColumn("template", F.lit(1))).collect()
    want = Counter()
    for d, t in rows:
        w = terms(t)
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in phrases}
        starts = [i for p in at for i in at[p]]
        base = ",".join(sorted({phrases[p] for p in at if at[p]}))
        want[(d, len(w), len(starts), min(starts, default=None), max(starts, default=None), base)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == want
    for r in out:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    worn = next(r for r in out if r["doc_id"] == 905)
    assert worn["labels"] == "mit" and worn["n_base"] == 0 and 0.6 <= worn["score"] < 1
    assert scan_licenses(make([])).count() == 0


def test_decontamination(spark, make, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("a b c dd ee Ff 9 é".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 11, 25])))) for i in range(30)] + [(None, "q r s"), (40, None), (3, "q r s")]
    items = [i for i in items if len(terms(i[1])) not in (1,)]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "x Q-R.s y"), rows[3], (902, "é " + " ".join(word() for _ in range(20000)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = terms(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = Counter()
    for d, t in rows:
        w, hit, names = terms(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[x]
        want[(d, len(w), len(hit), tuple(sorted(names)))] += 1
    docs = make(rows).withColumn("items", F.lit("clash"))

    def got(df):
        return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())

    one = decontaminate(docs, bench)
    assert got(one) == want
    for r in one.where("n_hit > 0").collect():
        spans = [r["text"][c["first"] : c["last"] + 1] for c in r["chars"]]
        assert [terms(s) for s in spans] == [terms(r["text"])[x["first"] : x["last"] + 1] for x in r["words"]]
    monkeypatch.setattr("aislemap.llm.decontaminate.BLOCK_CHARS", 400)
    assert got(decontaminate(docs, bench)) == want
    assert not any(r["contaminated"] for r in decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate(make([]), bench).count() == 0


def test_crc_of_the_shard_query(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op1_interleaved_shards"](spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 16 for r in rows)
