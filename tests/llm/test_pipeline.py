"""The pipeline stage by stage against plain Python."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_mixing import water_fill
from test_near_dedup import expected as classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("more", F.lit("x"))
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mix", "shards"] and pipeline.ORACLE_SQL is None
    kept, tables = docs, []
    for name, stage in pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        tables.append(kept)
        assert kept.columns[: len(docs.columns)] == docs.columns, name
    good, single, clean, mixed, shards = tables

    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    known = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in good.collect()}
    assert left & known == known - bad

    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c, _ in classes(rows)})

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from aislemap.llm.common import lower_words

    windows = set()
    for t in items:
        w = lower_words(t.encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows if w}

    def dirty(text):
        w = lower_words(text.encode())
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not dirty(r["text"]))

    size = {r["doc_id"]: len(r["text"].encode().split()) for r in clean.collect()}
    source = {r["doc_id"]: r["source"] for r in clean.collect()}
    totals, taken = Counter(), Counter()
    for d, n in size.items():
        totals[source[d]] += n
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
    assert max(copies.values()) <= 2
    for s, target in water_fill(totals).items():
        assert abs(taken[s] - target) <= max(size.values())

    counts = Counter(r["shard"] for r in shards.collect())
    assert sum(counts.values()) == mixed.count() and max(counts.values()) - min(counts[i] for i in range(40)) <= 1


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert {"doc_id", "text", "source", "shard", "slot"} <= set(out.columns) and out.count() > 0
