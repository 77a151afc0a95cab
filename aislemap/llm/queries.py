"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislemap.llm import sql
from aislemap.llm.class_lm import class_lm
from aislemap.llm.collocations import BEST, LEAST_COUNT, LONGEST, PERCENT, collocations
from aislemap.llm.common import documents
from aislemap.llm.conversation_trie import encode_turns, prefix_trie, rebuild
from aislemap.llm.decontaminate import WINDOW as ITEM_WINDOW, decontaminate
from aislemap.llm.exact_dedup import exact_dedup
from aislemap.llm.html_extract import extract_text, fit_extractor
from aislemap.llm.license_scan import BASE, COVERAGE, NEAR, NOTICES, scan_licenses
from aislemap.llm.mixing import count_words, mix
from aislemap.llm.near_dedup import near_duplicates
from aislemap.llm.quality import quality
from aislemap.llm.repeats import repeated_spans
from aislemap.llm.sharding import SEED, SHARDS, interleave
from aislemap.llm.toxicity import toxicity
from aislemap.session import materialise

QUERIES: dict[str, tuple] = {}


def query(name: str, twin: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, twin)
        return fn

    return register


@query("op1_interleaved_shards", sql.sharding(SHARDS, SEED))
def op1_interleaved_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = interleave(materialise(docs))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_repeated_spans")
def op2_repeated_spans(spark, sf_dir):
    return repeated_spans(documents(spark, sf_dir))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    scored = toxicity(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op4_license_scan", sql.license_scan(BASE, NOTICES, NEAR, COVERAGE))
def op4_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


@query("op5_near_duplicates")
def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


@query("op6_source_mix")
def op6_source_mix(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", count_words("text").alias("size"))
    mixed = mix(materialise(docs), size="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_benchmark_decontamination", sql.decontamination(ITEM_WINDOW))
def op7_benchmark_decontamination(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate(docs, documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_main_text")
def op8_main_text(spark, sf_dir):
    pages = documents(spark, sf_dir, "pages")
    text = extract_text(pages.select("page_id", "url", "html"), fit_extractor(pages))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    scored = quality(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op10_exact_dedup", sql.EXACT_DEDUP)
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


@query("op11_class_lm")
def op11_class_lm(spark, sf_dir):
    return class_lm(documents(spark, sf_dir))


@query("op12_collocations", sql.collocations(LONGEST, LEAST_COUNT, BEST, PERCENT))
def op12_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


@query("op13_conversation_trie", sql.CONVERSATION_TRIE)
def op13_conversation_trie(spark, sf_dir):
    return prefix_trie(rebuild(encode_turns(documents(spark, sf_dir, "conversations"))))
