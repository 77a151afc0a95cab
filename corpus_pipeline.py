"""A corpus pipeline: quality, near-duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislemap.llm.common import documents
from aislemap.llm.decontaminate import decontaminate
from aislemap.llm.mixing import mixed_documents
from aislemap.llm.near_dedup import without_near_duplicates
from aislemap.llm.quality import fit_quality, score_quality
from aislemap.llm.sharding import interleave
from aislemap.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learnt from the labelled ones among them, accepts."""
    rules = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return score_quality(docs, rules).where("predicted = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return without_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    found = decontaminate(docs, documents(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that every source comes to its target."""
    return mixed_documents(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return interleave(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mix", mix_sources),
    ("shards", to_shards),
]

# The fitted and sampled stages have no SQL form; the tests repeat them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each written before the next reads it."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
