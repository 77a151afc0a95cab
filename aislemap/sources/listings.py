"""Readers and writers for listings, labels, summaries, vectors and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REQUIRED_FIELDS = ("title", "division", "subcategory", "description", "price", "seller")


class MissingResult(FileNotFoundError):
    """A method has no stored result under the given path."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def read_listings(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Listing CSV with a header and quoted multi-line text, plus a ``listing_id``.

    Columns are matched by header name: the header row decides which columns exist,
    so a file without ``subcategory`` or with extra columns reads correctly. All
    columns are text. A ``listing_id`` in the file is kept. Otherwise rows are
    numbered in the order of the scan, unique but not consecutive; write the table once
    (``write_listings``) before using such an id as a join key.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", True).option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    given = F.col("listing_id").cast("bigint") if "listing_id" in df.columns else F.monotonically_increasing_id()
    return df.withColumn("listing_id", given)


def write_listings(df: DataFrame, path: str) -> None:
    """Persist cleaned listings."""
    df.write.mode("overwrite").parquet(path)


def write_assignments(df: DataFrame, path: str) -> None:
    """Persist labels, one folder per method when there is a ``method`` column."""
    writer = df.write.mode("overwrite")
    if "method" in df.columns:
        writer = writer.partitionBy("method")
    writer.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Persist one nested record per cluster as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_assignments(spark: SparkSession, labels: str, summary: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A method's labelled listings and, if given, its cluster summary."""
    for path in filter(None, (labels, summary)):
        if not _exists(spark, path):
            raise MissingResult(f"no stored result at {path}")
    summary_df = spark.read.json(summary) if summary else None
    return spark.read.parquet(labels), summary_df


def write_vectors(df: DataFrame, path: str, id_col: str = "listing_id", vec_col: str = "vec") -> None:
    """Persist vectors keyed by listing id."""
    df.select(id_col, vec_col).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise MissingResult(f"no stored vectors at {path}")
    return spark.read.parquet(path)


def attach_vectors(listings: DataFrame, vectors: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """Pair saved vectors with listings by id."""
    return listings.join(vectors, id_col)


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a table with one row per method (or per method and metric) as one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
