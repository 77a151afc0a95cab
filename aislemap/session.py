"""Session helpers: building a session and cutting lineage in iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one submitted."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("aislemap")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as set in ``spark.checkpoint.dir``.

    A temporary folder is only acceptable where driver and executors are one
    process, so on a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="aislemap-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


# The shuffle files behind a written table are of no more use; without this they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there.

    Unlike a checkpointed plan, the table carries no constraints or estimates of
    the plan that made it, so loops keep short plans and joins see real sizes.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Up to this many cells (rows times numbers or short texts per row) a join side is
# copied to every executor; beyond it the join shuffles and AQE splits hot keys.
BROADCAST_CELLS = 4_000_000


def small_side(df: DataFrame, cells_per_row: int = 1) -> DataFrame:
    """Compute a lookup side once and broadcast it only if its counted size allows."""
    df = materialise(df)
    return F.broadcast(df) if df.count() * cells_per_row <= BROADCAST_CELLS else df


# Inputs with less than this per core come in too few splits for costly row functions.
SPLIT_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before costly row-wise work; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


# Rows that stay in memory are dealt into parts of about this size.
PART_BYTES = 64 << 20


def dealt(df: DataFrame, size: int, key: str) -> DataFrame:
    """Deal rows that take ``size`` bytes in memory by ``key``, so that no task gets more for larger inputs; small ones stay as they are."""
    if size <= df.sparkSession.sparkContext.defaultParallelism * PART_BYTES:
        return df
    return df.repartition(-(-int(size) // PART_BYTES), key)
