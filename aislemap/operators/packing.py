"""Rows of a block as one row: vectors as the bytes of their numbers, so that blocks can meet in Arrow functions without being unpacked on the way."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aislemap.session import materialise


# Packed rows are large. Arrow batches of the default 64 MB of them crashed the JVM while its output buffer grew.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table, with packed rows sent to its Arrow functions in small batches."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_KEY)
    conf.set(BATCH_KEY, BATCH_BYTES)
    try:
        return materialise(df)
    finally:
        conf.set(BATCH_KEY, before)


def pack(df: DataFrame, key: str, vec: str, order: str | None = None) -> DataFrame:
    """One row per ``key``, written: the bytes of its vectors as doubles, and a list of every other column in the same order, sorted by ``order`` if given."""
    others = [c for c in df.columns if c not in (key, vec)]

    def one(table: pa.Table) -> pa.Table:
        n, table = table.num_rows, table.sort_by(order) if order else table
        x = table.column(vec).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(c).combine_chunks()) for c in others]
        return pa.table([table.column(key)[:1], pa.array([x.tobytes()], pa.binary()), *lists], names=[key, vec, *others])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"{key} {types[key]}", f"{vec} binary", *[f"{c} array<{types[c]}>" for c in others]])
    return written(df.select(key, vec, *others).groupBy(key).applyInArrow(one, schema))


def meeting(left: DataFrame, right: DataFrame, on=None) -> DataFrame:
    """All pairs of packed rows, or those for which ``on`` holds. Both sides are read where they meet: nothing is shuffled.

    A task has one part of each side; it meets a row of the left with all its rows of the right, then the next.
    """
    side = left.hint("shuffle_replicate_nl")
    return side.crossJoin(right) if on is None else side.join(right, on)


def numbers(column: pa.Array, row: int) -> np.ndarray:
    """The values of a list in a column."""
    return column[row].values.to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, row: int, n: int) -> np.ndarray:
    """The ``n`` vectors of a packed row."""
    return np.frombuffer(column[row].as_buffer()).reshape(n, -1)
