"""Helpers shared by the training-data operators: range buckets, Arrow mapping."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..storage import drop, drop_at_exit, shared_dir, stored

__all__ = ["drop", "drop_at_exit", "lean", "partitions", "prepare", "range_bounds", "row_of", "shared_dir", "stored", "text_of"]

#: Buckets of a range at most, whatever the number of rows.
MAX_BUCKETS = 20_000


def prepare(spark: SparkSession) -> None:
    """Executors can import the package; Arrow batches are small, as rows hold whole texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def lean(fn):
    """A mapper of batches that gives freed memory back when it ends: workers live on for other stages."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: memory is kept for reuse

    return run


def range_bounds(df: DataFrame, column: str, rows_per_bucket: int, most: int = MAX_BUCKETS) -> np.ndarray:
    """Upper bounds that cut a numeric column into buckets of about so many rows, or into `most` larger ones: one number a bucket
    reaches the driver and is sent to tasks, so that neither grows beyond `most` numbers."""
    n = df.agg(F.count(column)).first()[0]
    buckets = min(most, -(-n // rows_per_bucket))
    if buckets < 2:
        return np.array([], dtype=np.int64)
    cuts = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(column, cuts, max(10_000, 20 * buckets))).first()[0]
    return np.unique(np.array(got, dtype=np.int64))


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, which no other column's name can clash with."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])
