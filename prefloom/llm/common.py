"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefloom.session import scratch_path

_HELD: dict = {}


def held(key, make):
    """State that a Python worker keeps from task to task (a tokenizer, tables): made once,
    and dropped when another operator's tasks ask the same worker for theirs."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def released() -> None:
    """Return the process's free memory to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run`` (a generator function over Arrow batches) that returns its task's free memory to
    the machine at its end: Python workers outlive their tasks, and what they keep adds up."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            released()

    return wrapped


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: a stage boundary that survives
    lost executors and fixes whatever was not deterministic in the plan below it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority by which Spark reads and writes it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def root_buckets(n: int) -> int:
    """Buckets for a two-level ordinal: about sqrt(n) buckets of sqrt(n) rows, so neither
    the rows of one bucket nor the list of buckets grows in proportion to the input."""
    return isqrt(max(0, n)) + 1


def two_level_rank(df: DataFrame, by: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Gapless 0-based rank of each row within ``by``: row numbers inside (by, bucket) plus a
    running sum over the bucket counts. No task ever sorts a whole ``by`` group."""
    keys = [*by, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(inside))
        .join(base, keys)
        .withColumn(out, F.col("_base") + F.col("_r") - 1)
        .drop("_r", "_base")
    )
