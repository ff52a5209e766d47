"""How much one task holds: shuffles that are dealt out by the size of their input, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an input, as Spark estimates them from its files and columns, that go to one task. Sorted rows take some twenty times as much.
TASK_BYTES = 4 << 20
#: Estimates beyond this are Spark's word for not knowing.
UNKNOWN = 1 << 50


def dealt_by_size(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, all of them, dealt out by keys to so many tasks that each gets about TASK_BYTES of the input, however large it is.

    The session's number of shuffle partitions is fixed, and what a task sorts then grows with the input. Inputs that
    give no more tasks than the cluster has cores are left to Spark. Later operators on the same keys need no shuffle.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // TASK_BYTES)
    if size > UNKNOWN or n <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(n, *keys)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the bytes of the session's Arrow batches, if they are more: each running task holds several of them, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= most:
        spark.conf.set(name, str(most))


def release() -> None:
    """Gives what a task's Arrow batches and arrays took back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
