"""Intermediate tables in the shared folder, and joins that know the size of what they broadcast."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.session import shared_dir

#: A stored table of at most so many bytes (Parquet) may be sent to every executor.
BROADCAST_BYTES = 4 << 20
#: Bytes (Parquet) of a table for each task that works on it.
PART_BYTES = 4 << 20


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    parts: files to write at most, where the caller knows the size; the last step then runs in as many tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(table: DataFrame, size: int = PART_BYTES) -> int:
    """Tasks for work on a stored table and what is derived from it: one for ``size`` bytes, one for each core at least."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(table) // size))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a stored table, by the file system that holds it."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast of a stored table, but only if its files are within ``limit``."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def give_back() -> None:
    """Return freed memory to the system, Arrow's and, where the C library can, the rest: Python workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, inside one row."""
    return F.transform(F.array(value), body)[0]
