"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives the loss of any executor.  The folder
is ``spark.checkpoint.dir``; where that is unset, a folder of our own is set in
local mode (tests), and on a cluster an error is raised.  Everything written is removed when the driver's Python ends;
tables that only one operator reads are dropped as soon as it has read them.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="softlattice-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):
            _delete(spark, path)


class Workspace:
    """A fresh folder of named Parquet tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/softlattice-{name}-{uuid.uuid4().hex}"
        _LEFT.append((spark, self.path))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")


def least(df: DataFrame, key: str, k: int, *more: str) -> DataFrame:
    """The k rows of least hash of `key` (ties by key and `more`), the same ones however df is partitioned.

    A bound on the hash that some more than k rows are expected to meet spares
    each partition from sending k rows of its own; where it lets too few pass
    (keys that repeat much), all rows are asked.
    """
    h, n = F.xxhash64(key), df.count()
    wanted = k + 6 * math.sqrt(k) + 16
    if n > 2 * wanted:
        some = df.where(h <= int(wanted / n * 2.0**64) - (1 << 63))
        df = some if some.count() >= k else df
    return df.orderBy(h, key, *more).limit(k)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Whole texts can be long: keep Arrow batches short so that a Python worker holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release(spark: SparkSession) -> None:
    """Give back what the driver no longer uses: Python's and Arrow's free memory, and the JVM's, with broadcasts and shuffles out of reach."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    spark.sparkContext._jvm.System.gc()
