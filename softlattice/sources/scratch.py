"""A folder for files that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _cleanup() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, removed when Python ends; without one, in local mode only, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="softlattice-")
    path = f"{root.rstrip('/')}/softlattice-{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path
