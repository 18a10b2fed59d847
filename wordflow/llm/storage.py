"""Shared storage and sizing helpers.

Everything that outlives a task goes through Spark's own writers to the folder
that the session names in ``spark.checkpoint.dir``; no executor-local path is
ever used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from pyspark.sql import DataFrame, SparkSession


#: Paths that this process made, oldest first.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where none is set, a local master gets a temporary folder; a cluster raises, since its
    executors would write to folders that no other sees."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="wordflow-shared-")
        sc.setCheckpointDir(configured)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/wordflow-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def cleanup(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables and archives that this process wrote to the shared folder, from the
    ``since``-th on. Results are read from them lazily, so call it when these are done with."""
    while len(_made) > since:
        remove(spark, _made.pop())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written inside."""
    since = len(_made)
    try:
        yield
    finally:
        cleanup(spark, since)


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a compressed table to shared storage and read it back, cutting lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _murmur(values: np.ndarray) -> np.ndarray:
    """Spark's hash of ints (Murmur3, seed 42)."""
    u = lambda x: np.uint32(x)
    with np.errstate(over="ignore"):
        k = values.astype(np.uint32) * u(0xCC9E2D51)
        k = (k << u(15) | k >> u(17)) * u(0x1B873593)
        h = u(42) ^ k
        h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        return (h ^ h >> u(16)).view(np.int32)


def even_keys(n: int) -> np.ndarray:
    """``n`` ints that hash partitioning deals to ``n`` partitions, one to each."""
    found, at, step = np.full(n, -1, np.int64), 0, max(64, 2 * n)
    while (found < 0).any():
        some = np.arange(at, at + step)
        to = _murmur(some).astype(np.int64) % n
        new = found[to] < 0
        found[to[new]] = some[new]
        at += step
    return found
