"""Helpers that all training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_own_dir: list[str] = []
_scratch: list[list[str]] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer partitions than there are cores (a few small files) over all cores.

    Larger tables stay as they are. ``df`` is a plain scan, so counting its partitions runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, local mode takes a temporary folder
    of this machine; on a cluster that would not be shared, so it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="chronoframe-"))
    return f"file://{_own_dir[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before the driver's Python
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those it is told to keep.

    These belong to the scratch around, if there is one. The shuffle files of each query that runs inside go when it ends, not when
    the driver happens to collect its garbage. So what leaves must not read, lazily, what goes.
    """
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    _scratch.append([])
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)
        for path in _scratch.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    Cuts the lineage, so that a lost executor costs no recomputation of what is above. ``keep``: see ``scratch``.
    """
    path = fresh_path(df.sparkSession, name)
    for own in _scratch[-2:-1] if keep else _scratch[-1:]:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python objects at a time.

    A batch has at most ``rows`` rows and ``size`` bytes of strings; a longer row is a batch by itself. At the end of
    a task its freed memory goes back to the system, as the worker stays for tasks of other kinds.
    """
    try:
        yield from _cut(batches, rows, size)
    finally:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def _cut(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
                lengths += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(lengths), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, min(first + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(first, last - first)
            first = last


def broadcast_if_small(df: DataFrame, size: Column, most: int = 16 << 20) -> DataFrame:
    """``df``, a written table, to be broadcast if its rows, of ``size`` bytes each, are ``most`` or less in all."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)
