"""Tables written to the shared folder, which cut lineage and outlive executors.

What a query writes is in one folder (``folder``), which goes when the JVM ends or, once its
result has been read, by ``done``.
"""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FOLDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on a local master (tests), one of our own."""
    conf = spark.sparkContext.getConf()
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh folder, in which tables are written until the context ends."""
    path = new_path(spark, name)
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)


def done(df: DataFrame) -> None:
    """Drop all that a query of ``queries`` has written for a result that nothing will read again."""
    drop(df.sparkSession, df.stored_in)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that is open or in the shared one, removed when the session's JVM ends."""
    path = f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a table of the shared folder, partitioned by some columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """``df`` as a table of the shared folder, bucketed and sorted by a column: what then meets by it needs no shuffle."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"tessera_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).sortBy(by).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Drop a table of ``written`` that nothing will read again."""
    drop(df.sparkSession, df.stored_at)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are written.

    It does when the driver collects garbage: first what refers to them, then their own.
    """
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
