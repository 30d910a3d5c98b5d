"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one for local masters only."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = _OWN.get(spark.sparkContext.applicationId)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return own


_OWN: dict[str, str] = {}
_ROWS_IN_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def new_path(spark: SparkSession, label: str) -> str:
    """A path no one has used, removed when the driver ends."""
    path = f"{base_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get whole texts so many rows at a time, not ten thousand, while what is inside runs: less memory, and what
    they hold stays in the processor's cache. Spark bounds the bytes of a batch as well. The session's setting is put back."""
    before = spark.conf.get(_ROWS_IN_BATCH)
    spark.conf.set(_ROWS_IN_BATCH, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_IN_BATCH, before)


def table(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write df once and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def drop(written: DataFrame) -> None:
    """Delete what `table` wrote, once nothing reads it any more."""
    remove(written.sparkSession, written.scratch_path)
