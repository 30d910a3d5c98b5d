"""Cutting lineage with tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one under a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="domgraph-"))


def cut(df: DataFrame) -> DataFrame:
    """What df holds, written once and scanned from then on."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row in the order, from 0 on.

    Rows are dealt to ranges of the order and numbered within; what comes before a range is the sum of the counts of those before it,
    one row a range. Rows that tie may change places from one reading to the next, so the numbered rows are written.
    """
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = part.withColumn("_nth", F.monotonically_increasing_id())
    rows = cut(within.withColumns({"_part": F.shiftright("_nth", 33), "_inside": F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_nth"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_inside")).select(*df.columns, name)
