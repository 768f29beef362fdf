"""Numbering rows within groups without one task for a group."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='maskwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df in the shared checkpoint folder, which outlives executors. Its files go with the folder, or when Spark's cleaner
    may delete them (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys over as many tasks as a shuffle has, for rows of few bytes that take long: by their bytes alone
    hundreds of thousands of them end in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what numbered() has written within it, for callers who have stored their result by then."""
    mine: list[str] = []
    token = _WRITTEN.set(mine)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for p in mine:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _laid(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskwright-numbers/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the number of each row, from 1, in its group in this order.

    Rows are dealt by ranges of (group, order) and sorted, so a group of any size spreads over tasks. A row's number is
    its place in its partition, less the place where its group begins there, plus the group's rows in the partitions
    before. Only one count for each group and partition meets again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    laid = _laid(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = laid.groupBy(F.col(group).alias("_group"), "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed("_part", "_own")
    joined = laid.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_own", "_at", "_group", "_n", "_first", "_before")
