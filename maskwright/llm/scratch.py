"""Tables written to the shared folder of the cluster, to cut lineage where executors may be lost."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on this machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='maskwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again; and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffles_released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to any more. A session refers to its last
    query until it runs another one, so it runs one of a row."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleared(spark: SparkSession) -> None:
    """Deletes all written tables, once no frame that reads them is needed any more."""
    dropped(spark, f"{shared_dir(spark)}/maskwright")
