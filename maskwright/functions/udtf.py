"""SQL surface: spans of a text as rows, from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect_patterns


def spans_view(df: DataFrame, name: str, text: str = "text") -> None:
    """Registers a view of df with its spans as an array column, which SQL can explode; the plan stays in the JVM."""
    df.withColumn("pii_spans", detect_patterns(F.col(text))).createOrReplaceTempView(name)


def pii_spans(spark: SparkSession, table: str, key: str, text: str = "text") -> DataFrame:
    """key and the spans of a table or view, a row each, by a lateral explode that Catalyst can see through."""
    spans_view(spark.table(table), f"_{table}_spans", text)
    return spark.sql(f"SELECT t.`{key}`, s.* FROM `_{table}_spans` t LATERAL VIEW inline(t.pii_spans) s AS cls, start, end, value, valid, token, layer")
