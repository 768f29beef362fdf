"""How long the stages of a job took, and what passed through them, measured while they ran."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .ranking import durable

STAGE = "stage string, place int, ms double, n_rows long, metrics map<string,long>"


class Timings:
    """Stages in the order in which they ran. A stage ends where its result is written, so its time is its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages = spark, []

    def stage(self, name: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """df, written; its time, rows and the given aggregates, observed on the very run that writes it, are kept."""
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.cast("long").alias(k) for k, c in metrics.items()])
        began = time.perf_counter()
        done = durable(watched)
        took = (time.perf_counter() - began) * 1000
        got = dict(seen.get)
        self.stages.append((name, len(self.stages), took, got.pop("n_rows"), {k: v if v is not None else 0 for k, v in got.items()}))
        return done

    def table(self) -> DataFrame:
        """stage, place, ms, n_rows and metrics of each stage; place tells the order."""
        return self.spark.createDataFrame(self.stages, STAGE)

    def total_ms(self) -> float:
        return sum(s[2] for s in self.stages)


def vision_metrics() -> dict[str, Column]:
    """What to observe of vision results (ok, faces, codes, lines): images read, what they hold, and images masked whole."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return {"images": F.count_if(ok), **{c: F.sum(F.when(ok, F.size(c)).otherwise(0)) for c in ("faces", "codes", "lines")}, "whole": F.count_if(~ok)}
