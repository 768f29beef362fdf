import pytest
from pyspark.sql import functions as F

from maskwright.operators.timing import Timings, vision_metrics
from maskwright.sources import wire


def test_stages_are_timed_and_counted_as_they_run(spark):
    t = Timings(spark)
    a = t.stage("first", spark.range(100), odd=F.count_if(F.col("id") % 2 == 1), top=F.max("id"))
    b = t.stage("second", a.where("id > 90"), top=F.max("id"))
    t.stage("none", b.where("id < 0"), top=F.max("id"))
    got = t.table().orderBy("place").collect()
    assert [(r.stage, r.n_rows, r.metrics) for r in got] == [("first", 100, {"odd": 50, "top": 99}), ("second", 9, {"top": 99}), ("none", 0, {"top": 0})]
    assert all(r.ms > 0 for r in got) and t.total_ms() == pytest.approx(sum(r.ms for r in got)) and b.count() == 9


def test_a_slow_stage_takes_its_own_time(spark):
    slow = F.udf(lambda x: __import__("time").sleep(1.0) or x, "long")
    t = Timings(spark)
    t.stage("quick", spark.range(1))
    t.stage("slow", spark.range(1).select(slow("id").alias("id")))
    t.stage("quick again", spark.range(1))
    assert t.stages[1][2] >= 1000 > t.stages[2][2]


def test_vision_is_counted(spark):
    rows = [("s", "a", True, [[1.0]], [], [], None), ("s", "b", False, [[1.0]], [[1.0]], [], "x"), ("s", "c", None, None, None, None, None), ("s", "d", True, [[1.0], [2.0]], [[1.0]], [("t", [1.0], [])], None)]
    t = Timings(spark)
    t.stage("seen", spark.createDataFrame(rows, wire.VISION), **vision_metrics())
    assert t.stages[0][4] == {"images": 2, "faces": 3, "codes": 1, "lines": 1, "whole": 2}
