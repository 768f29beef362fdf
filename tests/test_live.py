import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.plans import api, planner
from maskwright.streaming import live

T0 = dt.datetime(2026, 1, 1)
CALLS = "session_id string, call_id string, ts timestamp, kind string, bearer string"


def calls(n=400, seed=1):
    """Calls of eight sessions, four a minute, in order of time."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = str(rng.choice(["create", "step", "step", "step", "step", "delete"], p=[0.1, 0.2, 0.2, 0.2, 0.2, 0.1]))
        bearer = "x" if rng.random() < 0.2 and kind != "create" else "good"
        rows.append((f"s{rng.integers(0, 8)}", f"{i:04d}", T0 + dt.timedelta(seconds=15 * i + float(rng.random())), kind, bearer))
    return rows


def arrivals(rows, spark, path, schema, per_file=40, late=8, seed=2):
    """Files in which rows come up to `late` places too early or too late."""
    rng = np.random.default_rng(seed)
    order = np.argsort(np.arange(len(rows)) + rng.uniform(-late, late, len(rows)), kind="stable")
    for k in range(0, len(rows), per_file):
        spark.createDataFrame([rows[i] for i in order[k : k + per_file]], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def by_hand(rows, ttl, most):
    state, out = {}, []
    for s, i, ts, kind, bearer in sorted(rows, key=lambda r: (r[2], r[1])):
        if s in state and (ts - state[s][0]).total_seconds() > ttl:
            del state[s]
        if kind == "create":
            state[s] = [ts, bearer, 0]
            out.append((s, i, True, 0, False))
        elif s not in state or state[s][1] != bearer:
            out.append((s, i, False, 0, False))
        elif kind == "delete":
            del state[s]
            out.append((s, i, True, 0, False))
        else:
            state[s] = [ts, bearer, state[s][2] + 1]
            out.append((s, i, True, state[s][2], state[s][2] > most))
    return out


def test_sessions_over_events_out_of_order(spark, tmp_path):
    rows = calls()
    stream = live.stream_sessions(arrivals(rows, spark, str(tmp_path / "in"), CALLS), most=2, ttl_seconds=240, watermark="5 minutes")
    live.started(stream, live.fan_out(spark, {"out": lambda b: b}, str(tmp_path)), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "id", "authorised", "step", "limited").collect())
    passed = max(r[2] for r in rows) - dt.timedelta(minutes=5)
    due = {r[1] for r in rows if r[2] <= passed}
    assert got == sorted(r for r in by_hand(rows, 240, 2) if r[1] in due) and len(got) > 350 and any(r[4] for r in got)


def test_sessions_equal_the_batch(spark, tmp_path):
    rows = calls(120, 5)
    batch = api.live_sessions(spark.createDataFrame(rows, CALLS).withColumn("session_token", F.lit("good"))).select("call_id", "authorised")
    stream = live.stream_sessions(arrivals([*rows, ("end", "z", T0 + dt.timedelta(days=1), "step", "good")], spark, str(tmp_path / "in"), CALLS), watermark="5 minutes")
    live.started(stream, live.fan_out(spark, {"out": lambda b: b}, str(tmp_path)), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "authorised")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_a_query_goes_on_where_it_stopped_and_forgets_what_is_over(spark, tmp_path):
    rows = calls()
    where, cp = str(tmp_path / "in"), str(tmp_path / "cp")

    def run():
        stream = live.stream_sessions(spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(where), most=2, ttl_seconds=240, watermark="5 minutes")
        live.started(stream, live.fan_out(spark, {"out": lambda b: b}, str(tmp_path)), cp).awaitTermination()

    for part in (rows[:150], rows[150:280], rows[280:], [("end", "z", T0 + dt.timedelta(days=1), "step", "good")]):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(where)
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "id", "authorised", "step", "limited").collect())
    assert got == sorted(by_hand(rows, 240, 2))
    left = lambda name, **kw: spark.read.format("statestore").option("path", cp).option("stateVarName", name).options(**kw).load().count()
    assert left("life") == 0 and left("used") == 1 and left("waiting") == 1  # the last call waits for the watermark


def test_clicks_over_events_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "session_id string, request_id string, ts timestamp, presses boolean, screen_key string, note string"
    rows = [(f"s{rng.integers(0, 5)}", f"{i:04d}", T0 + dt.timedelta(seconds=20 * i), bool(rng.random() < 0.7) if i % 50 else None, f"k{rng.integers(0, 4)}", f"n{i}") for i in range(300)]
    want, state = [], {}
    for s, i, ts, presses, k, n in rows:
        if s in state and (ts - state[s][0]).total_seconds() > 300:
            del state[s]
        seen = state.setdefault(s, [ts, Counter()])
        seen[0] = ts
        want.append((s, i, (seen[1][k] > 0) if presses else None, n))
        seen[1][k] += bool(presses)
    end = [("e", "e", T0 + dt.timedelta(days=1), True, "k", "n")]
    stream = live.stream_clicks(arrivals(rows + end, spark, str(tmp_path / "in"), schema), ttl_seconds=300, watermark="10 minutes")
    live.started(stream, live.fan_out(spark, {"out": lambda b: b}, str(tmp_path)), str(tmp_path / "cp")).awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "id", "clicked", "note").collect()), key=str)
    assert got == sorted(want, key=str)
    assert spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "clicks").load().count() == 0


def test_plans_of_a_stream_equal_the_batch(spark, tmp_path):
    element = "array<struct<id:int,role:string,label:string,value:string,field_class:string,required:boolean,disabled:boolean>>"
    schema = f"request_id string, session_id string, step int, ts timestamp, screen struct<path_template:string,elements:{element}>, entities array<struct<token:string,class:string>>"
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        els = [(1, "textbox", "Full name", None if rng.random() < 0.4 else "⟦NAME_1⟧", "NAME", False, False), (3, "button", "Continue", None, None, False, bool(rng.random() < 0.2))]
        els += [(4, "password", None, None, None, True, False)] if rng.random() < 0.2 else []
        rows.append((f"{i:03d}", f"s{i % 4}", i, T0 + dt.timedelta(seconds=i), (f"/p{rng.integers(0, 2)}", els), [("⟦NAME_1⟧", "NAME")]))
    end = [("zzz", "end", 0, T0 + dt.timedelta(hours=1), ("/", []), [])]
    stream = planner.stream_plan(arrivals(rows + end, spark, str(tmp_path / "in"), schema, 20, 5), watermark="1 minute")
    live.started(stream, live.fan_out(spark, {"out": lambda b: b}, str(tmp_path)), str(tmp_path / "cp")).awaitTermination()
    told = lambda df: sorted((r.request_id, r.step, str(r.actions), r.rationale, r.done) for r in df.collect())
    got = told(spark.read.parquet(str(tmp_path / "out")))
    assert got == told(planner.plan(spark.createDataFrame(rows, schema))) and any(r[4] for r in got)


def test_ring_and_fan_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"k{rng.integers(0, 4)}", T0 + dt.timedelta(seconds=int(t)), int(i), f"n{i}") for i, t in enumerate(rng.integers(0, 90, 300))]
    events = arrivals(rows, spark, str(tmp_path / "in"), "k string, ts timestamp, i long, note string", 60, 200)
    stream = live.stream_ring(events, "k", "ts", "i", "note", most=10)
    sinks = {"rings": lambda b: b, "sizes": lambda b: b.groupBy("key").agg(F.count(F.lit(1)).alias("n"))}
    live.started(stream, live.fan_out(spark, sinks, str(tmp_path)), str(tmp_path / "cp"), "update").awaitTermination()
    got = live.latest_of(spark.read.parquet(str(tmp_path / "rings")))
    want = [(k, p + 1, i) for k in sorted({r[0] for r in rows}) for p, (_, i) in enumerate(sorted(((r[1], r[2]) for r in rows if r[0] == k), reverse=True)[:10])]
    assert sorted((r.key, r.place, r.id) for r in got.collect()) == want
    assert {r.n for r in live.latest_of(spark.read.parquet(str(tmp_path / "sizes"))).collect()} == {10}


def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path):
    batch, broken = spark.range(5).select(F.col("id")), []

    def fails_once(b):
        if not broken:
            broken.append(1)
            raise RuntimeError("sink is away")
        return b

    put = live.fan_out(spark, {"a": lambda b: b, "b": fails_once}, str(tmp_path))
    with pytest.raises(RuntimeError):
        put(batch, 3)
    put(batch, 3)
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in "ab"] == [5, 5]
