"""Sessions over events: sliding time to live, step limits, settling. Each as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as X
from .live import Settling, started


def ttl_sessions(events: DataFrame, key: str, ts: str, ttl: str = "15 minutes", watermark: str | None = None) -> DataFrame:
    """One row for each session of a key: start, last event and number of events. A session ends when more than the
    time to live passes without an event; an event exactly that late still belongs to it. With a watermark, for streams."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    grouped = rows.groupBy(F.session_window(ts, ttl).alias("w"), key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n_events"))
    return grouped.select(key, "first_seen", "last_seen", "n_events")


def step_limited(events: DataFrame, key: str, ts: str, tie: str, most: int = X.MAX_STEPS_SERVER, ttl_seconds: int = X.TTL_SECONDS) -> DataFrame:
    """events with `session_no`, `step` (from 1 in each session) and `limited` (whether it is over the limit)."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(order).cast("timestamp").cast("double")
    rows = events.withColumn("session_no", F.sum(F.when(gap > ttl_seconds, 1).otherwise(0)).over(order) + 1)
    step = F.row_number().over(Window.partitionBy(key, "session_no").orderBy(ts, tie))
    return rows.withColumn("step", step).withColumn("limited", F.col("step") > most)


STATE = "steps long, last double"
STEPS = "key string, ts timestamp, step long, limited boolean"


def stream_step_limits(events: DataFrame, key: str, ts: str, most: int = X.MAX_STEPS_SERVER, ttl_seconds: int = X.TTL_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """A stream of events with their step in the session and whether it is over the limit: counters as keyed state,
    which goes when the time to live has passed."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        steps, last = state.get if state.exists else (0, float("-inf"))
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for t in rows["ts"]:
            at = t.timestamp()
            steps = 1 if at - last > ttl_seconds else steps + 1
            last = max(last, at)
            out.append((k[0], t, steps, steps > most))
        state.update((steps, last))
        state.setTimeoutTimestamp(int(max(last * 1000, state.getCurrentWatermarkMs()) + ttl_seconds * 1000 + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "step", "limited"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(run, STEPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


SETTLED = "key string, first_ms long, settled_ms long, n long"


def settle_groups(times: list[int], quiet: int = 300, most: int = 3000) -> list[tuple[int, int, int]]:
    """(first, settled, n) of runs of changes: a run settles after `quiet` ms without one, `most` ms after its start at
    the latest."""
    out: list[list[int]] = []
    for t in sorted(times):
        if out and t < out[-1][1]:
            out[-1][2] += 1
            out[-1][1] = min(t + quiet, out[-1][0] + most)
        else:
            out.append([t, t + min(quiet, most), 1])
    return [(a, b, n) for a, b, n in out]


def settled(changes: DataFrame, key: str, ms: str, quiet: int = 300, most: int = 3000) -> DataFrame:
    """key, first_ms, settled_ms and n of each run of changes. Where a run ends depends on where it began, so each
    key's times are folded in order, in one pass over sorted partitions that holds one run at a time. A gap of `quiet` always
    ends a run, so a key is dealt to many tasks wherever it has one."""
    order = Window.partitionBy(key).orderBy(ms)
    gap = F.coalesce(F.col(ms) - F.lag(ms).over(order) >= min(quiet, most), F.lit(True))
    parts = changes.withColumn("_run", F.sum(gap.cast("int")).over(order)).select(F.col(key).cast("string").alias("key"), F.col(ms).cast("long").alias("ms"), "_run")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None  # key, part, first, settled, n
        for b in batches:
            out = []
            for k, part, t in zip(b["key"], b["_run"], b["ms"], strict=True):
                if run and run[:2] == [k, part] and t < run[3]:
                    run[3], run[4] = min(t + quiet, run[2] + most), run[4] + 1
                else:
                    if run:
                        out.append((run[0], *run[2:]))
                    run = [k, part, t, t + min(quiet, most), 1]
            yield pd.DataFrame(out, columns=["key", "first_ms", "settled_ms", "n"])
        if run:
            yield pd.DataFrame([(run[0], *run[2:])], columns=["key", "first_ms", "settled_ms", "n"])

    return parts.repartition("key", "_run").sortWithinPartitions("key", "_run", "ms").mapInPandas(fold, SETTLED)


def stream_settled(changes: DataFrame, key: str, ts: str, quiet: int = 300, most: int = 3000, watermark: str = "1 minute") -> DataFrame:
    """settled() over a stream of changes: a run is told once the watermark has passed the time at which it settles. What
    comes later than the watermark allows is left out, as in all event-time state."""
    rows = changes.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null").withWatermark("ts", watermark)
    return rows.groupBy("key").transformWithStateInPandas(Settling(quiet, most), SETTLED, "Append", "EventTime")


def latest_log(events: DataFrame, key: str, order: list[str], most: int = 60) -> DataFrame:
    """The last events of each key, the ring that a panel shows."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def expired(last_seen: Column, now: Column) -> Column:
    return now - last_seen > F.expr(f"INTERVAL {X.TTL_SECONDS} SECONDS")


def to_sink(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's batches to a folder, each batch once."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return started(stream, put, checkpoint)
