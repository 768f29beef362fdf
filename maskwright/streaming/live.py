"""Running state of sessions: life and authorisation, step limits, the loop guard, and the ring of latest events.

Each is a processor of transformWithState over one session at a time. Where the order of events decides, events wait in
list state until the watermark has passed them and are then taken in order, so what comes out doesn't depend on the
order in which they came in; what comes later than the watermark allows is left out, as in all event-time state. Timers
on event time take up what waits and drop what has gone unused for its time to live, so a key that falls silent leaves
nothing behind.

The state store must hold state by column families: started() names Spark's own RocksDB provider where the session names
none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed as X

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What every ordered processor is fed: the key, the time, an id that settles ties, and what the event says.
EVENT = "key string, ts timestamp, id string, kind string, flag boolean, note string"
WAITING = "us long, id string, kind string, flag boolean, note string"


class Ordered(StatefulProcessor):
    """Takes the events of a key in order of (time, id) as the watermark passes them. Subclasses keep what they need in
    state and tell what comes of one event."""

    columns: list[str] = []

    def __init__(self, ttl_seconds: int = X.TTL_SECONDS):
        self.ttl_us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.used = handle.getValueState("used", "us long, timer long")
        self.opened()

    def opened(self) -> None:
        """Names further state."""

    def loaded(self):
        """The key's state, None if it has none."""
        raise NotImplementedError

    def stepped(self, state, us: int, id_: str, kind: str, flag: bool, note: str):
        """(state after the event, None if the key's life is over; whether it counts as use; what comes out)."""
        raise NotImplementedError

    def stored(self, state) -> None:
        """Writes the state, or removes it if it is None."""
        raise NotImplementedError

    def _advanced(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = held + new
        now = watermark_ms * 1000
        due, left = sorted(r for r in rows if r[0] <= now), [r for r in rows if r[0] > now]
        if left != held:
            self.waiting.put(left) if left else self.waiting.clear()
        last, timer = self.used.get() if self.used.exists() else (None, None)
        state = self.loaded() if last is not None else None
        out = []
        for us, id_, kind, flag, note in due:
            if last is not None and us - last > self.ttl_us:
                state, last = None, None
            state, use, told = self.stepped(state, us, id_, kind, flag, note)
            out.append((key[0], id_, *told))
            last = None if state is None else us if use else last
        if last is not None and now - last > self.ttl_us:
            state, last = None, None
        if due or last is None:
            self.stored(state)
        ends = [min(r[0] for r in left) // 1000] if left else []
        ends += [(last + self.ttl_us) // 1000 + 1] if last is not None else []
        after = max(min(ends), watermark_ms + 1) if ends else None
        if timer is not None and timer != after and timer > watermark_ms:
            self.handle.deleteTimer(timer)
        if after is not None and after != timer:
            self.handle.registerTimer(after)
        if after is None:
            self.used.clear()
        else:
            self.used.update((last, after))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", *self.columns])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ts.value // 1000), i, k, f, n) for b in rows for ts, i, k, f, n in zip(b.ts, b.id, b.kind, b.flag, b.note, strict=True)]
        yield from self._advanced(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class SessionLife(Ordered):
    """create opens a session with the bearer that `note` names; step and delete must bring it within the time to live of
    the last authorised call. Steps are counted."""

    columns = ["authorised", "step", "limited"]

    def __init__(self, most: int = X.MAX_STEPS_SERVER, ttl_seconds: int = X.TTL_SECONDS):
        super().__init__(ttl_seconds)
        self.most = most

    def opened(self) -> None:
        self.life = self.handle.getValueState("life", "bearer string, steps long")

    def loaded(self):
        return tuple(self.life.get()) if self.life.exists() else None

    def stepped(self, state, us, id_, kind, flag, note):
        if kind == "create":
            return (note, 0), True, (True, 0, False)
        if state is None or note != state[0]:
            return state, False, (False, 0, False)
        if kind == "delete":
            return None, True, (True, 0, False)
        steps = state[1] + 1
        return (state[0], steps), True, (True, steps, steps > self.most)

    def stored(self, state) -> None:
        self.life.update(state) if state is not None else self.life.clear()


class LoopGuard(Ordered):
    """Whether an earlier event of the session with `flag` had the same `kind` (screen and button). Counts go with the
    session's time to live; `note` is handed on."""

    columns = ["clicked", "note"]

    def opened(self) -> None:
        self.clicks = self.handle.getMapState("clicks", "kind string", "n long")

    def loaded(self):
        return {k[0]: v[0] for k, v in self.clicks.iterator()} if self.clicks.exists() else {}

    def stepped(self, state, us, id_, kind, flag, note):
        state = state if state is not None else {}
        seen = state.get(kind, 0)
        if flag:
            state[kind] = seen + 1
        return state, True, (None if not flag else seen > 0, note)

    def stored(self, state) -> None:
        if not state:
            self.clicks.clear()
            return
        known = {k[0]: v[0] for k, v in self.clicks.iterator()} if self.clicks.exists() else {}
        for k in known.keys() - state.keys():
            self.clicks.removeKey((k,))
        for k, n in state.items():
            if known.get(k) != n:
                self.clicks.updateValue((k,), (n,))


class Settling(StatefulProcessor):
    """Runs of changes: one settles after `quiet` ms without a change, `most` ms after its start at the latest. Of a run only
    its start, end and size are kept; what the watermark hasn't passed yet waits."""

    def __init__(self, quiet: int, most: int):
        self.quiet, self.most = quiet, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long")
        self.run = handle.getValueState("run", "first long, settled long, n long, timer long")

    def _advanced(self, key: tuple, new: list[int], now: int) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        times = held + new
        due, left = sorted(t for t in times if t <= now), [t for t in times if t > now]
        if left != held:
            self.waiting.put([(t,) for t in left]) if left else self.waiting.clear()
        first, settled, n, timer = self.run.get() if self.run.exists() else (None, None, 0, None)
        out = []
        for t in due:
            if first is not None and t < settled:
                settled, n = min(t + self.quiet, first + self.most), n + 1
                continue
            if first is not None:
                out.append((str(key[0]), first, settled, n))
            first, settled, n = t, t + min(self.quiet, self.most), 1
        if first is not None and settled <= now:
            out.append((str(key[0]), first, settled, n))
            first, settled, n = None, None, 0
        ends = [t for t in (min(left, default=None), settled) if t is not None]
        after = max(min(ends), now + 1) if ends else None
        if timer is not None and timer != after and timer > now:
            self.handle.deleteTimer(timer)
        if after is not None and after != timer:
            self.handle.registerTimer(after)
        self.run.update((first, settled, n, after)) if after is not None else self.run.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "first_ms", "settled_ms", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, [int(t.value // 1_000_000) for b in rows for t in b.ts], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Ring(StatefulProcessor):
    """The latest events of a key by (time, id), `most` of them, each time that some of them are new."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "us long, id long, note string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        new = [(int(ts.value // 1000), int(i), n) for b in rows for ts, i, n in zip(b.ts, b.id, b.note, strict=True)]
        kept = sorted({*held, *new}, key=lambda r: (r[0], r[1], r[2] or ""))[-self.most :]
        if kept != held:
            self.ring.put(kept)
            yield pd.DataFrame([(key[0], len(kept) - k, *r) for k, r in enumerate(kept)], columns=["key", "place", "us", "id", "note"])

    def close(self) -> None:
        pass


def _fed(events: DataFrame, key: Column, ts: Column, id_: Column, kind: Column, flag: Column, note: Column, watermark: str) -> DataFrame:
    kinds = dict(x.split(" ") for x in EVENT.split(", "))
    rows = events.select(*[c.cast(kinds[n]).alias(n) for n, c in (("key", key), ("ts", ts), ("id", id_), ("kind", kind), ("flag", flag), ("note", note))])
    return rows.where("key is not null and ts is not null").withWatermark("ts", watermark)


def stream_sessions(calls: DataFrame, most: int = X.MAX_STEPS_SERVER, ttl_seconds: int = X.TTL_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """key, id, authorised, step and limited of a stream of calls (session_id, call_id, ts, kind, bearer).

    kind is create, step or delete; the bearer of a create is the one that the session was given. Equal times are taken
    in order of call_id as a string. A call without session or time has none.
    """
    c = F.col
    rows = _fed(calls, c("session_id"), c("ts"), c("call_id"), c("kind"), F.lit(None), c("bearer"), watermark)
    return rows.groupBy("key").transformWithStateInPandas(SessionLife(most, ttl_seconds), "key string, id string, authorised boolean, step long, limited boolean", "Append", "EventTime")


def stream_clicks(clicks: DataFrame, ttl_seconds: int = X.TTL_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """key, id, clicked and note of a stream of requests (session_id, request_id, ts, presses, screen_key, note); clicked
    is null for those that press nothing."""
    c = F.col
    rows = _fed(clicks, c("session_id"), c("ts"), c("request_id"), c("screen_key"), c("presses"), c("note"), watermark)
    return rows.groupBy("key").transformWithStateInPandas(LoopGuard(ttl_seconds), "key string, id string, clicked boolean, note string", "Append", "EventTime")


def stream_ring(events: DataFrame, key: str, ts: str, id_: str, note: str, most: int = 60) -> DataFrame:
    """key, place (1 is the latest), us, id and note: a key's ring, whole, in each batch that changes it."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_).cast("long").alias("id"), F.col(note).cast("string").alias("note"))
    return rows.where("key is not null and ts is not null").groupBy("key").transformWithStateInPandas(Ring(most), "key string, place long, us long, id long, note string", "Update", "None")


def fan_out(spark: SparkSession, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one micro-batch to several folders, each through its function. A batch that runs again, as after a
    failure between two sinks, writes over what it wrote before, so each is there once."""

    def put(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, shaped in sinks.items():
                shaped(kept).write.mode("overwrite").parquet(f"{path}/{name}/epoch={number}")
        finally:
            kept.unpersist()

    return put


def latest_of(rings: DataFrame) -> DataFrame:
    """Of a folder of rings by epoch, each key's ring in the last epoch that has it."""
    last = rings.groupBy("key").agg(F.max("epoch").alias("epoch"))
    return rings.join(last, ["key", "epoch"]).drop("epoch")


def started(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """A query that takes all that there is now and ends."""
    conf = stream.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKSDB)
    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
