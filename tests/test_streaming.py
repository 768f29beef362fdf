import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskwright.streaming import sessions as S
from maskwright.streaming import vaults

T0 = dt.datetime(2026, 1, 1)


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_ttl_is_inclusive(spark):
    e = spark.createDataFrame([("a", at(0)), ("a", at(900)), ("a", at(1801)), ("b", at(5))], "k string, ts timestamp")
    got = sorted((r.k, r.n_events) for r in S.ttl_sessions(e, "k", "ts").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i * 10) for i in range(30)] + [("a", 290 + 901), ("b", 0), ("b", 901)]
    e = spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(rows)], "k string, ts timestamp, i int")
    batch = sorted((r.k, r.ts, r.step, r.limited) for r in S.step_limited(e, "k", "ts", "i").collect())
    e.select("k", "ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.stream_step_limits(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "k", "ts")
    S.to_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.key, r.ts, r.step, r.limited) for r in spark.read.parquet(str(tmp_path / "out")).drop("epoch").collect())
    assert got == batch and sum(r[3] for r in got) == 5


def test_settling():
    assert S.settle_groups([0, 100, 350]) == [(0, 650, 3)]
    assert S.settle_groups([0, 300]) == [(0, 300, 1), (300, 600, 1)]
    assert S.settle_groups(list(range(0, 6000, 200))) == [(0, 3000, 15), (3000, 6000, 15)]


def test_settled_frame(spark):
    e = spark.createDataFrame([("a", t) for t in range(0, 6000, 200)] + [("b", 7), ("b", 9000)], "k string, ms int")
    assert sorted((r.key, r.first_ms, r.settled_ms, r.n) for r in S.settled(e, "k", "ms").collect()) == [("a", 0, 3000, 15), ("a", 3000, 6000, 15), ("b", 7, 307, 1), ("b", 9000, 9300, 1)]


def test_log_ring(spark):
    e = spark.createDataFrame([("a", i) for i in range(100)], "k string, i int")
    assert sorted(r.i for r in S.latest_log(e, "k", ["i"]).collect()) == list(range(40, 100))


def test_settling_stream_equals_batch(spark, tmp_path):
    base = 1_000_000
    rows = [("a", base + t) for t in range(0, 6000, 200)] + [("b", base + 7), ("b", base + 9000), ("c", base + 200_000)]
    stamp = F.timestamp_millis("ms").alias("ts")
    for i, part in enumerate((rows[:12], rows[12:])):
        spark.createDataFrame(part, "k string, ms long").select("k", stamp).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.to_sink(S.stream_settled(stream, "k", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.key, r.first_ms - base, r.settled_ms - base, r.n) for r in spark.read.schema(S.SETTLED).parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 3000, 15), ("a", 3000, 6000, 15), ("b", 7, 307, 1), ("b", 9000, 9300, 1)]


def test_vault_stream_appends_compacts_and_is_wiped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vaults, "COMPACT", 3)
    rows = [(i, "NAME", f"Name {i % 7}", "s", None) for i in range(20)]
    path = str(tmp_path / "vault")
    for i in range(0, 20, 4):
        spark.createDataFrame(rows[i : i + 4], "ord long, cls string, value string, source string, valid boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, cls string, value string, source string, valid boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    vaults.keep_vault(stream, path, str(tmp_path / "cp")).awaitTermination()
    made, store = vaults.vault_version(spark, path), vaults.VaultStore(spark, path)
    assert sorted(r.n for r in made.collect()) == list(range(1, 8)) and made.select("key").distinct().count() == 7
    assert store.versions() == [1, 2, 3, 4, 5] and [len(store.manifest(v)["parts"]) for v in store.versions()] == [1, 2, 1, 2, 1]
    assert vaults.vault_version(spark, path, 1).count() < 7
    vaults.wipe_vault(spark, path)
    assert vaults.vault_version(spark, path) is None and vaults.vault_version(spark, path, 5).count() == 7


def sightings(spark, names, first=0):
    return spark.createDataFrame([(first + i, "NAME", n, "s", None) for i, n in enumerate(names)], "ord long, cls string, value string, source string, valid boolean")


def tokens(df):
    return {r.value: r.n for r in df.collect()}


def test_the_writer_who_loses_builds_on_what_won(spark, tmp_path):
    store = vaults.VaultStore(spark, str(tmp_path / "v"))
    store.update(sightings(spark, ["a one"]))
    held = store.manifest()
    turns = []

    def other():
        if not turns:
            turns.append(vaults.VaultStore(spark, str(tmp_path / "v")).update(sightings(spark, ["b two", "c three"])))

    done = store.update(sightings(spark, ["d four", "b two"]), before_commit=other)
    assert done["version"] == 3 and tokens(store.read()) == {"a one": 1, "b two": 2, "c three": 3, "d four": 4}
    assert tokens(store.read(held)) == {"a one": 1} and tokens(store.read(turns[0])) == {"a one": 1, "b two": 2, "c three": 3}
    assert len(list((tmp_path / "v" / "parts").iterdir())) == 3  # the loser's folder is gone
    with pytest.raises(vaults.Conflict):
        store.commit(held)


def test_writers_at_once_give_no_number_twice(spark, tmp_path):
    def write(k):
        store = vaults.VaultStore(spark, str(tmp_path / "v"))
        for i in range(3):
            store.update(sightings(spark, [f"w{k} n{i}", "both here"]))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    got = tokens(vaults.vault_version(spark, str(tmp_path / "v")))
    assert sorted(got.values()) == list(range(1, 11)) and vaults.VaultStore(spark, str(tmp_path / "v")).manifest()["version"] == 9


def test_a_batch_goes_in_once_and_old_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vaults, "COMPACT", 3)
    store = vaults.VaultStore(spark, str(tmp_path / "v"))
    for n in range(7):
        store.update(sightings(spark, [f"name {n}"]), ("stream", n))
    assert store.update(sightings(spark, ["name 99"]), ("stream", 6)) == store.manifest() and store.manifest()["version"] == 7
    before = tokens(store.read())
    assert store.sweep(kept=1) == 0 and store.sweep(kept=1, grace_seconds=0.0) == 6 and store.versions() == [7]
    assert tokens(store.read()) == before == {f"name {n}": n + 1 for n in range(7)}


def test_a_vault_that_goes_unused_is_not_restored(spark, tmp_path):
    store = vaults.VaultStore(spark, str(tmp_path / "v"))
    assert store.read() is None and store.restored(0.0) is None
    store.update(sightings(spark, ["a b"]), now=1000.0)
    assert store.restored(1900.0).count() == 1 and store.restored(1901.0) is None
    store.touched(1800.0)
    assert store.restored(2700.0).count() == 1


def test_numbering_leaves_nothing_behind(spark, tmp_path):
    from maskwright.operators import ranking

    shared = Path(ranking.shared_folder(spark).removeprefix("file://")) / "maskwright-numbers"
    before = set(shared.iterdir()) if shared.exists() else set()
    vaults.VaultStore(spark, str(tmp_path / "v")).update(sightings(spark, ["a b", "c d"]))
    assert (set(shared.iterdir()) if shared.exists() else set()) == before
