"""The vault as a store that several writers and streams share: placeholders stay the same until it is wiped.

A version is a manifest: the folders that together hold the entries, which batch of each stream went in last, and when the
vault was last used. Writers put new entries into a folder of their own and then commit the next manifest, by a rename
that fails where that version is there already; who loses reads what won and builds on that. So one writer wins each
version, numbers are never given twice, and readers, who hold on to one manifest, never see half of anything. Every
COMPACT folders a commit writes the whole vault in one. Folders that no kept manifest names are swept.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed as X
from ..operators.ranking import dropping
from ..operators.vault import COLUMNS, build_vault

COMPACT = 32
#: Old manifests that are kept for readers who hold on to them.
KEPT = 8


class Conflict(Exception):
    """Another writer has committed this version."""


class VaultStore:
    """Versions of a vault under a path that all machines reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, else of the latest; one without parts where there is none."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "parts": [], "batches": {}, "used": 0.0}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """The entries of a manifest, else of the latest; None if it has none."""
        parts = (manifest or self.manifest())["parts"]
        return self.spark.read.parquet(*[f"{self.path}/parts/{p}" for p in parts]).select(*COLUMNS) if parts else None

    def restored(self, now: float, ttl_seconds: int = X.TTL_SECONDS) -> DataFrame | None:
        """The latest vault, None if it has gone unused for more than its time to live."""
        manifest = self.manifest()
        return self.read(manifest) if now - manifest["used"] <= ttl_seconds else None

    def _put(self, entries: DataFrame) -> str:
        name = uuid.uuid4().hex
        entries.select(*COLUMNS).write.parquet(f"{self.path}/parts/{name}")
        return name

    def commit(self, manifest: dict) -> dict:
        """The manifest as the version after the one that it is built on; Conflict if there is one already."""
        after = manifest | {"version": manifest["version"] + 1}
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        draft, goal = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{after['version']:012d}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(after).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(draft, goal, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(after["version"]) from e
            raise
        return after

    def update(self, sightings: DataFrame, batch: tuple[str, int] | None = None, now: float | None = None, tries: int = 20, before_commit: Callable[[], None] | None = None) -> dict:
        """Adds what sightings (cls, value, source, valid, ord) has new, as the next version. batch: a stream's name and
        the number of its micro-batch; one that is in already changes nothing."""
        for _ in range(tries):
            base = self.manifest()
            if batch and base["batches"].get(batch[0], -1) >= batch[1]:
                return base
            known = self.read(base)
            with dropping(self.spark):  # what numbering writes goes once the part is there
                after = build_vault(sightings, known)
                whole = len(base["parts"]) + 1 >= COMPACT
                new = after if known is None or whole else after.join(known.select("key"), "key", "left_anti")
                part = self._put(new)
            if before_commit:
                before_commit()
            try:
                done = self.commit(base | {"parts": [part] if whole else [*base["parts"], part], "batches": base["batches"] | (dict([batch]) if batch else {}), "used": now if now is not None else time.time()})
            except Conflict:
                self._fs.delete(self._path(f"{self.path}/parts/{part}"), True)
                continue
            return done
        raise Conflict(f"{tries} tries")

    def touched(self, now: float) -> dict:
        """The vault with a new time of use."""
        return self.commit(self.manifest() | {"used": now})

    def sweep(self, kept: int = KEPT, grace_seconds: float = 3600.0) -> int:
        """Deletes all but the latest `kept` manifests, and folders that none of these names and that are older than what
        a writer may take before it commits. Returns how many folders went."""
        versions = self.versions()
        for v in versions[:-kept]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}"), False)
        named = {p for v in versions[-kept:] for p in self.manifest(v)["parts"]}
        gone = 0
        for name in self._names("parts"):
            at = self._path(f"{self.path}/parts/{name}")
            if name not in named and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 >= grace_seconds:
                gone += bool(self._fs.delete(at, True))
        return gone

    def wipe(self) -> None:
        """Forgets all entries; the next writer numbers from 1 again. Versions go on, so no writer that has read the vault
        before can commit what it read."""
        for _ in range(20):
            try:
                self.commit(self.manifest() | {"parts": [], "batches": {}})
                return
            except Conflict:
                continue
        raise Conflict("wipe")


def vault_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The vault, or one of its versions; None if it is empty."""
    store = VaultStore(spark, path)
    return store.read(store.manifest(version))


def keep_vault(sightings: DataFrame, path: str, checkpoint: str):
    """Feeds a stream of sightings (cls, value, source, valid, ord) into the vault at a path. A batch that runs again, as
    after a failure, is in once."""
    store = VaultStore(sightings.sparkSession, path)

    def put(batch: DataFrame, number: int) -> None:
        store.update(batch, (checkpoint, number))
        if number % COMPACT == COMPACT - 1:
            store.sweep()

    return sightings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wipe_vault(spark: SparkSession, path: str) -> None:
    VaultStore(spark, path).wipe()
