"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are read as sets of word shingles (five words; of all words, if there are fewer), ASCII letters
lower-cased. Items of at most SHORT shingles are found exactly: a document that holds enough of them holds one of any
|item| - enough + 1 of them, by which they are looked up. Other items are partitioned by size, with upper bounds u that
are powers of two. For each partition a document is cut into segments of 2 u shingles, one beginning every u, so that a passage as long as an item of the partition
lies whole in a segment, whose size is in proportion to the item's, however long the document is. At a containment of
0.8 that leaves a Jaccard similarity of 0.19 at least, and one common minimum hash of HASHES makes a candidate: one in
700,000 true pairs is missed by a single segment. Candidates are verified by exact containment in the whole document.

Minimum hashes are taken once, of blocks of the least bound, and those of larger segments are the minima of theirs.
Segments are first looked up in a bitmap of the items' keys, with 16 cells or more for each key up to 2**27 cells. With
at most BROADCAST items of BROADCAST_BYTES in all their keys and shingles are broadcast and candidates are verified in
place; with more, what passes the bitmap is joined. Both ways find the same pairs.

Cases: null and empty texts and items have no shingles and are in no pair; an item of fewer than five words is found
only in a document of just these words; repeated documents and items make a pair each; ties don't arise, as every pair
is returned; very long documents are read whole; an empty table on either side gives an empty result; columns other
than doc_id, item_id and text are not read, and names that clash on both sides do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import written
from .textkernel import Words, arrow_bytes, mix, slices

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
SHORT = 8
LEAST_BOUND = 2 * SHORT
BROADCAST = 20_000
BROADCAST_BYTES = 32 << 20
MAP_BITS, MOST_BITS = 22, 27
_rng = np.random.default_rng(471)
_MUL = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def bound_of(n: np.ndarray) -> np.ndarray:
    """The partition of a set of n shingles: the least power of two that is no less, LEAST_BOUND at least."""
    return np.maximum(LEAST_BOUND, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES x len(at): the least hashes of the runs that begin at `at`."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(at)), dtype=np.uint32)
    for k in range(HASHES):
        v = x * _MUL[k]
        v ^= v >> np.uint32(15)
        v = v * np.uint32(0x2C1B3C6D) + _ADD[k]
        out[k] = np.minimum.reduceat(v, at)
    return out


def _short_keys(h: np.ndarray) -> np.ndarray:
    """Keys of single shingles, apart from those of minimum hashes."""
    return mix(h ^ np.uint64(0x5A17C0DE0B5E55ED))


def _keys(minima: np.ndarray, bound: int) -> np.ndarray:
    """64-bit keys of (bound, coordinate, value)."""
    salt = mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(bound << 8))[:, None]
    return mix(minima.astype(np.uint64) ^ salt)


def _shingled(col) -> tuple[np.ndarray, np.ndarray, int]:
    """Per slice: (row, hash) of the shingle places in page order, and the number of rows."""
    data, offsets = arrow_bytes(col)
    for lo, hi in slices(offsets, 2 << 20):
        row, h = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], fold=True).shingles(SHINGLE)
        order = np.argsort(row, kind="stable")
        yield lo, hi, row[order], h[order]


def item_table(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, bound (0 for items of at most SHORT shingles), shingles (sorted, distinct) and keys of every item that has
    shingles."""

    def run(batches):
        for batch in batches:
            for lo, hi, row, h in _shingled(batch.column(1)):
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                ids, bounds, sets, keys = [], [], [], []
                for r in np.flatnonzero(np.diff(at)):
                    own = np.unique(h[at[r] : at[r + 1]])
                    short = len(own) <= SHORT
                    bound = 0 if short else int(bound_of(np.array([len(own)]))[0])
                    ids.append(batch.column(0)[lo + int(r)])
                    bounds.append(bound)
                    sets.append(own.astype(np.int64))
                    enough = math.ceil(threshold * len(own) - 1e-9)
                    keys.append((_short_keys(own[: len(own) - enough + 1]) if short else _keys(_minima(own, np.array([0])), bound)[:, 0]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py() for i in ids], batch.schema.field(0).type), pa.array(bounds, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["item_id", "bound", "shingles", "keys"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, bound long, shingles array<long>, keys array<long>")


class Bitmap:
    """Which of a power of two of cells some hashes fall in, eight cells a byte."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, np.uint64(8 * len(packed) - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        cell = h & self.mask
        return (self.packed[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _bitmap(table: DataFrame, column: str, n: int) -> Bitmap:
    """A bitmap of the n values of an array column."""
    cells = 1 << min(MOST_BITS, max(MAP_BITS, (16 * n - 1).bit_length()))

    def run(batches):
        bits = np.zeros(cells, dtype=bool)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().astype(np.uint64)
            bits[flat & np.uint64(cells - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    parts = table.select(column).coalesce(8).mapInArrow(run, "bits binary").collect()
    out = np.zeros(cells // 8, dtype=np.uint8)
    for p in parts:
        out |= np.frombuffer(p.bits, np.uint8)
    return Bitmap(out)


class Segments:
    """Rows and keys of the segments of some documents that the bitmap lets pass."""

    def __init__(self, bounds: list[int], bits: Bitmap):
        self.bounds, self.short, self.bits = sorted(b for b in bounds if b), 0 in bounds, bits

    def passing(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, keys = [], []
        if len(h) and self.short:
            k = _short_keys(h)
            at = np.flatnonzero(self.bits.holds(k))
            rows.append(row[at])
            keys.append(k[at])
        if len(h) and self.bounds:
            unit = self.bounds[0]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
            at = np.flatnonzero(place % unit == 0)
            owner, number = row[at], place[at] // unit
            minima, size = _minima(h, at), unit
            for bound in self.bounds:
                while size < bound:
                    pair = number // 2
                    at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))
                    minima, owner, number, size = np.minimum.reduceat(minima, at, axis=1), owner[at], pair[at], size * 2
                both = minima.copy()
                same = owner[1:] == owner[:-1]
                both[:, :-1] = np.where(same, np.minimum(minima[:, :-1], minima[:, 1:]), minima[:, :-1])
                k = _keys(both, bound)
                _, seg = hit = np.nonzero(self.bits.holds(k))
                rows.append(owner[seg])
                keys.append(k[hit])
        return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, int), np.zeros(0, np.uint64))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, item_id, n_common, n_shingles and containment of each pair in which the document holds at least
    `threshold` of the item's shingles."""
    spark = docs.sparkSession
    table, _ = written(item_table(items, threshold), "items")
    told = table.groupBy("bound").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("keys")).alias("keys"), F.sum(F.size("shingles")).alias("shingles")).collect()  # a row for each power of two
    bounds, n_items, n_keys, n_shingles = [r.bound for r in told], sum(r.n for r in told), sum(r["keys"] for r in told), sum(r.shingles for r in told)
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_common long, n_shingles long, containment double"
    if not bounds:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(Segments(bounds, _bitmap(table, "keys", n_keys)))
    if n_items <= broadcast and 8 * (2 * n_keys + n_shingles) <= BROADCAST_BYTES:
        got = table.toPandas()
        sets = [np.sort(np.asarray(s, dtype=np.int64).astype(np.uint64)) for s in got.shingles]
        keys = np.concatenate([np.asarray(k, dtype=np.int64).astype(np.uint64) for k in got["keys"]])
        order = np.argsort(keys, kind="stable")
        index = spark.sparkContext.broadcast((keys[order], np.repeat(np.arange(len(got)), [len(k) for k in got["keys"]])[order], sets, got.item_id.tolist()))

        def solve(batches):
            segments, (known, owner, sets, ids) = shared.value, index.value
            for batch in batches:
                for lo, _, row, h in _shingled(batch.column(1)):
                    rows, keys = segments.passing(row, h)
                    a, b = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                    n = b - a
                    at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, int)
                    pairs = np.unique(np.stack([np.repeat(rows, n), owner[at]]), axis=1) if len(at) else np.zeros((2, 0), int)
                    found = []
                    last, own = -1, None
                    for r, i in pairs.T:
                        if r != last:
                            last, own = r, np.sort(h[np.searchsorted(row, r) : np.searchsorted(row, r + 1)])
                        where = np.minimum(np.searchsorted(own, sets[i]), len(own) - 1)
                        common = int((own[where] == sets[i]).sum())
                        if common >= threshold * len(sets[i]) - 1e-9:
                            found.append((lo + int(r), ids[i], common, len(sets[i])))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], items_type), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[2] / f[3] for f in found], pa.float64())],
                        names=["doc_id", "item_id", "n_common", "n_shingles", "containment"],
                    )

        items_type = to_arrow_type(items.schema["item_id"].dataType)
        return docs.select("doc_id", "text").mapInArrow(solve, out)

    common = spark.sparkContext.broadcast(_bitmap(table, "shingles", n_shingles))
    least = table.agg(F.min(F.size("shingles"))).first()[0]

    def passed(batches):
        """Keys of the segments that pass, and the document's shingles that may be in an item, where there are enough."""
        segments, bits = shared.value, common.value
        for batch in batches:
            for lo, hi, row, h in _shingled(batch.column(1)):
                rows, keys = segments.passing(row, h)
                may = bits.holds(h)
                row, h = row[may], h[may]
                order, by = np.argsort(rows, kind="stable"), np.arange(hi - lo + 1)
                rows, keys = rows[order], keys[order]
                at, key_at = np.searchsorted(row, by), np.searchsorted(rows, by)
                got = []
                for r in np.flatnonzero(np.diff(key_at)):
                    own = np.unique(h[at[r] : at[r + 1]])
                    if len(own) >= threshold * least - 1e-9:
                        got.append((lo + int(r), own.astype(np.int64), np.unique(keys[key_at[r] : key_at[r + 1]]).astype(np.int64)))
                pick = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(2).take(pick), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["doc_id", "row", "own", "keys"])

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows, _ = written(rows.mapInArrow(passed, f"doc_id {kinds[0]}, row long, own array<long>, keys array<long>"), "passed")
    table = table.withColumn("item", F.monotonically_increasing_id())
    table, _ = written(table, "items")
    by_key = table.select("item", F.explode("keys").alias("key"))
    pairs = rows.select("row", F.explode("keys").alias("key")).join(by_key, "key").select("row", "item").distinct()
    both = pairs.join(table.select("item", "item_id", "shingles"), "item").join(rows.select("row", "doc_id", "own"), "row")
    n, size = F.size(F.array_intersect("own", "shingles")).cast("long"), F.size("shingles").cast("long")
    return both.where(n >= threshold * size - 1e-9).select("doc_id", "item_id", n.alias("n_common"), size.alias("n_shingles"), (n / size).alias("containment"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained(docs, items)


_SETS = r"""
SELECT {id}, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s
FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table})"""
ORACLE_SQL = f"""
WITH d AS ({_SETS.format(id='doc_id', table='documents')}), i AS ({_SETS.format(id='item_id', table='benchmark')}),
du AS (SELECT doc_id, unnest(s) AS g FROM d), iu AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_common, CAST(n AS BIGINT) AS n_shingles, count(*) / CAST(n AS DOUBLE) AS containment
FROM du JOIN iu USING (g) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""
