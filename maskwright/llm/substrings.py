"""Substring dedup with fixed-block anchors.

Rows are dealt to batches by ranges of doc_id; a doc_id of more bytes than a batch has batches of its own. BLOCK words are the longest block of which every window of WINDOW words
holds a whole one, wherever blocks begin: the non-overlapping blocks of every document are the index, and every rolling
window of BLOCK words of every document is a probe.

1. Each batch sends the hashes of its probes, those of its index blocks marked, each once, to the partitions of the
   hash space. A hash that is in the index and in several documents is an anchor; a bitmap tells each batch which of
   its hashes are.
2. Hits are extended to repeats: each batch sends the hashes of the WINDOW-word sequences around anchors, each once. A
   sequence was met before if a batch of lesser doc_ids, or a lesser doc_id of the same batch, has it too; a bitmap
   tells that. Runs of such windows are the maximal repeats.
3. The words under them go.

As batches are in the order of doc_id, only hashes and bits travel, and what a batch repeats within itself travels
once, however often it occurs. A batch holds about BATCH_BYTES of text, and a partition of the hash space as much as a
batch. Sequences are compared by 96 bits of hashes. A batch sends at most 2**COARSE_BITS messages. Where there must be
more partitions than that, messages meet in chunks of CHUNK_BYTES, which are cut by more bits of the hash and sent on,
and the answers take the same way back, so that rows grow in proportion to the bytes.

Cases: a null or empty text has no words; a text of less than WINDOW words loses none; rows of one doc_id don't count
as before each other; a row with a null doc_id neither loses words nor makes others lose any; very long texts are read
whole; a doc_id that is no integer is refused; an empty table gives an empty result; no column but doc_id and text is read, unless asked for.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, shuffles_released, written
from .textkernel import Words, arrow_bytes, released

WINDOW = 13
BATCH_BYTES = 4 << 20
MANY_BATCHES = 20_000
COARSE_BITS, CHUNK_BYTES = 12, 32 << 20
_CHECK_STEP = 0x9FB21C651E98DF25


def block_of(window: int) -> int:
    """The longest block that any window of this length holds whole, wherever blocks begin."""
    return max(1, (window + 1) // 2)


class Batch:
    """The rows of one batch in order of doc_id, with their words."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").combine_chunks()
        order = pc.sort_indices(pa.table({"d": ids}), sort_keys=[("d", "ascending")], null_placement="at_start")
        released()
        self.table = table.take(order)
        ids = self.table.column("doc_id").combine_chunks()
        self.none = np.asarray(pc.is_null(ids))
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.data, self.offsets = arrow_bytes(self.table.column("text"))
        self.words, self.window, self.block = Words(self.data, self.offsets, fold=False), window, block_of(window)
        self.row = self.words.rows()

    def _groups(self, hashes: np.ndarray, at: np.ndarray) -> None:
        """Sorts the hashes at these words: self.at in that order, self.first of each distinct hash, self.group of each."""
        h = hashes[at]
        order = np.argsort(h, kind="stable")
        self.at, h = at[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        self.first, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.distinct = h[self.first]

    def probes(self) -> None:
        h, ok = self.words.windows(self.block)
        self._groups(h, np.flatnonzero(ok & ~self.none[self.row]))
        indexed = (self.at - self.words.first[self.row[self.at]]) % self.block == 0
        n = len(self.first)
        self.indexed = np.bincount(self.group, weights=indexed, minlength=n) > 0 if n else np.zeros(0, bool)
        last = np.append(self.first[1:], len(self.at)) - 1 if n else self.first
        self.shared = self.indexed & (self.ids[self.row[self.at[self.first]]] != self.ids[self.row[self.at[last]]])

    def sequences(self, anchors: np.ndarray) -> None:
        """The windows that hold an anchor; self.check has more bits of their hashes. anchors: of the distinct probes."""
        n = len(self.row)
        hit = np.zeros(n + 1, dtype=np.int64)
        hit[self.at[(self.shared | anchors)[self.group]] + 1] = 1
        hit = np.cumsum(hit)
        starts = np.arange(n)
        near = hit[np.minimum(starts + self.window - self.block + 1, n)] > hit[starts]
        h, ok = self.words.windows(self.window)
        self._groups(h, np.flatnonzero(ok & near & ~self.none[self.row]))
        self.check = (self.words.windows(self.window, _CHECK_STEP)[0][self.at[self.first]] >> np.uint64(32)).astype(np.uint32) if len(self.first) else np.zeros(0, np.uint32)

    def removed(self, before: np.ndarray) -> np.ndarray:
        """Whether each word goes. before: of the distinct sequences, whether a batch before has them."""
        own = self.ids[self.row[self.at]] > self.ids[self.row[self.at[self.first]]][self.group] if len(self.at) else np.zeros(0, bool)
        starts = self.at[before[self.group] | own]
        edge = np.zeros(len(self.row) + self.window + 1, dtype=np.int64)
        edge[starts] += 1
        edge[starts + self.window] -= 1
        return np.cumsum(edge)[: len(self.row)] > 0

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the kept words joined by single spaces, offsets of the rows in them, and words gone of each row."""
        keep = ~gone
        left = np.append(0, np.cumsum(keep))
        more = keep & (left[self.words.first[self.row + 1]] - left[1:] > 0)
        data, edge = self.data.copy(), np.zeros(len(self.data) + 1, dtype=np.int8)
        ends = self.words.ends[more]
        data[ends] = 0x20
        edge[self.words.starts[keep]] += 1
        edge[self.words.ends[keep]] -= 1
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        mask[ends] = True
        at = np.append(0, np.cumsum(mask))[self.offsets]
        return data[mask], at, np.diff(np.append(0, np.cumsum(gone))[self.words.first])


def _cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where the partitions of the hash space begin in sorted distinct hashes, and their end."""
    return np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(distinct)])


def _messages(batch: int, cuts: np.ndarray, payload) -> pa.Table:
    parts = np.flatnonzero(np.diff(cuts))
    return pa.table({
        "batch": pa.array(np.full(len(parts), batch), pa.int32()), "part": pa.array(parts, pa.int32()),
        "payload": pa.array([payload(slice(cuts[p], cuts[p + 1])) for p in parts], pa.binary()),
    })


def _bits(table: pa.Table, kind: int, cuts: np.ndarray) -> np.ndarray:
    """The bits of the replies of this kind, in the order of the distinct hashes."""
    out = np.zeros(cuts[-1], dtype=bool)
    for k, p, b in zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if k == kind:
            out[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=cuts[p + 1] - cuts[p]).astype(bool)
    return out


def _answered(table: pa.Table, kind: int, verdict) -> pa.Table:
    """For the messages of one partition a bitmap each. verdict: (batch of each entry, payloads) -> bits of all entries."""
    batches, blobs = np.array(table.column("batch").to_pylist()), table.column("payload").to_pylist()
    bits, sizes = verdict(batches, blobs)
    at = np.append(0, np.cumsum(sizes))
    return pa.table({
        "batch": table.column("batch").cast(pa.int32()), "kind": pa.array(np.full(len(blobs), kind), pa.int32()), "part": table.column("part").cast(pa.int32()),
        "payload": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
    })


def anchor_bits(batches: np.ndarray, blobs: list[bytes], kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """An entry is an anchor if its hash is indexed by any batch and in several batches."""
    sizes = np.array([len(b) // np.dtype(kind).itemsize for b in blobs])
    v = np.frombuffer(b"".join(blobs), dtype=kind)
    order = np.argsort(v >> kind(1), kind="stable")
    s = v[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] >> kind(1)) != (s[:-1] >> kind(1))
    group = np.cumsum(new) - 1
    many, indexed = np.bincount(group) > 1, np.bincount(group, weights=(s & kind(1)).astype(np.int64)) > 0
    out = np.zeros(len(v), dtype=bool)
    out[order] = (many & indexed)[group]
    return out, sizes


def before_bits(batches: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a lesser batch has the same sequence."""
    sizes = np.array([len(b) // 12 for b in blobs])
    h = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes, strict=True)])
    c = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
    b = np.repeat(batches, sizes)
    order = np.lexsort((b, c, h))
    h, c, b = h[order], c[order], b[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    least = b[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(h), dtype=bool)
    out[order] = b > least
    return out, sizes


def _hashes(kind: int, blob: bytes) -> np.ndarray:
    """The sorted 64-bit hashes of a message of anchors (1) or of sequences (2)."""
    return np.frombuffer(blob, np.uint64, len(blob) // 8 if kind == 1 else len(blob) // 12)


def _piece(kind: int, blob: bytes, a: int, b: int) -> bytes:
    """Entries a to b of a message."""
    n = len(blob) // 12
    return blob[8 * a : 8 * b] if kind == 1 else blob[8 * a : 8 * b] + blob[8 * n + 4 * a : 8 * n + 4 * b]


CHUNK = "part int, first int, sub int, batches array<int>, sizes array<int>, payload binary"


def _regrouped(messages, kind: int, bits: int, fine: int, chunk_bytes: int):
    """Messages (batch, part, payload), a part's together and in order of batch -> chunks of them, cut by the next `fine`
    bits of the hash, so that how many rows travel follows from the bytes alone."""
    held: list[tuple[int, bytes]] = []
    part, size = -1, 0

    def flush():
        cuts = []
        for _, blob in held:
            sub = (_hashes(kind, blob) >> np.uint64(64 - bits - fine)) & np.uint64((1 << fine) - 1)
            cuts.append(np.searchsorted(sub, np.arange((1 << fine) + 1)))
        batches = pa.array([[b for b, _ in held]], pa.list_(pa.int32()))
        for s in range(1 << fine):
            blobs = [_piece(kind, blob, int(c[s]), int(c[s + 1])) for (_, blob), c in zip(held, cuts, strict=True)]
            if any(blobs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([held[0][0]], pa.int32()), pa.array([s], pa.int32()), batches, pa.array([[len(x) for x in blobs]], pa.list_(pa.int32())), pa.array([b"".join(blobs)], pa.binary())],
                    names=["part", "first", "sub", "batches", "sizes", "payload"],
                )

    for m in messages:
        for batch, own, blob in zip(*(m.column(k).to_pylist() for k in range(3)), strict=True):
            if held and (own != part or size + len(blob) > chunk_bytes):
                yield from flush()
                held, size = [], 0
            part, size = own, size + len(blob)
            held.append((batch, blob))
    if held:
        yield from flush()


def _answered_chunks(table: pa.Table, verdict) -> pa.Table:
    """For the chunks of one part and one value of the next bits the bits of their entries."""
    rows = table.select(["batches", "sizes", "payload"]).to_pylist()
    batches, blobs, counts = [], [], []
    for r in rows:
        at = np.append(0, np.cumsum(r["sizes"]))
        batches += r["batches"]
        blobs += [r["payload"][a:b] for a, b in zip(at, at[1:], strict=False)]
        counts.append(len(r["sizes"]))
    bits, sizes = verdict(np.array(batches), blobs)
    at, msg = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(counts))
    packed = [np.packbits(bits[at[a] : at[b]]).tobytes() for a, b in zip(msg, msg[1:], strict=False)]
    entries = [sizes[a:b].tolist() for a, b in zip(msg, msg[1:], strict=False)]
    out = table.drop(["sizes", "payload"])
    return out.append_column("sizes", pa.array(entries, pa.list_(pa.int32()))).append_column("payload", pa.array(packed, pa.binary())).select(["part", "first", "sub", "batches", "sizes", "payload"])


def _merged(table: pa.Table, kind: int) -> pa.Table:
    """The bitmap of each message of a chunk, from those of its entries by the next bits."""
    rows = sorted(table.to_pylist(), key=lambda r: r["sub"])
    out: list[list[np.ndarray]] = [[] for _ in rows[0]["batches"]]
    for r in rows:
        at = np.append(0, np.cumsum(r["sizes"]))
        bits = np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=int(at[-1]))
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            out[k].append(bits[a:b])
    n = len(out)
    return pa.table({
        "batch": pa.array(rows[0]["batches"], pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([rows[0]["part"]] * n, pa.int32()),
        "payload": pa.array([np.packbits(np.concatenate(x)).tobytes() for x in out], pa.binary()),
    })


def batch_bounds(sizes: DataFrame, n: int) -> np.ndarray:
    """The greatest doc_id of each of about n batches but the last, in order; a doc_id that fills several is there as often.
    sizes: doc_id and bytes of each row.

    The bytes of each doc_id are added up in order of doc_id: within range partitions, as many as the session has, and
    from one to the next. A batch ends where the sum passes the next n-th of all, so it holds an n-th and at most one
    more doc_id. Only the bounds come to the driver, eight bytes for each batch.
    """
    if n == 1:
        return np.zeros(0, np.int64)
    spark = sizes.sparkSession
    per_id = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.sum("size").alias("size"))
    laid, laid_at = written(per_id.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    tops = laid.groupBy("part").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size")).orderBy("first").collect()  # a row for each partition
    share = max(1.0, sum(r["size"] for r in tops) / n)
    before = np.cumsum([0, *(r["size"] for r in tops)]).tolist()
    offsets = spark.createDataFrame([(r.part, b) for r, b in zip(tops, before, strict=False)], "part int, before long")
    so_far = F.col("before") + F.sum("size").over(Window.partitionBy("part").orderBy("doc_id"))
    passed = laid.join(F.broadcast(offsets), "part").select("doc_id", (F.floor(so_far / share) - F.floor((so_far - F.col("size")) / share)).cast("int").alias("m")).where("m > 0").toPandas().sort_values("doc_id")
    dropped(spark, laid_at)
    return np.repeat(passed.doc_id.to_numpy(np.int64), passed.m.to_numpy())


def ranks_of(bounds: np.ndarray) -> np.ndarray:
    """The place of each batch in the order of doc_id; the batches of one doc_id share the place of their first."""
    ranks = np.arange(len(bounds) + 1)
    again = np.append(False, bounds[1:] == bounds[:-1]) if len(bounds) else np.zeros(0, bool)
    inner = np.flatnonzero(again)
    ranks[inner] = np.searchsorted(bounds, bounds[inner], side="left") + 1
    return ranks


def batches_of(doc_ids: np.ndarray, spread: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The batch of each row: how many bounds lie below its doc_id; rows of a doc_id that fills batches of its own are dealt
    to them by `spread`."""
    lo, hi = np.searchsorted(bounds, doc_ids, side="left"), np.searchsorted(bounds, doc_ids, side="right")
    own = hi - lo - 1
    return np.where(own > 0, lo + 1 + spread % np.maximum(own, 1), lo).astype(np.int32)


def _dealt(shared, n_batches: int) -> Column:
    """The batch of a row. The bounds are told by broadcast; no other column goes to Python."""

    def deal(doc_ids: pa.Array, spread: pa.Array) -> pa.Array:
        s = spread.to_numpy(zero_copy_only=False) & ((1 << 62) - 1)
        ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        none = np.asarray(pc.is_null(doc_ids))
        return pa.array(np.where(none, s % n_batches, batches_of(ids, s, shared.value)).astype(np.int32), pa.int32())

    return F.arrow_udf(deal, "int")(F.col("doc_id").cast("long"), F.xxhash64("text", "doc_id"))


def deduped(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None, batch_bytes: int = BATCH_BYTES, coarse_bits: int = COARSE_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, or with `carry` those columns, text (the kept words
    joined by one space; as it was if no word goes), n_words and n_removed."""
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer, as it gives the order of the documents")
    sizes, sizes_at = written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "sizes")
    total = int(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch_bytes = max(batch_bytes, min(16 * batch_bytes, total // MANY_BATCHES))  # the driver holds a bound for each
    bounds = batch_bounds(sizes, max(1, math.ceil(total / batch_bytes), min(wide, total // (batch_bytes // 8))))
    dropped(spark, sizes_at)
    n_batches = len(bounds) + 1
    all_bits = max(0, (n_batches - 1).bit_length())
    bits = min(all_bits, coarse_bits)
    fine = all_bits - bits
    # rows without a doc_id take no part and are spread
    batch = _dealt(spark.sparkContext.broadcast(bounds), n_batches)
    ranks = spark.sparkContext.broadcast(ranks_of(bounds))
    slim = docs.where("doc_id is not null").select(batch.alias("_batch"), "doc_id", "text")
    reply = "batch int, kind int, part int, payload binary"
    sent = "batch int, part int, payload binary"

    def ask_anchors(key, table):
        b = Batch(table, window)
        b.probes()
        if fine:
            values = b.distinct & ~np.uint64(1) | b.indexed.astype(np.uint64)
        else:
            values = ((b.distinct >> np.uint64(33 - bits)) & np.uint64(0x7FFFFFFF)).astype(np.uint32) << 1 | b.indexed.astype(np.uint32)
        return _messages(key[0].as_py(), _cuts(b.distinct, bits), lambda s: values[s].tobytes())

    def ask_before(key, table, replies):
        b = Batch(table, window)
        b.probes()
        b.sequences(_bits(replies, 1, _cuts(b.distinct, bits)))
        return _messages(key[0].as_py(), _cuts(b.distinct, bits), lambda s: b.distinct[s].tobytes() + b.check[s].tobytes())

    def finish(key, table, replies):
        b = Batch(table, window)
        b.probes()
        b.sequences(_bits(replies, 1, _cuts(b.distinct, bits)))
        gone = b.removed(_bits(replies, 2, _cuts(b.distinct, bits)))
        data, at, n_gone = b.kept(gone)
        if carry is None:
            sha = [hashlib.sha256(data[x:y].tobytes()).hexdigest() for x, y in zip(at, at[1:], strict=False)]
            cols = {"doc_id": b.table.column("doc_id"), "n_words": pa.array(b.words.counts(), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        else:
            old = b.table.column("text").to_pylist()
            text = [bytes(data[x:y]).decode("utf-8") if n else t for x, y, n, t in zip(at, at[1:], n_gone, old, strict=False)]
            cols = {c: b.table.column(c) for c in carry} | {"text": pa.array(text, pa.string()), "n_words": pa.array(b.words.counts(), pa.int64()), "n_removed": pa.array(n_gone, pa.int64())}
        return pa.table(cols)

    def answered(asked: DataFrame, kind: int, verdict) -> DataFrame:
        if not fine:
            return asked.groupBy("part").applyInArrow(lambda t: _answered(t, kind, verdict), reply)
        chunks = asked.repartition("part").sortWithinPartitions("part", "batch").mapInArrow(lambda ms: _regrouped(ms, kind, bits, fine, chunk_bytes), CHUNK)
        told = chunks.groupBy("part", "sub").applyInArrow(lambda t: _answered_chunks(t, verdict), CHUNK)
        return told.groupBy("part", "first").applyInArrow(lambda t: _merged(t, kind), reply)

    anchor_kind = np.uint64 if fine else np.uint32
    grouped = lambda df, key: df.groupBy(key)
    asked = grouped(slim, "_batch").applyInArrow(ask_anchors, sent)
    anchors, anchors_at = written(answered(asked, 1, lambda b, x: anchor_bits(b, x, anchor_kind)), "anchors")
    del asked
    shuffles_released(spark)
    asked = grouped(slim, "_batch").cogroup(grouped(anchors, "batch")).applyInArrow(ask_before, sent)
    before, _ = written(answered(asked, 2, lambda b, x: before_bits(ranks.value[b], x)).unionByName(anchors), "repeats")
    del asked
    shuffles_released(spark)
    dropped(spark, anchors_at)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = [c for c in carry or [] if c not in ("doc_id", "text")]
    rows = docs.select(batch.alias("_batch"), "doc_id", "text", *extra)
    head = f"doc_id {kind['doc_id']}, n_words long, n_removed long, kept_sha256 string" if carry is None else ", ".join(f"`{c}` {kind[c]}" for c in carry) + ", text string, n_words long, n_removed long"
    return grouped(rows, "_batch").cogroup(grouped(before, "batch")).applyInArrow(finish, head)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 12, 0))) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
r AS (SELECT g.doc_id, list(g.i) AS starts FROM g JOIN f USING (g) WHERE f.first_id < g.doc_id GROUP BY g.doc_id),
k AS (
  SELECT w.doc_id, len(w.w) AS n, list_distinct(flatten(list_transform(coalesce(starts, []), lambda s: range(s, s + 13)))) AS gone, w.w AS w
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i - 1) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' '), '')) AS kept_sha256
FROM k
"""
