"""Line dedup: lines that many documents hold go everywhere, told by levelled sorted runs of line hashes.

1. One scan hashes the lines of every document to 128 bits and counts, for each share of the rows, in how many
   documents each key stands. Shares are the batches.
2. Each batch in turn is merge-anti-joined with the runs so far: keys that one of them already knows to be frequent are
   settled and need no more counting. What is left becomes the batch's own run at level 0. FANOUT runs of a level are
   compacted to one of the next. Runs are bucketed and sorted by key alike, so joins and compactions read bucket by
   bucket and only the new batch is shuffled.
3. The frequent keys of all runs are joined with the lines of each distinct text, and what a text loses with the texts.

Runs stay small beside the text, as they hold hashes; a line of a third of all documents is one row for each Arrow batch
before it is shuffled, and later one row for each text that holds it, which the skew join of adaptive execution splits.

Cases: a row is a document, so rows that repeat count each; a line that stands twice in a document counts once; a null
or empty text is one empty line, whose key is too short to be dropped; columns not asked for are not read; a null
doc_id is a row like others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import dropped, shared_dir, written
from .textkernel import released

BATCHES = 8
FANOUT = 4
LEAST_DOCS, LEAST_CHARS = 10, 1
SPACE = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()  # bytes know no other letters


def line_hashes(text: str | None, least_chars: int) -> list[bytes | None]:
    """The 16-byte hash of the key of each line, None for keys of fewer code points."""
    keys = [key_of(x) for x in (text or "").encode().split(b"\n")]
    return [xxhash.xxh3_128_digest(k) if k and (least_chars <= 1 or len(k.decode()) >= least_chars) else None for k in keys]


def _pair(hashes: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


class Runs:
    """Runs (h1, h2, n) of line hashes in levels; n counts documents. Bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, least: int, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """A union of tables that are bucketed alike keeps their buckets, so this needs no shuffle. The filter holds for
        all rows: Spark 4.1 takes the buckets of columnar batches for its own without putting them together, so each
        branch must give rows."""
        return reduce(DataFrame.unionByName, [self.spark.table(name).where("n > 0") for name, _ in runs])

    def _put(self, level: int, run: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        at = f"{shared_dir(self.spark)}/maskwright/{name}"
        run.select(*KEY, "n").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", at).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, at))
        if len(full := self.levels[level]) == self.fanout:
            self._put(level + 1, self._merged(full).groupBy(*KEY).agg(F.sum("n").alias("n")))
            self._drop(full)
            self.levels[level] = []

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, at in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            dropped(self.spark, at)

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (h1, h2, n), a key any number of times: those that no run has settled are its own run."""
        own = batch.groupBy(*KEY).agg(F.sum("n").alias("n"))
        for run in self.runs():
            settled = self.spark.table(run[0]).where(F.col("n") >= self.least).select(*KEY)
            own = own.join(settled.hint("merge"), KEY, "left_anti")
        self._put(0, own)

    def frequent(self) -> DataFrame:
        """h1, h2 of the keys that at least `least` documents hold."""
        return self._merged(self.runs()).groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= self.least).select(*KEY)

    def clear(self) -> None:
        self._drop(self.runs())
        self.levels = []


def frequent_keys(docs: DataFrame, least_docs: int, least_chars: int, batches: int, fanout: int) -> DataFrame:
    """h1, h2 of all frequent keys, written."""
    spark = docs.sparkSession

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            seen: Counter[bytes] = Counter()
            for text in b.column("text"):
                seen.update({h for h in line_hashes(text.as_py(), least_chars) if h})
            share = b.column("share")[:1].to_pylist() * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), *_pair(list(seen)), pa.array(seen.values(), pa.int64())], names=["share", *KEY, "n"])
        released()

    scanned = docs.select("text", F.pmod(F.spark_partition_id(), F.lit(batches)).cast("int").alias("share"))
    at = f"{shared_dir(spark)}/maskwright/lines-{uuid.uuid4().hex}"
    schema = "share int, h1 long, h2 long, n long"
    scanned.mapInArrow(counted, schema).write.partitionBy("share").parquet(at)
    seen = spark.read.schema(schema).parquet(at)
    runs = Runs(spark, least_docs, fanout)
    for (share,) in sorted(seen.select("share").distinct().collect()):  # one row for each batch
        runs.add(seen.where(F.col("share") == share))
    if not runs.runs():
        return seen.select(*KEY).limit(0)
    found, _ = written(runs.frequent(), "frequent")
    runs.clear()
    dropped(spark, at)
    return found


def _text_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def deduped(docs: DataFrame, carry: list[str], least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The columns `carry`, text (the lines that stay, joined by line feeds), n_lines (before) and n_dropped."""
    frequent = frequent_keys(docs.select("text"), least_docs, least_chars, batches, fanout)

    def told(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct keys of each text."""
        for b in rows:
            texts, hashes, at = b.column("text"), [], []
            distinct = {}
            for k, t in enumerate(zip(b.column("_t1").to_pylist(), b.column("_t2").to_pylist(), strict=True)):
                distinct.setdefault(t, k)
            for k in distinct.values():
                own = {h for h in line_hashes(texts[k].as_py(), least_chars) if h}
                hashes += own
                at += [k] * len(own)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("_t1").take(at), b.column("_t2").take(at), *_pair(hashes)], names=["_t1", "_t2", *KEY])
        released()

    lines = docs.select("text", *_text_key()).mapInArrow(told, "_t1 long, _t2 long, h1 long, h2 long")
    # written, so that the join below has a shuffle of its own on both sides and a text of many copies can be split
    gone, _ = written(lines.join(frequent, KEY).groupBy("_t1", "_t2").agg(F.collect_set(F.struct(*KEY)).alias("_gone")), "gone")

    row = docs.select(F.struct(*carry).alias("_row"), "text", *_text_key())
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    head = f"_row struct<{', '.join(f'`{c}`:{kinds[c].simpleString()}' for c in carry)}>, text string, n_lines long, n_dropped long"

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column("text"), b.column("_gone"), strict=True):
                whole = text.as_py() or ""
                if not gone.is_valid:
                    out.append(whole)
                    n_lines.append(whole.count("\n") + 1)
                    n_dropped.append(0)
                    continue
                drop = {np.array([g["h1"], g["h2"]], dtype="<i8").tobytes() for g in gone.as_py()}
                kept = [x for x, h in zip(whole.split("\n"), line_hashes(whole, least_chars), strict=True) if h not in drop]
                n_lines.append(whole.count("\n") + 1)
                n_dropped.append(n_lines[-1] - len(kept))
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["_row", "text", "n_lines", "n_dropped"])
        released()

    return row.join(gone, ["_t1", "_t2"], "left").select("_row", "text", "_gone").mapInArrow(cut, head).select("_row.*", "text", "n_lines", "n_dropped")


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)),
o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN o USING (r)
"""
