"""Sharding along a Hilbert curve over quantised metadata. DataFrame functions only.

Each row gets one coordinate per metadata dimension, the Hilbert index of the cell that the coordinates name, and a
place in the total order (index, text hash, doc_id). Runs of that order are the shards, so a shard covers a compact
region of the metadata space and readers can skip shards by the minimum and maximum of each dimension.

Cases: a null or empty text has 0 bytes of text; a null lang or source has coordinate 0; equal texts take the
metadata of their first copy (least doc_id), which keeps them next to each other in the order, so only the border of
a run can part them; equal rows are told apart by their place in the scan; an empty table gives an empty result;
columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

OVERHEAD = 16
BITS = 6


def with_hilbert_index(df: DataFrame, coords: list[Column], bits: int, name: str) -> DataFrame:
    """Adds the index on the Hilbert curve of the cell with these integer coordinates, each below 2**bits.

    A fold over (bit, axis) from the top bit down undoes the curve's rotations; Gray coding and interleaving follow.
    """
    n = len(coords)

    def turned(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        head, own = F.get(x, F.lit(0)), F.get(x, s["i"])
        is_set = own.bitwiseAND(s["q"]) != 0
        change = F.when(is_set, low).otherwise(head.bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, k: F.when(k == 0, head.bitwiseXOR(change)).when((k == s["i"]) & ~is_set, own.bitwiseXOR(change)).otherwise(v))

    x = F.array(*[c.cast("int") for c in coords])
    if bits > 1:
        x = F.aggregate(F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]), x, turned)
    df = df.withColumn("_axes", x)
    gray = F.aggregate("_axes", F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))))
    df = df.withColumn("_axes", gray)
    last, flips = F.get("_axes", F.lit(n - 1)), F.lit(0)
    for b in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_flips", flips)
    places = [(b, i) for b in range(bits - 1, -1, -1) for i in range(n)]
    bit_of = lambda b, i: F.shiftright(F.get("_axes", F.lit(i)).bitwiseXOR(F.col("_flips")), b).bitwiseAND(F.lit(1)).cast("long")
    index = F.lit(0).cast("long")
    for k, (b, i) in enumerate(places):
        index = index.bitwiseOR(F.shiftleft(bit_of(b, i), len(places) - 1 - k))
    return df.withColumn(name, index).drop("_axes", "_flips")


def _coded(df: DataFrame, name: str, cells: int) -> Column:
    """Coordinate of a string column: 0 for null, else 1 + the quantile, of cells - 1, of its value among the distinct
    values, so cells keep the order of the values however many there are. Only where cells begin is read to the driver."""
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    placed, total = ranked(values, [name], "_rank")
    cell = F.expr(f"cast(1 + _rank * {cells - 1}L div {max(total, 1)}L as int)")
    # one row for each cell
    starts = placed.groupBy(cell.alias("cell")).agg(F.min(name).alias("first")).orderBy("cell").collect()
    if not starts:
        return F.lit(0)
    passed = F.size(F.filter(F.array(*[F.lit(r.first) for r in starts]), lambda b: b <= F.col(name)))
    # what changed since the values were read, if anything, has the place of its neighbour
    return F.when(F.col(name).isNull(), 0).otherwise(F.element_at(F.array(*[F.lit(r.cell) for r in starts]), F.greatest(passed, F.lit(1))))


def ranked(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Adds the place of each row, from 0, in the order of these columns, and counts the rows.

    Range partitions are sorted and written; a row's place is its place in its partition plus the rows of the
    partitions before. Only one count for each partition meets in one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid, _ = written(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # one row for each partition of the shuffle: the number of partitions bounds this side
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), int(total)


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert: runs of the curve with row counts at most one apart.

    size: UTF-8 bytes of the text plus 16. law: `rows`. slot: place in the shard, from 0. grown_shard: null.
    """
    cells = 1 << bits
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", "lang", "source", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("tie"),
    )
    slim, _ = written(slim, "slim")
    key = ["text_hash", "text_crc32", "bytes"]
    first = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "tie", "lang", "source")).alias("first")).where("copies > 1")
    first, _ = written(first.select(*key, F.lit(True).alias("copied"), F.col("first.lang").alias("first_lang"), F.col("first.source").alias("first_source")), "first")
    own = lambda c: F.when(F.col("copied"), F.col(f"first_{c}")).otherwise(F.col(c))
    meta = slim.join(first, key, "left").select("doc_id", *key, "tie", own("lang").alias("lang"), own("source").alias("source"))
    lang, source = _coded(slim, "lang", cells), _coded(slim, "source", cells)
    span = F.least(F.floor(F.log2(F.col("bytes") + F.lit(1.0)) * F.lit(cells / 32.0)), F.lit(cells - 1))
    meta = with_hilbert_index(meta, [lang, source, span], bits, "hilbert")
    placed, total = ranked(meta, ["hilbert", *key, "doc_id", "tie"], "place")
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards}L div {max(total, 1)}L as int)"))
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id", (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def op10_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
