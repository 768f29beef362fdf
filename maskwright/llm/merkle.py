"""Merkle manifest of a table: a tree over its rows for each key, a tree over those trees, and a proof for every row.

A row's leaf is the hash of its columns. Leaves of one key in order, eight at a time, become their hash until one node is
left, the subroot; the subroots in order likewise become the root. Whoever holds the root can check any one row
with the siblings on its way up, without the table.

1. Leaves are hashed where the rows are read; only digests travel. Range partitions number them within their trees.
2. Aligned blocks of BLOCK leaves become one node each by a treehash, then blocks of those, until each tree has one.
3. Downwards, each block walks its leaves in order: for each level a treehash runs one run of siblings ahead of
   the walk and takes one leaf a step, so the walk holds two runs and a stack for each level. The path of the block
   itself, which all its leaves share, is appended.

A tree of one key is cut into blocks however many rows it has, so no task meets more than a block and its path.

Cases: a null column is hashed as `-`; a null key is a tree of its own, before all others; an empty text is hashed as
such; rows of the same key and doc_id are ordered by their leaves, a null doc_id first, so equal rows may change places
without changing anything; a table without rows has no root and gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, written

WIDTH = 8
HEIGHT = 4
BLOCK = WIDTH**HEIGHT
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before:string,after:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(size: int) -> int:
    """Levels above the leaves of a tree of this size."""
    n = 0
    while size > 1:
        size, n = -(-size // WIDTH), n + 1
    return n


class Treehash:
    """Takes leaves one by one and puts the nodes that they make at `level` into out. Holds less than WIDTH nodes for
    each level below."""

    def __init__(self, level: int):
        self.level, self.out, self.stack = level, [], [[] for _ in range(level)]

    def push(self, node: str, at: int = 0) -> None:
        while at < self.level:
            self.stack[at].append(node)
            if len(self.stack[at]) < WIDTH:
                return
            node, self.stack[at], at = digest(self.stack[at]), [], at + 1
        self.out.append(node)

    def close(self) -> list[str]:
        """No more leaves follow: runs that are not full become nodes too."""
        for at in range(self.level):
            if left := self.stack[at]:
                self.stack[at] = []
                self.push(digest(left), at + 1)
        return self.out


def hashed(leaves: list[str], height: int) -> str:
    """The root of the leaves of one block."""
    tree = Treehash(height)
    for x in leaves:
        tree.push(x)
    return tree.close()[0]


def walked(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn, level by level, its siblings before and after it. The list is used again."""
    n, spans = len(leaves), [WIDTH ** (k + 1) for k in range(height)]
    runs = []
    for k, span in enumerate(spans):
        tree = Treehash(k)
        for x in leaves[:span]:
            tree.push(x)
        runs.append(tree.close())
    ahead = [Treehash(k) for k in range(height - 1)]
    path: list[tuple[str, str]] = [("", "")] * height
    for i in range(n):
        for k in range(height):
            own, within = divmod(i % spans[k], WIDTH**k)
            if within:
                break  # at this level and above nothing has changed
            if own == 0 and i:
                runs[k], ahead[k] = ahead[k].close(), Treehash(k)
            path[k] = "".join(runs[k][:own]), "".join(runs[k][own + 1 :])
        yield path
        for k in range(height - 1):
            if i + spans[k] < n:
                ahead[k].push(leaves[i + spans[k]])


def leaf(*columns: Column) -> Column:
    """H of the columns: each its UTF-8 byte count, `:` and its value, or `-` if null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]), 256)


def numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, str]:
    """nodes with pos, their place in their `tree` from 0, and size, the nodes of that tree; and where they are written.

    Range partitions are sorted and written; a row's place is that in its partition plus the rows of its tree in the
    partitions before, so a tree may span any number of partitions and a partition any number of trees.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    laid, laid_at = written(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "laid")
    runs = laid.groupBy("_part", "tree").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("tree")  # at most one row for each partition
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "tree", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    placed, at = written(laid.join(runs, ["_part", "tree"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), "nodes")
    dropped(spark, laid_at)
    return placed, at


NODE = "tree string, size long, pos long, digest string"


def _block() -> Column:
    return F.expr(f"pos div {BLOCK}").alias("block")


def _in_order(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, their digests, and its levels."""
    table = table.sort_by("pos")
    size = table.column("size")[0].as_py()
    return table, table.column("digest").to_pylist(), HEIGHT if size > BLOCK else levels_of(size)


def grown(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """The root of each tree (a node at pos 0), the nodes of every level of blocks, and where tables were written."""

    def up(key, table):
        table, digests, height = _in_order(table)
        size = -(-table.column("size")[0].as_py() // BLOCK)
        return pa.table({"tree": table.column("tree")[:1], "size": pa.array([size], pa.int64()), "pos": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array([hashed(digests, height)])})

    most = nodes.agg(F.max("size")).first()[0] or 0
    levels, paths = [], []
    while most > 1:
        levels.append(nodes)
        nodes, at = written(nodes.groupBy("tree", _block()).applyInArrow(up, NODE), "blocks")
        most = -(-most // BLOCK)
        paths.append(at)
    return nodes, levels, paths


def proved(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level with `path`, their siblings level by level. above: tree, pos, path and root of
    the nodes over the highest level."""

    def down(key, table, over):
        table, digests, height = _in_order(table)
        shared = over.column("path")[0].as_py()
        before, after = [x["before"] for x in shared], [x["after"] for x in shared]
        befores, afters = [], []
        for path in walked(digests, height):
            for a, b in path:
                befores.append(a)
                afters.append(b)
            befores += before
            afters += after
        ends = pa.array(range(0, len(befores) + 1, height + len(shared)) if befores else [0] * (len(digests) + 1), pa.int32())
        paths = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(befores, pa.string()), pa.array(afters, pa.string())], names=["before", "after"]))
        roots = pa.array([over.column("root")[0].as_py()] * len(digests), pa.string())
        return table.append_column("path", paths).append_column("root", roots)

    for nodes in reversed(levels):
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
        above = nodes.groupBy("tree", _block()).cogroup(above.select("tree", "pos", "path", "root").groupBy("tree", "pos")).applyInArrow(down, f"{kinds}, path {PATH}, root string")
    return above


def manifest(rows: DataFrame, key: str = "lang", order: str = "doc_id") -> DataFrame:
    """rows (with `leaf`) with subroot, root and path: the siblings before and after the row, level by level up to the
    root. Trees are told by `key` and ordered by it; leaves by `order`."""
    spark = rows.sparkSession
    nodes = rows.withColumn("tree", F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))).withColumnRenamed("leaf", "digest")
    nodes, _ = numbered(nodes, [order, "digest"])
    subroots, levels, _ = grown(nodes)
    forest, _ = numbered(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name")), ["name"])
    roots, tops, roots_at = grown(forest)
    found = roots.head()  # one row
    none = F.lit([]).cast(PATH)
    top = roots.select("tree", "pos", none.alias("path"), F.col("digest").alias("root"))
    named = proved(tops, top) if tops else forest.withColumn("path", none)
    named, _ = written(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("root")), "subroots")
    dropped(spark, *roots_at)
    if levels:
        out = proved(levels, named)
    else:  # every tree is one leaf
        out = nodes.join(named.select("tree", "path", "root"), "tree")
    return out.withColumnRenamed("root", "subroot").withColumn("root", F.lit(found.digest if found else None).cast("string")).withColumnRenamed("digest", "leaf").drop("tree", "size", "pos")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, start, lambda d, x: F.sha2(F.concat(x["before"], d, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Of each document its leaf, the roots, its proof, and whether the proof holds for the text as it is received."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = [F.col(c) for c in COLUMNS]
    received = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, leaf(*own[:-1], F.translate("text", _UPPER, _LOWER)))
    proofs = manifest(docs.select("doc_id", "lang", leaf(*own).alias("leaf"), received.alias("received")))
    again = folded(F.coalesce("received", "leaf"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no crc32: its table by rule, then one step a byte
CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(0, 256) r(i)))"


def sql_crc32(numbers: str) -> str:
    """crc32 of a list of bytes; crc must be joined."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {numbers}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, coalesce('1' || lang, '0') AS tree, {sql_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 3 = 0 AS tampered, translate(text, '{_UPPER}', '{_LOWER}') AS low FROM documents, crc),
f AS (SELECT doc_id, tree, tampered, text, low, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in COLUMNS[:-1])} AS head FROM d),
l AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN tampered THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS received FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM l),
n AS (SELECT 0 AS level, tree, pos, size, leaf AS digest FROM p
 UNION ALL SELECT level + 1, tree, pos // {WIDTH}, (size + {WIDTH - 1}) // {WIDTH}, sha256(string_agg(digest, '' ORDER BY pos)) FROM n WHERE size > 1 GROUP BY level, tree, pos // {WIDTH}, size),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM n WHERE size = 1),
m AS (SELECT 0 AS level, pos, size, subroot AS digest FROM s
 UNION ALL SELECT level + 1, pos // {WIDTH}, (size + {WIDTH - 1}) // {WIDTH}, sha256(string_agg(digest, '' ORDER BY pos)) FROM m WHERE size > 1 GROUP BY level, pos // {WIDTH}, size),
ways AS (
 SELECT p.doc_id, p.leaf, p.received, p.tree, h.level, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < p.pos // CAST(pow({WIDTH}, h.level) AS BIGINT)), '') AS b, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > p.pos // CAST(pow({WIDTH}, h.level) AS BIGINT)), '') AS a
 FROM p JOIN (SELECT DISTINCT tree, level FROM n WHERE size > 1) h ON h.tree = p.tree JOIN n ON n.tree = p.tree AND n.level = h.level AND n.pos // {WIDTH} = p.pos // CAST(pow({WIDTH}, h.level + 1) AS BIGINT) GROUP BY ALL),
tops AS (
 SELECT s.tree, h.level + 100 AS level, coalesce(string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos < s.pos // CAST(pow({WIDTH}, h.level) AS BIGINT)), '') AS b, coalesce(string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos > s.pos // CAST(pow({WIDTH}, h.level) AS BIGINT)), '') AS a
 FROM s, (SELECT DISTINCT level FROM m WHERE size > 1) h JOIN m ON m.level = h.level WHERE m.pos // {WIDTH} = s.pos // CAST(pow({WIDTH}, h.level + 1) AS BIGINT) GROUP BY ALL),
w AS (SELECT doc_id, leaf, list(b ORDER BY level) AS b, list(a ORDER BY level) AS a FROM (SELECT doc_id, leaf, level, b, a FROM ways UNION ALL SELECT p.doc_id, p.leaf, tops.level, tops.b, tops.a FROM p JOIN tops USING (tree)) GROUP BY doc_id, leaf),
x AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM m WHERE size = 1) AS root, coalesce(b, []) AS b, coalesce(a, []) AS a, coalesce(received, p.leaf) AS received FROM p JOIN s USING (tree) LEFT JOIN w ON w.doc_id IS NOT DISTINCT FROM p.doc_id AND w.leaf = p.leaf),
y AS (SELECT *, list_reduce(list_prepend(received, list_transform(b, lambda v, i: CAST(i AS VARCHAR))), lambda g, i: sha256(b[CAST(i AS BIGINT)] || g || a[CAST(i AS BIGINT)])) AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(b, lambda v, i: v || a[i]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM y
"""
