"""N-gram Jaccard join by chosen paths.

Sets are the distinct shingles of five words of a text (of all its words, if it has fewer). Texts of one word sequence
are one node. Each node is embedded as SKETCH minimum hashes, whose shared values are the sampled tokens that sets are
split on: a path starts at a root for each run; a bucket of more than SMALL nodes is split by the values of one or two
coordinates drawn for that path, 1 / threshold on average, so that a pair at the threshold keeps one common path per
run on average; a bucket of at most SMALL nodes is compared by brute force. Runs are repeated until the probability of
a common path of DEPTH splits at the threshold reaches `recall`.

Near copies share nearly all values, so splitting alone would never part them. Only components are wanted of a bucket,
so before each split its nodes are dealt to parts, and some of them, the hub, go to all parts: what the hub joins in
every part is one component already. If the nodes outside of it fit into one part, they are compared with all nodes and
the bucket is done; else the bucket is split again. Each node is sent a bounded number of times for each level of splits,
however large its group is. After LEVELS splits the nodes outside are compared with all in blocks, so that nothing is
left out.

Comparisons on paths use sketches with a margin of four standard errors; their edges make candidate components. Within
each the shingle sets themselves are compared, by the same parts and hubs: connected components of these exact links are
the classes. Where links are counted, blocks of BLOCK nodes of a candidate component meet blocks of BLOCK nodes, and
products of incidence matrices count them: every link between nodes of a component counts, found by a path or not, and
no table of pairs is made. A component of up to BLOCK texts is sent once; beyond that each text is sent once for each
block of its component.

Cases: null and empty texts have no shingles and no links, each a class of its own; a class is named by its least
doc_id that isn't null; copies, also with one doc_id, are one node and link to each other; very long texts are read
whole; an empty table gives an empty result; doc_id may be of any type that sorts; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import dropped, shuffles_released, written
from .textkernel import Words, arrow_bytes, mix, released, slices

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 64
SMALL = 2048
HUB = 8
DEPTH = 2
LEVELS = 24
RECALL = 0.9999
BLOCK = 4096
BLOCK_BYTES = 16 << 20
BUNDLE = 1000
_rng = np.random.default_rng(20_210)
_MUL = _rng.integers(1, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a path of `depth` splits with this probability.

    One split has two coordinates with probability 1 / threshold - 1, else one.
    """
    two = min(1.0, 1 / threshold - 1)
    one_split = 1 - ((1 - two) * (1 - threshold) + two * (1 - threshold) ** 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one_split**depth)))


def node_hashes(words: Words) -> np.ndarray:
    """A hash of each row's word sequence."""
    return words.sequences().astype(np.int64)


def sketches(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows x SKETCH minimum hashes, number of shingle places of each row)."""
    row, h = words.shingles(SHINGLE)
    order = np.argsort(row, kind="stable")
    row, x = row[order], (h[order] >> np.uint64(32)).astype(np.uint32)
    n = len(words.first) - 1
    counts = np.bincount(row, minlength=n)
    out = np.full((n, SKETCH), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        at = np.append(0, np.cumsum(counts[some]))[:-1]
        for k in range(SKETCH):
            v = x * _MUL[k]
            v ^= v >> np.uint32(15)
            v = v * np.uint32(0x2C1B3C6D) + _ADD[k]
            out[some, k] = np.minimum.reduceat(v, at)
    return out, counts


def _signed(batches):
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(2))
        for a, b in slices(offsets):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold=True)
            sketch, counts = sketches(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node_hashes(words)), pa.array(counts, pa.int32()), pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["doc_id", "text_key", "node", "n", "sketch"],
            )
        released()


def _unsketched(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.uint32).reshape(-1, SKETCH)


class SketchRows:
    """Rows of minimum hashes; alike are those that share `least` of them."""

    def __init__(self, payload: list[bytes], least: int):
        self.rows, self.least = _unsketched(payload), least

    def near(self, r: int) -> np.ndarray:
        return (self.rows == self.rows[r]).sum(1) >= self.least


class SetRows:
    """Rows of sorted distinct shingle hashes; linked are those whose similarity reaches the threshold."""

    def __init__(self, payload: list[bytes], threshold: float):
        self.sets, self.threshold = [np.frombuffer(b, np.uint64) for b in payload], threshold
        self.sizes = np.array([len(s) for s in self.sets])
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        _, self.token, self.count = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(self.token, kind="stable")
        self.holder = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.at = np.append(0, np.cumsum(self.count))
        self.first = np.append(0, np.cumsum(self.sizes))

    def near(self, r: int) -> np.ndarray:
        tokens = self.token[self.first[r] : self.first[r + 1]]
        n = self.count[tokens]
        places = np.repeat(self.at[tokens] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(self.holder[places], minlength=len(self.sets))
        return both >= self.threshold * (self.sizes + self.sizes[r] - both) - 1e-9


def spanned(rows, n: int, first, only_first: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that span the components of n rows, and a label of each row's component.

    The rows `first` are compared with all. After that the largest component needs no comparison within itself, so only
    rows outside of it are compared with all (with only_first, none).
    """
    label, edges = np.arange(n), []

    def compare(r: int) -> None:
        alike = np.flatnonzero(rows.near(r))
        labels, at = np.unique(label[alike], return_index=True)
        new = labels != label[r]
        if new.any():
            edges.extend((r, int(x)) for x in alike[at[new]])
            label[np.isin(label, labels)] = label[r]

    for r in first:
        compare(r)
    if n and not only_first:
        inside = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
        done = set(map(int, first))
        for r in range(n):
            if label[r] != label[inside] and r not in done:
                compare(r)
    return edges, label


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _unique_rows(table: pa.Table, flag: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """node, flag and payload of a table in the order of node, each node once, flagged if any of its rows is."""
    node, flagged = np.asarray(table.column("node").to_pylist(), dtype=np.int64), np.asarray(table.column(flag).to_pylist(), dtype=bool)
    order = np.lexsort((~flagged, node))
    node, flagged = node[order], flagged[order]
    new = np.append(True, node[1:] != node[:-1]) if len(node) else np.zeros(0, bool)
    payload = table.column("payload").to_pylist()
    return node[new], flagged[new], [payload[k] for k in order[new]]


def hub_rows(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, parts, the number of parts that the bucket's nodes are dealt to) with their part; rows of the
    hub in all parts."""
    own = rows.select("bucket", "node", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("hub"))
    hub = rows.where(F.pmod(F.xxhash64("bucket", "node"), F.col("parts") * HUB) == 0)
    return own.union(hub.select("bucket", "node", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.lit(True).alias("hub")))


def hub_edges(rows: DataFrame, payload: DataFrame, comparer) -> tuple[DataFrame, str]:
    """Edges (a, b) that the hubs of buckets find, where odd is null, and else a node outside of its hub's component, with
    its bucket as b. comparer makes rows to compare of a list of payloads. The second is the path of that table."""

    def solved(table):
        bucket = table.column("bucket")[0].as_py()
        node, hub, sets = _unique_rows(table, "hub")
        heads = np.flatnonzero(hub)
        edges, label = spanned(comparer(sets), len(node), heads)
        inside = np.zeros(len(node), dtype=bool)
        if len(heads):  # the hub alone is the same in all parts, so all parts take the same of its components
            _, own = spanned(comparer([sets[h] for h in heads]), len(heads), range(len(heads)))
            head = heads[np.flatnonzero(own == np.bincount(own).argmax())[0]]
            inside = label == label[head]
        odd = node[~inside]
        a = pa.array([int(node[x]) for x, _ in edges] + [None] * len(odd), pa.int64())
        b = pa.array([int(node[y]) for _, y in edges] + [bucket] * len(odd), pa.int64())
        return pa.table({"a": a, "b": b, "odd": pa.array([None] * len(edges) + odd.tolist(), pa.int64())})

    return written(hub_rows(rows).join(payload, "node").groupBy("bucket", "part").applyInArrow(solved, "a long, b long, odd long"), "hub")


def odd_rows(rows: DataFrame, odd: DataFrame) -> DataFrame:
    """rows (bucket, node, size, parts, odds, the number of odd nodes) in all blocks, and the nodes `odd` (bucket, node) in
    all parts of their block. There are as many blocks as keep a block at a part's size, one for most buckets."""
    blocks = F.ceil(F.col("odds") * F.col("parts") / F.col("size")).cast("int")
    parts = F.col("parts").cast("int")
    all_rows = rows.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int").alias("part"), "node", F.lit(False).alias("odd"))
    one = odd.join(rows.select("bucket", "size", "parts", "odds").distinct(), "bucket")
    return all_rows.union(one.select("bucket", F.pmod(F.xxhash64("node", F.lit(9)), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", F.lit(True).alias("odd")))


def odd_edges(rows: DataFrame, odd: DataFrame, payload: DataFrame, comparer) -> DataFrame:
    """Edges (a, b) of the odd nodes with all nodes of their buckets."""

    def crossed(table):
        node, odd, sets = _unique_rows(table, "odd")
        edges, _ = spanned(comparer(sets), len(node), np.flatnonzero(odd), only_first=True)
        return pa.table({"a": pa.array([int(node[x]) for x, _ in edges], pa.int64()), "b": pa.array([int(node[y]) for _, y in edges], pa.int64())})

    return odd_rows(rows, odd).join(payload, "node").groupBy("bucket", "block", "part").applyInArrow(crossed, "a long, b long")


def _split(batches, two: float):
    """Rows (bucket, node, sketch) -> rows (child bucket, node), for the coordinates that each bucket draws."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy().astype(np.uint64)
        sketch, node = _unsketched(batch.column(2).to_pylist()), batch.column(1).to_numpy()
        draw = mix(bucket + np.uint64(0x51ED270B))
        first = (draw % np.uint64(SKETCH)).astype(np.int64)
        second = (first + 1 + (mix(draw) % np.uint64(SKETCH - 1)).astype(np.int64)) % SKETCH
        twice = (mix(draw + np.uint64(1)) >> np.uint64(11)).astype(float) / (1 << 53) < two
        for at, who in ((first, np.ones(len(node), bool)), (second, twice)):
            rows = np.flatnonzero(who)
            child = mix(bucket[rows] ^ mix(sketch[rows, at[rows]].astype(np.uint64) * np.uint64(SKETCH) + at[rows].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), pa.array(node[rows])], names=["bucket", "node"])


def _grouped(batches, comparer):
    """Rows (group, node, payload), a group's together -> edges that span what is alike in each group."""
    group, node, payload = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def solved(upto: int) -> pa.RecordBatch:
        out = []
        cuts = np.flatnonzero(np.diff(group[:upto])) + 1
        for x, y in zip(np.append(0, cuts), np.append(cuts, upto), strict=True):
            edges, _ = spanned(comparer(payload[x:y]), int(y - x), [0])
            out += [(int(node[x + i]), int(node[x + j])) for i, j in edges]
        return _edges(out)

    for batch in batches:
        if not batch.num_rows:
            continue
        group, node = np.append(group, batch.column(0).to_numpy()), np.append(node, batch.column(1).to_numpy())
        payload = payload + batch.column(2).to_pylist()
        last = int(np.flatnonzero(group == group[-1])[0])  # the last group may go on
        if last:
            yield solved(last)
        group, node, payload = group[last:], node[last:], payload[last:]
    if len(group):
        yield solved(len(group))


def candidate_edges(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b) that span the nodes which sketches on common paths hold alike. nodes: node, n, sketch."""
    spark = nodes.sparkSession
    two, small = 1 / threshold - 1, SMALL
    least = math.floor(SKETCH * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)))
    runs = runs_for(recall, threshold)
    payload = nodes.select("node", F.col("sketch").alias("payload"))
    rows_of = lambda sketches: SketchRows(sketches, least)

    def roots(batches):
        for batch in batches:
            for r in range(runs):
                root = pa.array(np.full(batch.num_rows, r, dtype=np.int64))
                yield from _split([pa.RecordBatch.from_arrays([root, batch.column(0), batch.column(1)], names=["bucket", "node", "sketch"])], two)

    paths, found, gone = nodes.where("n > 0").select("node", "sketch").mapInArrow(roots, "bucket long, node long"), [], []

    def keep(frame: DataFrame, name: str) -> DataFrame:
        frame, at = written(frame, name)
        gone.append(at)
        return frame

    for level in range(1, LEVELS + 1):
        paths = keep(paths, "paths")
        large = keep(paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > small), "large")
        few = paths.join(large, "bucket", "left_anti").groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
        few = few.select("nodes").distinct().select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"))
        few = few.join(payload, "node").select("bucket", "node", "payload").repartition("bucket").sortWithinPartitions("bucket")
        found.append(keep(few.mapInArrow(lambda batches: _grouped(batches, rows_of), "a long, b long").distinct(), "found"))
        if not large.limit(1).count():
            break
        rows = paths.join(large, "bucket").withColumn("parts", F.ceil(F.col("size") / F.lit(small)))
        hub, at = hub_edges(rows, payload, rows_of)
        gone.append(at)
        found.append(hub.where("odd is null").select("a", "b").distinct())
        odd = hub.where("odd is not null").select(F.col("b").alias("bucket"), F.col("odd").alias("node")).distinct()
        odds = keep(odd.groupBy("bucket").agg(F.count(F.lit(1)).alias("odds")), "odds")
        last = level == LEVELS
        crossed = rows.join(odds if last else odds.where(F.col("odds") <= small), "bucket")
        found.append(keep(odd_edges(crossed, odd, payload, rows_of), "found"))
        if last or not odds.where(F.col("odds") > small).limit(1).count():
            break
        again = rows.join(odds.where(F.col("odds") > small).select("bucket"), "bucket").join(payload, "node").select("bucket", "node", "payload")
        paths = again.mapInArrow(lambda batches: _split(batches, two), "bucket long, node long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    out, _ = written(out.distinct(), "candidates")
    dropped(spark, *gone)
    return out


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct sets: products of incidence matrices over runs of tokens, and sums
    over the few pairs that hold a rare token."""
    na, nb = len(sets_a), len(sets_b)
    sets = [*sets_a, *sets_b]
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(na + nb), [len(s) for s in sets])
    _, at = np.unique(tokens, return_inverse=True)
    top = int(at.max()) + 1 if len(at) else 0
    in_a, in_b = np.bincount(at[owner < na], minlength=top), np.bincount(at[owner >= na], minlength=top)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    dense = in_a * in_b > 256
    out = np.zeros((na, nb), dtype=np.float32)
    left, right = (owner < na) & ~dense[at] & (in_b[at] > 0), (owner >= na) & ~dense[at]
    first = np.append(0, np.cumsum(np.where(dense, 0, in_b)))[:-1]
    n = in_b[at[left]]
    places = np.repeat(first[at[left]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if left.any() else np.zeros(0, np.int64)
    np.add.at(out.reshape(-1), np.repeat(owner[left], n) * nb + owner[right][places] - na, np.float32(1))
    column, width = np.cumsum(dense) - 1, 2048
    some = dense[at]
    owner, at = owner[some], column[at[some]]
    for lo in range(0, int(dense.sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((na + nb, width), dtype=np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m[:na] @ m[na:].T
    return out


def similar(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float, step: int = 512):
    """(first row, linked or not) for runs of rows of sets_a against all sets_b."""
    nb = np.array([len(s) for s in sets_b], dtype=np.float64)[None, :]
    for lo in range(0, len(sets_a), step):
        part = sets_a[lo : lo + step]
        both = overlaps(part, sets_b)
        na = np.array([len(s) for s in part], dtype=np.float64)[:, None]
        yield lo, both >= threshold * (na + nb - both) - 1e-9


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (node, label, copies, first_id, text_key) with the shingle set of each node as `payload`."""

    def shingled(batches):
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(3))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], fold=True)
                ok = np.flatnonzero(node_hashes(words) == batch.column(0).slice(lo, hi - lo).to_numpy())
                row, h = words.shingles(SHINGLE)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                part = batch.slice(lo, hi - lo).take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([h[at[k] : at[k + 1]].tobytes() for k in ok], pa.binary())], names=["node", "label", "copies", "payload"])

    # members grow with the corpus, so both sides are dealt by their keys at every size
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    texts = texts.join(members.hint("merge"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("text_key"))).select("node", "label", "copies", "text")
    return texts.mapInArrow(shingled, "node long, label long, copies long, payload binary").dropDuplicates(["node"])


def _exact_edges(sets: DataFrame, threshold: float, bundles: int) -> DataFrame:
    """Edges (a, b) that span the exact links within each label's nodes."""
    rows_of = lambda payload: SetRows(payload, threshold)
    weight = sets.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"))
    weight = weight.withColumn("parts", F.greatest(F.ceil(F.col("members") / F.lit(SMALL)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))))
    large, large_at = written(weight.where("parts > 1").select(F.col("label").alias("bucket"), F.col("members").alias("size"), "parts"), "large")
    key = F.pmod(F.xxhash64("label"), F.lit(bundles))
    few = sets.join(large, sets.label == large.bucket, "left_anti").select("label", "node", "payload").repartition(key).sortWithinPartitions("label")
    edges, _ = written(few.mapInArrow(lambda batches: _grouped(batches, rows_of), "a long, b long"), "exact")
    if large.limit(1).count():
        rows = sets.join(large, sets.label == large.bucket).select("bucket", "node", "size", "parts")
        payload = sets.select("node", "payload")
        hub, at = hub_edges(rows, payload, rows_of)
        odd = hub.where("odd is not null").select(F.col("b").alias("bucket"), F.col("odd").alias("node")).distinct()
        odds, odds_at = written(odd.groupBy("bucket").agg(F.count(F.lit(1)).alias("odds")), "odds")
        more, _ = written(hub.where("odd is null").select("a", "b").union(odd_edges(rows.join(odds, "bucket"), odd, payload, rows_of)), "exact")
        edges = edges.union(more)
        dropped(sets.sparkSession, at, odds_at)
    dropped(sets.sparkSession, large_at)
    return edges


def _link_counts(sets: DataFrame, threshold: float, bundles: int) -> DataFrame:
    """node, links: rows of other nodes that the node is linked with. Small labels share a group, a label of more than
    BLOCK nodes or BLOCK_BYTES of sets is counted in blocks against blocks."""
    weight = sets.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"))
    weight = weight.select("label", F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    rows = sets.join(weight, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    few = rows.where("blocks = 1").select("node", "label", "copies", "payload", F.pmod(F.xxhash64("label"), F.lit(bundles)).alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "own")
    many = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("node", "label", "copies", "payload", F.col("label").alias("k"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def counted(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        node, label = np.asarray(table.column("node").to_pylist(), np.int64), np.asarray(table.column("label").to_pylist(), np.int64)
        copies, own = np.asarray(table.column("copies").to_pylist(), np.float64), np.asarray(table.column("own").to_pylist(), np.int64)
        sets_of = [np.frombuffer(b, np.uint64) for b in table.column("payload").to_pylist()]
        links = np.zeros(len(node))

        def count(left, right, both_ways: bool) -> None:
            for lo, linked in similar([sets_of[x] for x in left], [sets_of[x] for x in right], threshold):
                who = left[lo : lo + len(linked)]
                links[who] += linked @ copies[right]
                if both_ways:
                    links[right] += copies[who] @ linked

        if i == j:
            order = np.argsort(label, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                count(part, part, False)
            links -= copies  # a row is not linked with its own node here
        else:
            count(np.flatnonzero(own == i), np.flatnonzero(own == j), True)
        some = np.flatnonzero(links > 0)
        return pa.table({"node": node[some], "links": np.rint(links[some]).astype(np.int64)})

    return few.union(many).groupBy("k", "i", "j").applyInArrow(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def classed(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node of every row, node null where the text has no word; node, class_id, n_links, class_size and
    rep_id and rep_key, the doc_id and text_key of the class's first text, of every node). n_links is null unless counted."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_signed, f"doc_id {kind}, text_key long, node long, n int, sketch binary")
    signed, signed_at = written(signed, "signed")
    rows, _ = written(signed.select("doc_id", "text_key", F.when(F.col("n") > 0, F.col("node")).alias("node")), "rows")
    key = lambda k, by: F.coalesce(F.min_by(k, by), F.min(k))
    nodes, _ = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), key("text_key", "doc_id").alias("text_key"), F.count(F.lit(1)).alias("copies")), "nodes")
    sketch, sketch_at = written(signed.where("n > 0").select("node", "sketch", "n").dropDuplicates(["node"]), "sketches")
    dropped(spark, signed_at)
    shuffles_released(spark)
    near = components(candidate_edges(sketch, threshold, recall))
    dropped(spark, sketch_at)
    members, members_at = written(near.join(nodes, "node").select("node", "label", "copies", "first_id", "text_key"), "members")
    bundles = max(1, members.count() // BUNDLE)
    sets, sets_at = written(_sets(docs, members), "sets")
    dropped(spark, members_at)
    label = components(_exact_edges(sets, threshold, bundles))
    counts, _ = written(_link_counts(sets, threshold, bundles), "counts") if counted else (spark.createDataFrame([], "node long, links long"), "")
    dropped(spark, sets_at)
    classes = label.join(nodes, "node").groupBy("label").agg(F.min("first_id").alias("class_id"), key("text_key", "first_id").alias("rep_key"), F.sum("copies").alias("class_size"))
    of = label.join(classes, "label").select("node", F.col("class_id").alias("c"), F.col("rep_key").alias("k"), F.col("class_size").alias("s"))
    per_node = nodes.join(of, "node", "left").join(counts, "node", "left").select(
        "node", F.when(F.col("s").isNull(), F.col("first_id")).otherwise(F.col("c")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links") if counted else F.lit(None).cast("long").alias("n_links"),
        F.coalesce("s", "copies").cast("long").alias("class_size"), F.coalesce("k", "text_key").alias("rep_key"),
    )
    per_node, _ = written(per_node, "per_node")
    return rows, per_node


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (other rows with a similarity of at least the
    threshold, copies among them) and class_size of every row."""
    rows, per_node = classed(docs, threshold, recall)
    return rows.join(per_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def firsts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs without all but one of each class: the one of the least doc_id that isn't null, where there is
    one; of equal rows one stays. Rows without words stay. Rows are told by doc_id and text."""
    rows, per_node = classed(docs, threshold, recall, counted=False)
    of = rows.join(per_node, "node").select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("rep_key"))).alias("first"))
    of, _ = written(of.groupBy("doc_id", "text_key", "first").agg(F.count(F.lit(1)).alias("rows")), "firsts")

    def at(keys: DataFrame) -> tuple[DataFrame, Column]:
        keys = keys.select(F.col("doc_id").alias("key_id"), "text_key")
        return keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.xxhash64("text") == F.col("text_key"))

    kept = docs.join(*at(of.where("not first")), "left_anti")
    again = of.where("first and rows > 1")
    if again.limit(1).count():
        kept = kept.join(*at(again), "left_anti").union(kept.join(*at(again), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
c AS (
  WITH RECURSIVE r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a)
  SELECT a, min(c) AS class_id FROM r GROUP BY a
)
SELECT c.a AS doc_id, c.class_id, CAST((SELECT count(*) FROM p WHERE p.a = c.a) AS BIGINT) AS n_links, CAST(count(*) OVER (PARTITION BY class_id) AS BIGINT) AS class_size FROM c
"""
