"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are read as integers, floor(64 * x), and lifted by one coordinate so that a greater inner product is a lesser
distance: sqrt(M - |v|^2) for candidates, where M is the greatest square norm. Queries are drawn out to that norm, which
leaves the order of their products as it is, and their coordinate is 0. All go to the cell of their nearest pivot.

From the least distances of candidates to the pivot of each cell follows, for every query, a bound on the distance of its
k-th neighbour, and with the triangle inequality the ring of distances in which a candidate cell can matter to it. The
rings of a query cell hold those of all its queries. Query cells that need much the same candidates make one group, chosen
from the summaries, and a candidate is copied once to each group that needs it: where the bounds tell nothing, that is
one group and one copy. Within a pair of blocks, what is outside of the rings of the query block is left out again.

Blocks hold at most BLOCK candidates and QUERIES queries, so that a group with many rows is many units of work; they are
dealt to salts, and a sort-merge join brings each pair together once, spilling where a group has many. Pivots are a sample
of candidates by a hash, and their number and that of salts grow with the rows: PIVOTS and SALTS are the least, and what
the driver and each task hold of all cells bounds them by MOST_PIVOTS and MOST_SALTS. They only decide what is copied and
where it is solved, never the result.

Cases: vectors that are null, or hold null or non-finite components, take no part; a shorter vector is read as
followed by zeros; a query's own row is no candidate, other rows with its vec_id are; ties go to the smaller vec_id;
with fewer candidates than k all are returned; a null vec_id is a candidate after all others of its score; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

PIVOTS, MOST_PIVOTS = 16, 256
BLOCK = 8192
QUERIES = 1024
SALTS, MOST_SALTS = 8, 64
SLACK = 1e-6
#: Query cells of which each needs at least this share of what both need are one group.
ALIKE = 0.5
#: Stands for a null vec_id, so that it comes after all others.
NO_ID = (1 << 63) - 1


def _matrix(vectors, dim: int) -> np.ndarray:
    if len(vectors) and all(len(v) == dim for v in vectors):
        return np.stack(vectors).astype(np.int64).reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(x: np.ndarray) -> bytes:
    most = int(np.abs(x).max(initial=0))
    kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"i{blob[0]}", offset=1).reshape(-1, dim)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating-point matrix products where those are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 1 << 24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if top < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    xf, pf = x.astype(float), pivots.astype(float)
    d = (xf**2).sum(1)[:, None] + (pf**2).sum(1)[None, :] - 2 * xf @ pf.T + (lift[:, None] - pivot_lift[None, :]) ** 2
    return np.sqrt(np.maximum(d, 0))


class Frame:
    """What every task needs: the pivots, the dimension and the greatest square norm."""

    def __init__(self, pivots: np.ndarray, dim: int, most: float):
        self.pivots, self.dim, self.most = pivots, dim, most
        self.lift = np.sqrt(np.maximum(most - (pivots.astype(float) ** 2).sum(1), 0))

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each, and the distance to its pivot."""
        d = _distances(x, np.sqrt(np.maximum(self.most - (x.astype(float) ** 2).sum(1), 0)), self.pivots, self.lift)
        return d.argmin(1), d.min(1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Distances of each, drawn out to the greatest norm, to all pivots."""
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        return _distances(x * np.where(norm > 0, math.sqrt(self.most) / np.maximum(norm, 1e-300), 1.0)[:, None], np.zeros(len(x)), self.pivots, self.lift)


class Rings:
    """Of what distances to its pivot candidates of each cell can matter. least: the k + 1 least of each cell in order
    (infinite where there are fewer), far the greatest, n the candidates of each."""

    def __init__(self, least: np.ndarray, far: np.ndarray, n: np.ndarray, k: int):
        self.least, self.far, self.n, self.k = least, far, n, k
        self.group = np.zeros(len(n), dtype=int)
        self.lo, self.hi = np.full((1, len(n)), np.inf), np.full((1, len(n)), -np.inf)

    def around(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi), each queries x cells, for distances of queries to all pivots."""
        within = np.sort((d[:, :, None] + self.least[None]).reshape(len(d), -1), axis=1)
        theta = within[:, self.k] if within.shape[1] > self.k else np.full(len(d), np.inf)  # one may be the query itself
        theta = theta[:, None] * (1 + SLACK) + SLACK
        return d - theta, d + theta

    def grouped(self, cells: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Puts query cells with their rings into groups. What a cell may need is told by the candidates of all cells that
        its rings meet."""
        los, his, needs = [], [], []
        for c, (lo, hi) in sorted(cells.items()):
            need = (lo <= self.far) & (hi >= self.least[:, 0]) & (self.n > 0)
            for g, other in enumerate(needs):
                both = self.n[need | other].sum()
                if min(self.n[need].sum(), self.n[other].sum()) >= ALIKE * both:
                    los[g], his[g], needs[g] = np.minimum(los[g], lo), np.maximum(his[g], hi), need | other
                    break
            else:
                g = len(needs)
                los.append(lo), his.append(hi), needs.append(need)
            self.group[c] = g
        if needs:
            self.lo, self.hi = np.stack(los), np.stack(his)

    def wanted(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        """groups x candidates: which are copied to which group."""
        return (d[None] >= self.lo[:, cell]) & (d[None] <= self.hi[:, cell])


def pivots_for(n: int) -> int:
    """A pivot for about as many rows as there are eightfold pivots."""
    return min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n) // 8))


def salts_for(n: int) -> int:
    return min(MOST_SALTS, max(SALTS, n >> 24))


def rings_of(rows: DataFrame, shared, k: int) -> Rings:
    """The rings and groups of all query cells. rows: v and is_query; shared: the frame, broadcast. Two passes give the
    summaries of candidates and of queries; their size on the driver follows from the number of pivots."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k + 1 least distances of candidates to each cell's pivot, the greatest, and their number."""
        at = shared.value
        least: dict[int, np.ndarray] = {}
        far, n = np.zeros(len(at.pivots)), np.zeros(len(at.pivots), dtype=np.int64)
        for b in batches:
            cell, d = at.candidates(_matrix(list(b.v), at.dim))
            for c in np.unique(cell):
                own = d[cell == c]
                least[c] = np.sort(np.concatenate([least.get(c, np.zeros(0)), own]))[: k + 1]
                far[c], n[c] = max(far[c], own.max()), n[c] + len(own)
        yield pd.DataFrame([(int(c), x.tolist(), far[c], n[c]) for c, x in least.items()], columns=["cell", "least", "far", "n"])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rings of each query cell."""
        at, rings = shared.value, told.value
        found: dict[int, tuple] = {}
        for b in batches:
            d = at.queries(_matrix(list(b.v), at.dim))
            for a in range(0, len(d), 256):
                lo, hi = rings.around(d[a : a + 256])
                cell = d[a : a + 256].argmin(1)
                for c in np.unique(cell):
                    was = found.get(c, (np.inf, -np.inf))
                    found[c] = np.minimum(was[0], lo[cell == c].min(0)), np.maximum(was[1], hi[cell == c].max(0))
        yield pd.DataFrame([(int(c), lo.tolist(), hi.tolist()) for c, (lo, hi) in found.items()], columns=["cell", "lo", "hi"])

    p = len(shared.value.pivots)
    sums = rows.select("v").mapInPandas(near, "cell int, least array<double>, far double, n long").groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least"), F.max("far").alias("far"), F.sum("n").alias("n")).collect()
    least, far, n = np.full((p, k + 1), np.inf), np.zeros(p), np.zeros(p, dtype=np.int64)
    for r in sums:  # a row for each cell
        least[r.cell, : len(r.least)], far[r.cell], n[r.cell] = r.least, r.far, r.n
    rings = Rings(least, far, n, k)
    told = rows.sparkSession.sparkContext.broadcast(rings)
    best = lambda c, f: F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: getattr(F, f"array_{f}")(F.transform(F.col(c), lambda x: x[i])))
    cells = rows.where("is_query").select("v").mapInPandas(met, "cell int, lo array<double>, hi array<double>").groupBy("cell").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    rings.grouped({r.cell: (np.array(r.lo), np.array(r.hi)) for r in cells.select("cell", best("lo", "min").alias("lo"), best("hi", "max").alias("hi")).collect()})
    return rings


def topk(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k candidates of highest integer inner product of each query.

    vectors has vec_id and embedding. pivots: how many cells at most; else it follows from the number of rows.
    """
    spark = vectors.sparkSession
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).where(fine)
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), "is_query", ints.alias("v"))
    rows, _ = written(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    found = rows.agg(F.max(F.size("v")), F.max(square), F.count(F.lit(1))).first()
    if found[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most = max(int(found[0]), 1), float(found[1])
    chosen = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(pivots or pivots_for(found[2])).select("v").toPandas()
    frame = Frame(np.unique(_matrix(list(chosen.v), dim), axis=0), dim, most)
    shared, salts = spark.sparkContext.broadcast(frame), salts_for(found[2])
    ringed = spark.sparkContext.broadcast(rings_of(rows, shared, k))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rings = shared.value, ringed.value
        n = 0
        for b in batches:
            x, rows_at, ids = _matrix(list(b.v), at.dim), b.row.to_numpy(np.int64), b.vec_id.to_numpy(np.int64)
            cell, d = at.candidates(x)
            for g, wanted in enumerate(rings.wanted(cell, d)):
                keep = np.flatnonzero(wanted)
                for a in range(0, len(keep), BLOCK):
                    part = keep[a : a + BLOCK]
                    n += 1
                    yield pd.DataFrame({"group": [g], "salt": [(int(rows_at[part[0]]) + n) % salts], "c_rows": [rows_at[part].tobytes()], "c_ids": [ids[part].tobytes()], "c_cell": [cell[part].astype(np.int32).tobytes()], "c_d": [d[part].tobytes()], "c": [_packed(x[part])]})

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rings = shared.value, ringed.value
        for b in batches:
            x, rows_at, ids = _matrix(list(b.v), at.dim), b.row.to_numpy(np.int64), b.vec_id.to_numpy(np.int64)
            d = at.queries(x)
            lo, hi = rings.around(d)
            cell = d.argmin(1)
            for g in np.unique(rings.group[cell]):
                own = np.flatnonzero(rings.group[cell] == g)
                own = own[np.argsort(cell[own], kind="stable")]  # so that a block's rings are narrow
                for a in range(0, len(own), QUERIES):
                    part = own[a : a + QUERIES]
                    yield pd.DataFrame({"group": [int(g)], "q_rows": [rows_at[part].tobytes()], "q_ids": [ids[part].tobytes()], "q_lo": [lo[part].min(0).tobytes()], "q_hi": [hi[part].max(0).tobytes()], "q": [_packed(x[part])]})

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for b in batches:
            for r in b.itertuples(index=False):
                cell, d, lo, hi = np.frombuffer(r.c_cell, dtype=np.int32), np.frombuffer(r.c_d), np.frombuffer(r.q_lo), np.frombuffer(r.q_hi)
                keep = np.flatnonzero((d >= lo[cell]) & (d <= hi[cell]))
                q_rows, q_ids, c_rows, c_ids = (np.frombuffer(x, dtype=np.int64) for x in (r.q_rows, r.q_ids, r.c_rows, r.c_ids))
                keep = keep[np.lexsort((c_rows[keep], c_ids[keep]))]
                q, c, c_rows, c_ids = _unpacked(r.q, at.dim), _unpacked(r.c, at.dim)[keep], c_rows[keep], c_ids[keep]
                out = []
                for a in range(0, len(q) if len(keep) else 0, 128):
                    s = products(q[a : a + 128], c)
                    for i in range(len(s)):
                        own = np.flatnonzero(c_rows == q_rows[a + i])
                        line = s[i]
                        if len(line) > k + 1:
                            cut = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                            near = np.flatnonzero(line >= cut)
                        else:
                            near = np.arange(len(line))
                        near = near[~np.isin(near, own)]
                        near = near[np.argsort(-line[near], kind="stable")][:k]
                        out.append(pd.DataFrame({"row": q_rows[a + i], "query_id": q_ids[a + i], "vec_id": c_ids[near], "score": line[near]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    block = rows.mapInPandas(blocks, "group int, salt int, c_rows binary, c_ids binary, c_cell binary, c_d binary, c binary")
    query = rows.where("is_query").mapInPandas(asked, "group int, q_rows binary, q_ids binary, q_lo binary, q_hi binary, q binary").withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    part = block.join(query.hint("merge"), ["group", "salt"]).mapInPandas(solved, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(known("query_id"), "rank", known("vec_id"), "score")


def op6_voronoi_topk(spark, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
