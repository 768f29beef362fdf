"""What the bounds of the kNN join leave, and how often a candidate is copied."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import knn


class Told:
    """What a broadcast gives."""

    def __init__(self, value):
        self.value = value


def laid(vectors, pivots, k=5):
    """(frame, rings, cell and distance of each candidate) with all rows as queries, as the tasks see them."""
    x = np.floor(64 * vectors).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    frame = knn.Frame(np.unique(x[np.random.default_rng(0).permutation(len(x))[:pivots]], axis=0), x.shape[1], most)
    cell, d = frame.candidates(x)
    p = len(frame.pivots)
    least, far, n = np.full((p, k + 1), np.inf), np.zeros(p), np.bincount(cell, minlength=p)
    for c in range(p):
        own = np.sort(d[cell == c])
        least[c, : min(k + 1, len(own))] = own[: k + 1]
        far[c] = own[-1] if len(own) else 0
    rings = knn.Rings(least, far, n, k)
    q = frame.queries(x)
    lo, hi = rings.around(q)
    own = q.argmin(1)
    rings.grouped({c: (lo[own == c].min(0), hi[own == c].max(0)) for c in np.unique(own)})
    kept = (d[None] >= lo[:, cell]) & (d[None] <= hi[:, cell])
    return x, rings, rings.wanted(cell, d), kept, own


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, centres=12, each=60, dim=16):
    c = unit(rng.normal(size=(centres, dim)))
    return unit(np.repeat(c, each, axis=0) + rng.normal(size=(centres * each, dim)) * 0.02)


def test_clusters_are_copied_little():
    """Clustered vectors: under 0.3 of the pairs are left, and a candidate goes to few of the many groups."""
    x, rings, wanted, kept, own = laid(clustered(np.random.default_rng(1)), 64)
    copies = wanted.sum(0)
    print("share of pairs", kept.mean(), "groups", len(rings.lo), "copies", copies.mean(), copies.max())
    assert kept.mean() < 0.3 and len(rings.lo) >= 6 and copies.mean() < 2.5


def test_where_bounds_tell_nothing_there_is_one_copy():
    x, rings, wanted, kept, own = laid(unit(np.random.default_rng(2).normal(size=(900, 32))), 64)
    print("share of pairs", kept.mean(), "groups", len(rings.lo), "copies", wanted.sum(0).mean())
    assert len(rings.lo) <= 2 and wanted.sum(0).max() <= 2


@pytest.mark.parametrize("seed", [3, 4])
def test_no_neighbour_is_left_out(seed):
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([clustered(rng, 5, 40), rng.normal(size=(60, 16)) * rng.uniform(0, 3, (60, 1)), np.zeros((3, 16))])
    x, rings, wanted, kept, own = laid(vectors, 24)
    scores = x @ x.T
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -scores[i]))
        order = order[order != i][:5]
        need = np.flatnonzero(scores[i] >= scores[i][order[-1]])
        assert kept[i, need].all() and wanted[rings.group[own[i]], need].all()


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([clustered(rng, 6, 50), rng.normal(size=(40, 16))])
    rows = [(i if i % 97 else None, [float(v) for v in x]) for i, x in enumerate(vectors)] + [(5, None), (6, [float("nan")] * 16), (7, [None] * 16), (5, [float(v) for v in vectors[5]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id is not None, r.score) for r in knn.topk(frame, F.col("vec_id") % 10 == 0, 6, 32).collect())
    x = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if v and all(a is not None and np.isfinite(a) for a in v)]
    want = []
    for n, (q, v) in enumerate(x):
        if q is not None and q % 10 == 0:
            best = sorted((-int(v @ w), i is None, i or 0) for m, (i, w) in enumerate(x) if m != n)[:6]
            want += [(q, r + 1, not none, -s) for r, (s, none, _) in enumerate(best)]
    assert got == sorted(want)
