"""Connected components of a graph of long ids, in DataFrames."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


PER_TASK = 500_000


def _forest(batches):
    """Unites the ends of all edges of a task; gives each node with the least node it is united with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    tops = [root(x) for x in nodes]
    keep = np.array([x != t for x, t in zip(nodes, tops, strict=True)], dtype=bool)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.int64)[keep]), pa.array(np.array(tops, dtype=np.int64)[keep])], names=["a", "b"])


def contracted(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Edges with the same components, at most one for each node of a task's share of the edges (a, b)."""
    edges = edges.select("a", "b")
    return edges.coalesce(max(1, math.ceil(edges.count() / per_task))).mapInArrow(_forest, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: for every node that an edge (a, b) names, the least node that it is connected with.

    Each round takes the least label among a node's neighbours, then the label of that label, so that chains shorten
    by half or more. Rounds are written; links stay distributed. Before the rounds, tasks contract bounded shares of the
    edges, so that large groups have few edges left; a node with many edges is pre-aggregated, and its edges may be
    split over tasks.
    """
    spark = edges.sparkSession
    edges, edges_at = written(edges.select("a", "b"), "all-edges")
    edges = contracted(edges)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, both_at = written(both, "edges")
    dropped(spark, edges_at)
    labels, at = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label").union(labels)
        near, near_at = written(near.groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after, after_at = written(near.join(up, "label").select("node", F.col("up").alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        dropped(spark, at, near_at)
        labels, at = after, after_at
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    dropped(spark, both_at)
    return labels
