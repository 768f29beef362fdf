"""Files of shards can be left out by the least and greatest value of a dimension, however many values it has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import sharding


@pytest.mark.parametrize("sources", [1, 10, 64, 65, 5000])
def test_coordinates_keep_the_order_of_values(spark, sources):
    values = [f"src{i:05d}" for i in range(sources)]
    frame = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "source string")
    got = {r.source: r.c for r in frame.select("source", sharding._coded(frame, "source", 64).alias("c")).collect()}
    cells = [got[v] for v in values]
    assert got[None] == 0 and cells == sorted(cells) and cells[0] == 1 and max(cells) <= 63
    counts = np.bincount(cells)[1:]
    assert counts.max() == -(-sources // 63) if sources > 63 else counts.max() == 1


@pytest.mark.parametrize("sources", [10, 64, 5000])
def test_shards_can_be_left_out(spark, sources):
    rng = np.random.default_rng(sources)
    rows = [(i, f"{i} " + "x" * int(rng.integers(1, 4000)), str(rng.choice(["de", "en", "fr", "it"])), f"src{rng.integers(0, sources):05d}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shards = sharding.hilbert_shards(docs, 40).join(docs, "doc_id").groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("lang").alias("c"), F.max("lang").alias("d"), F.min("size").alias("e"), F.max("size").alias("f")).collect()
    asked = [f"src{k * sources // 20:05d}" for k in range(20)]
    by_source = np.mean([sum(r.a <= v <= r.b for r in shards) for v in asked]) / 40
    by_lang = np.mean([sum(r.c <= v <= r.d for r in shards) for v in ("de", "en", "fr", "it")]) / 40
    both = np.mean([sum(r.a <= v <= r.b and r.c <= "en" <= r.d for r in shards) for v in asked]) / 40
    print(sources, by_source, by_lang, both)
    assert by_source < 0.65 and by_lang < 0.65 and both < 0.35

