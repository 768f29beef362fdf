import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from maskwright.llm import bpe

from .test_operators import dedup_by_hand, prose, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    other = lambda n: " ".join("".join(rng.choice(list("xyzqw"), 5)) for _ in range(n))
    texts = [(prose(rng, int(n)), "en") for n in rng.integers(20, 120, 40)] + [(other(int(n)), "xx") for n in rng.integers(20, 120, 20)]
    passage, item = prose(rng, 55), prose(rng, 30)
    texts += [(f"{prose(rng, 12)} {passage} {prose(rng, 9)}", "en") for _ in range(6)] + [(f"{prose(rng, 40)} {item} {prose(rng, 40)}", "en") for _ in range(3)]
    texts += [(texts[5][0], "en"), (texts[7][0] + " more", "en"), ("", "en"), (None, "en"), ("12 34 5678", "en")]
    rows = [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(texts)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 25))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, item


def by_id(df):
    assert df.columns == P.COLUMNS
    return {r.doc_id: tuple(r) for r in df.collect()}


def test_stages_one_by_one(spark, folder):
    at, rows, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    lang = by_id(P.language_id(spark, docs, at))
    assert lang == {r[0]: r for r in rows if re.search(r"[^\W\d_]", r[1] or "")}

    kept = by_id(P.near_duplicates(spark, docs, at))
    sets = {r[0]: shingles(r[1]) for r in rows}
    first = {i: min(j for j, b in sets.items() if i == j or a and len(a & b) >= 0.8 * len(a | b)) for i, a in sets.items()}  # classes here are cliques
    assert kept == {r[0]: r for r in rows if first[r[0]] == r[0]} and len(kept) == len(rows) - 2

    cut = by_id(P.repeated_passages(spark, docs, at))
    want = dedup_by_hand(rows)
    whole = {i for i, n, gone, _ in want if n and gone == n}
    assert set(cut) == {r[0] for r in rows} - whole
    join = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(hashlib.sha256(join(cut[i][1]).encode()).hexdigest() == sha for i, _, _, sha in want if i in cut)
    assert all(cut[r[0]] == r for r in rows if r[0] in cut and {x[0]: x for x in want}[r[0]][2] == 0)
    assert all(r[4] == len(r[1] or "") for r in cut.values())

    clean = by_id(P.benchmark_leaks(spark, docs, at))
    own = shingles(item)
    assert clean == {r[0]: r for r in rows if len(own & shingles(r[1])) < 0.8 * len(own)} and len(clean) == len(rows) - 3


def test_run_is_the_stages_in_turn(spark, folder):
    at, rows, item = folder
    got = P.run(spark, at).collect()
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), DOCS)
    codec = bpe.Codec(bpe.vocabulary_path())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(codec.encode(r.text or ""))) for r in docs.collect())
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_leaks", "token_ids"]


def test_empty_documents_and_repeated_ids(spark, folder, tmp_path):
    at, rows, _ = folder
    empty = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, empty, at).count() == 0
    odd = spark.createDataFrame([rows[0], rows[0], (rows[0][0], rows[1][1], "en", "s", 1), (None, rows[2][1], "en", "s", 1), (None, rows[2][1], "en", "s", 1)], DOCS)
    kept = P.near_duplicates(spark, odd, at).select("doc_id", F.col("text")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(rows[0][0], rows[0][1]), (rows[0][0], rows[1][1]), (None, rows[2][1])])


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_leaks_of_null_and_repeated_ids_go_alone(spark, folder, monkeypatch, broadcast):
    at, rows, item = folder
    contained = P.contamination.contained
    monkeypatch.setattr(P.contamination, "contained", lambda docs, items: contained(docs, items, broadcast=broadcast))
    leak = f"some words {item} and more"
    odd = [(None, leak, "en", "s", 1), (None, rows[1][1], "en", "s", 1), (None, None, "en", "s", 1), (7, leak, "en", "s", 1), (7, rows[2][1], "en", "s", 1), (7, rows[2][1], "en", "s", 1), (8, "", "en", "s", 0)]
    kept = P.benchmark_leaks(spark, spark.createDataFrame(odd, DOCS), at)
    assert kept.columns == P.COLUMNS and Counter(map(tuple, kept.collect())) == Counter(r for r in odd if r[1] != leak)


def test_very_long_texts_pass_all_stages(spark, tmp_path):
    rng = np.random.default_rng(21)
    long = prose(rng, 40_000)
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", len(long) + 4), (3, "short " + " ".join(long.split()[100:200]), "en", "s", 9), (4, prose(rng, 30), "en", "s", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, len(r.ids)) for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4} and got[1][0] == got[1][1] > 40_000 and got[3][0] < 10
