import hashlib
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import bpe, contamination, graph, knn, language, licenses, neardup, pages, sharding, substrings, toxicity
from maskwright.llm.registry import oracle_sql, queries

WORDS = "the of and to in is on for with that by as are was be this from at or an".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, spans string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, clashing extra columns."""
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(n)) for n in rng.integers(3, 160, 60)]
    long = prose(rng, 4000)
    base = texts[10].split() if len(texts[10].split()) > 40 else prose(rng, 90).split()
    near = [" ".join(w if i != k * 7 % len(base) else f"edit{k}" for i, w in enumerate(base)) for k in range(120)]
    passage = prose(rng, 30)
    shared = [f"{prose(rng, 8)} {passage} {prose(rng, 9)}" for _ in range(12)]
    texts += [" ".join(base), *near, *shared, long, f"{prose(rng, 20)} {' '.join(long.split()[100:140])}", texts[3], texts[3], "", None, "   \n\t", "one two", "One  TWO", "a\x0bb c", "😀 é", texts[5].upper()]
    ids = rng.permutation(len(texts) * 2)[: len(texts)].tolist()
    rows = [(int(i), t, "en", "s", len(t or ""), 1, "x") for i, t in zip(ids, texts)]
    rows += [rows[0], (None, texts[1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_links_equal_brute_force(spark, corpus, monkeypatch):
    rows, docs = corpus
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    sets = [shingles(r[1]) for r in rows]
    near = [{j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b) - 1e-9} for i, a in enumerate(sets)]
    seen, classes = {}, {}
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, own = [i], {i}
        while todo:
            new = near[todo.pop()] - own
            own |= new
            todo += new
        least = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        for k in own:
            seen[k] = (least, len(own))
    want = Counter((rows[i][0], seen[i][0], len(near[i]), seen[i][1]) for i in range(len(rows)))
    got = Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in neardup.links(docs).collect())
    assert got == want


def test_links_of_an_empty_table(spark):
    assert neardup.links(spark.createDataFrame([], DOCS)).count() == 0
    assert neardup.firsts(spark.createDataFrame([], DOCS)).count() == 0


def test_links_of_ids_that_are_no_numbers(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([("k2", text), ("k1", text + " end"), (None, text.upper()), ("k9", "other words here")], "doc_id string, text string")
    got = {(r.doc_id, r.class_id, r.n_links, r.class_size) for r in neardup.links(docs).collect()}
    assert got == {("k2", "k1", 2, 3), ("k1", "k1", 2, 3), (None, "k1", 2, 3), ("k9", "k9", 0, 1)}


def test_spanned_components_equal_brute_force():
    rng = np.random.default_rng(8)
    for n in (0, 1, 7, 60):
        near = rng.random((n, n)) < 1.2 / max(n, 1)
        near |= near.T | np.eye(n, dtype=bool)

        class Rows:
            def near(self, r):
                return near[r]

        for first in ([], list(range(0, n, 9))):
            edges, label = neardup.spanned(Rows(), n, first)
            reach = np.linalg.matrix_power(near.astype(float), max(n, 1)) > 0 if n else near
            assert (label[:, None] == label[None, :]).tolist() == reach.tolist()
            assert all(near[a, b] for a, b in edges) and len(edges) == n - len(set(label.tolist()))


def test_overlaps_of_rare_and_frequent_tokens():
    rng = np.random.default_rng(9)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(100, 5000, 30)]).astype(np.uint64)) for _ in range(50)] + [np.zeros(0, np.uint64)]
    got = neardup.overlaps(sets[:20], sets[20:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[20:]] for a in sets[:20]]


def test_rows_of_a_large_group_grow_in_proportion(spark, monkeypatch):
    """Near copies of one text with three edits each: many pairs are links, and many are not."""
    rng = np.random.default_rng(10)
    base, made = prose(rng, 120).split(), {}
    for name in ("hub_rows", "odd_rows", "written"):

        def counted(*args, whole=getattr(neardup, name)):
            got = whole(*args)
            made[size] = made.get(size, 0) + (got[0] if isinstance(got, tuple) else got).count()
            return got

        monkeypatch.setattr(neardup, name, counted)
    monkeypatch.setattr(neardup, "SMALL", 512)
    for size in (1000, 2000, 4000):
        texts = []
        for k in range(size):
            words = list(base)
            for at in rng.integers(0, len(words), 3):
                words[at] = f"new{rng.integers(0, 1 << 30)}"
            texts.append((k, " ".join(words)))
        got = neardup.firsts(spark.createDataFrame(texts, "doc_id long, text string"))
        assert got.where("doc_id = 0").count() == 1
    assert made[2000] < 2.4 * made[1000] and made[4000] < 2.4 * made[2000], made


def test_enough_runs():
    assert neardup.runs_for(0.9999, 0.8, 1) == 6 and neardup.runs_for(0.99, 0.8, 2) < neardup.runs_for(0.9999, 0.8, 2)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = list(range(2000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in graph.components(frame).collect()} == want
    few = {(r.a, r.b) for r in graph.contracted(frame, 40).collect()}
    assert {r.node: r.label for r in graph.components(spark.createDataFrame(sorted(few), "a long, b long")).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def dedup_by_hand(rows, size=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for r, ws in zip(rows, words):
        if r[0] is not None:
            for i in range(len(ws) - size + 1):
                k = tuple(ws[i : i + size])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r, ws in zip(rows, words):
        gone = set()
        if r[0] is not None:
            for i in range(len(ws) - size + 1):
                if first[tuple(ws[i : i + size])] < r[0]:
                    gone |= set(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batch_bytes", [1 << 30, 2000])
def test_substrings_equal_brute_force(spark, corpus, batch_bytes):
    rows, docs = corpus
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduped(docs, batch_bytes=batch_bytes).collect())
    assert got == dedup_by_hand(rows)


@pytest.mark.parametrize("coarse", [0, 2])
def test_substrings_over_chunks_equal_brute_force(spark, corpus, coarse):
    rows, docs = corpus
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduped(docs, batch_bytes=2000, coarse_bits=coarse, chunk_bytes=3000).collect())
    assert got == dedup_by_hand(rows)


def test_batches_are_cut_by_bytes(spark):
    rows = [(i, "x" * (1000 if i % 50 else 20_000)) for i in range(1000)] + [(7, "y" * 5000)] * 3 + [(None, "z" * 900)] * 20
    docs = spark.createDataFrame([(i, len(t)) for i, t in rows], "doc_id long, size long")
    n = sum(len(t) for _, t in rows) // 50_000
    bounds = substrings.batch_bounds(docs, n).tolist()
    sizes = Counter()
    for i, t in rows:
        if i is not None:
            sizes[sum(b < i for b in bounds)] += len(t)
    assert bounds == sorted(set(bounds)) and n // 2 < len(bounds) <= n and max(sizes.values()) <= 90_000


def test_one_doc_id_of_many_rows_has_batches_of_its_own(spark):
    """A third of all bytes under one doc_id: they are dealt to many batches, which don't count as before each other."""
    rng = np.random.default_rng(6)
    passage = prose(rng, 20)
    rows = [(i, f"{prose(rng, 30)} {passage if i % 3 == 0 else ''} {prose(rng, 5)}") for i in range(60)] + [(31, f"{prose(rng, 4)} {passage} {prose(rng, 20)}") for _ in range(60)] + [(31, f"{passage} end")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = docs.select("doc_id", F.octet_length("text").alias("size"))
    bounds = substrings.batch_bounds(sizes, 30)
    assert (bounds == 31).sum() >= 10 and len(bounds) <= 30
    dealt = Counter(substrings.batches_of(np.full(600, 31), np.arange(600), bounds).tolist())
    assert len(dealt) == (bounds == 31).sum() - 1 and max(dealt.values()) < 90
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduped(docs, batch_bytes=1500).collect())
    assert got == dedup_by_hand(rows)


def test_a_very_large_number_of_batches(spark, corpus):
    rows, docs = corpus
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduped(docs, batch_bytes=300, coarse_bits=3).collect())
    assert got == dedup_by_hand(rows)


def test_doc_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        substrings.deduped(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_messages_grow_in_proportion(spark):
    """Rows that chunks send on, for twice and four times the messages of a part."""
    rng = np.random.default_rng(3)
    made = []
    for n in (50, 100, 200):
        blobs = [np.sort(rng.integers(0, 1 << 62, 200, dtype=np.uint64) >> np.uint64(2)).tobytes() for _ in range(n)]
        ms = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([0] * n, pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "part", "payload"])]
        made.append(len(list(substrings._regrouped(iter(ms), 1, 4, 3, 10 * 1600))))
    assert made[1] == 2 * made[0] and made[2] == 4 * made[0]


def test_substrings_other_windows_and_carried_columns(spark, corpus):
    rows, docs = corpus
    got = substrings.deduped(docs, window=4, carry=["doc_id", "label", "spans"], batch_bytes=3000).collect()
    want = dedup_by_hand(rows, 4)
    text = lambda r: r.text if r.n_removed else " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(text(r).encode()).hexdigest()) for r in got) == want
    assert {(r.label, r.spans) for r in got} == {(1, "x"), (None, None)}
    assert substrings.deduped(spark.createDataFrame([], DOCS)).count() == 0
    clash = substrings.deduped(docs.withColumnRenamed("label", "batch").withColumnRenamed("lang", "part"), carry=["doc_id", "batch", "part"], batch_bytes=3000)
    assert clash.where("batch = 1").count() == len(rows) - 2


def test_ranges_of_doc_ids():
    bounds, ids = np.array([5, 9, 9, 20, 31, 31, 31, 40, 41]), np.arange(50)
    got = substrings.batches_of(ids, ids * 7, bounds)
    plain = [i for i in ids if i not in (9, 31)]
    assert all(got[i] == sum(bounds < i) for i in plain) and got[9] == 2 and {int(x) for x in substrings.batches_of(np.full(9, 31), np.arange(9), bounds)} == {5, 6}
    assert substrings.ranks_of(bounds).tolist() == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9] and substrings.ranks_of(np.zeros(0, np.int64)).tolist() == [0]


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_contained_equals_brute_force(spark, corpus, broadcast):
    rows, docs = corpus
    rng = np.random.default_rng(8)
    long = max((r[1] or "" for r in rows), key=len).split()
    items = [(k, " ".join(long[k * 60 : k * 60 + n])) for k, n in enumerate([5, 9, 13, 24, 40, 59, 130])]
    edited = items[5][1].split()
    edited[7] = "other"
    items += [(7, " ".join(edited)), (8, prose(rng, 30)), (9, ""), (10, None), (11, "one two"), (12, items[4][1]), (12, items[4][1])]
    frame = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, label int")
    sets, own = [(r[0], shingles(r[1])) for r in rows], [(i, shingles(t)) for i, t in items]
    want = Counter((d, i, len(s & t), len(t)) for d, s in sets for i, t in own if t and len(s & t) >= 0.8 * len(t) - 1e-9)
    got = contamination.contained(docs, frame, broadcast=broadcast)
    assert Counter((r.doc_id, r.item_id, r.n_common, r.n_shingles) for r in got.collect()) == want
    assert contamination.contained(docs, frame.limit(0), broadcast=broadcast).count() == 0 == contamination.contained(docs.limit(0), frame, broadcast=broadcast).count()


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 6)), np.repeat(rng.normal(0, 1, (1, 6)), 60, axis=0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 7) for i, r in enumerate(x)]
    rows += [(3, rows[3][1], 7), (400, None, 0), (420, [1.0, None], 0), (440, [float("nan")] * 6, 0), (460, [float("inf")] * 6, 0), (480, [0.5, 0.5], 0), (500, [], 0), (520, [300.0] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    fine = [(i, np.floor(64 * np.array(v, np.float64))) for i, v, _ in rows if v is not None and all(y is not None and np.isfinite(y) for y in v)]
    wide = [(i, np.pad(v, (0, 6 - len(v))).astype(int)) for i, v in fine]
    want = set()
    for a, (i, q) in enumerate(wide):
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for b, (j, v) in enumerate(wide) if a != b)[:20]
            want |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in knn.topk(frame, F.col("vec_id") % 20 == 0).collect()}
    assert got == want
    few = knn.topk(frame.limit(3), F.col("vec_id") % 20 == 0)
    assert few.count() == 2 and knn.topk(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact(spark):
    frame = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, -1.0]), (2, [-2e9, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.score) for r in knn.topk(frame, F.col("vec_id") == 0).collect()}
    assert got == {(1, 64 * 64 * (10**12 - 3)), (2, 64 * 64 * (3 - 2 * 10**15))}


def scan_by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    more, best = set(labels), 0.0
    for line in low.split("\n"):
        said = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)
        own = set(said)
        for (_, label, tokens, common), must in zip(licenses.template_rows(), licenses.needed(), strict=True):
            if len(own & set(tokens)) >= common and any(said[i : i + len(must)] == must for i in range(len(said))):
                more.add(label)
                best = max(best, len(own & set(tokens)) / len(tokens))
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), best or (1.0 if places else 0.0))


def test_licenses_equal_brute_force(spark):
    texts = [
        "All rights reserved.", "ALL\nrights - reserved all rights reserved all rights", "CC BY cc-by cc by", "cc  by", "accc by", "cc bye", "Licensed under CC BY-NC 4.0.", "x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0",
        "This work is licensed under the GNU General Public License, version 3.", "general public license" * 2, "ünïcode all rights reserved é", "", None, "   ", "Permission is granted free of charge to any person obtaining a copy of this software and associated files", "licence " * 3000 + "cc by",
        "Licensed under the Apache License", "released under mit", "ÀLL rights reserved",
    ]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(1, texts[1], "z"), (None, texts[0], "z")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got) == Counter((i, *scan_by_hand(t)[:-1], round(scan_by_hand(t)[-1], 9)) for i, t, _ in rows)
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_over_line_ends(spark):
    rng = np.random.default_rng(3)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    pads = [0, 1, 27, 28, 29, 30, 55, 56, 57, 400]
    rows = [(k, f"{prose(rng, n)}\n{mit}\n{prose(rng, 9)}") for k, n in enumerate(pads)] + [(100 + k, f"{prose(rng, n)} {bsd.replace(' ', chr(10))}") for k, n in enumerate(pads)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ("mit" if i < 100 else "bsd", 1.0) for i, _ in rows}


def test_licenses_need_the_word_that_tells_them_apart(spark):
    texts = {
        "Released under the BSD License": "", "Released under the Apache License": "", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under the Mozilla Public License, Version 2.0": "", "Licensed under the GNU General Public License, version 2": "gpl", "Licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl",
        "released by the mit students under a license": "", "Released under MIT license": "mit", "the license was released under mit": "", "Licensed under the GNU Affero General Public License, version 3": "agpl,gpl",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense",
        "Released under the MIT License": "mit", "released as mit was, " + "so it is " * 30 + "under the license": "", "Licensed under the Apache License": "",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "",
    }
    got = {r.text: r.labels for r in licenses.scanned(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).withColumnRenamed("doc_id", "text").collect()}
    assert got == texts


def curve(order, bits, dims):
    """Cells in the order of their index."""
    return [c for c, _ in sorted(order.items(), key=lambda x: x[1])]


@pytest.mark.parametrize("bits, dims", [(1, 2), (3, 2), (2, 3), (3, 3)])
def test_hilbert_neighbours_touch(spark, bits, dims):
    n = 1 << bits
    frame = spark.range(n**dims)
    coords = [(F.col("id") / F.lit(n**k)).cast("long") % n for k in range(dims)]
    got = sharding.with_hilbert_index(frame, coords, bits, "h").collect()
    cells = curve({tuple(r.id // n**k % n for k in range(dims)): r.h for r in got}, bits, dims)
    assert sorted(r.h for r in got) == list(range(n**dims))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(cells, cells[1:]))


def test_shards(spark, corpus):
    import zlib

    rows, docs = corpus
    got = sharding.hilbert_shards(docs, 7).toPandas()
    assert Counter(zip(got["size"], got.text_crc32)) == Counter((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = got.groupby("shard").size()
    assert sorted(counts.index) == list(range(7)) and counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    ordered = got.sort_values(["shard", "slot"])
    assert ordered.hilbert.is_monotonic_increasing and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    places = ordered.reset_index(drop=True).groupby("text_crc32").apply(lambda p: p.index.max() - p.index.min() + 1 == len(p), include_groups=False)
    assert places.all()
    assert sharding.hilbert_shards(docs.limit(0)).count() == 0 and sharding.hilbert_shards(docs.limit(2)).count() == 2


def test_encoding_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    rows, docs = corpus
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encoded(docs, with_ids=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got) and bpe.encoded(docs.limit(0)).count() == 0


def labelled(spark):
    rng = np.random.default_rng(6)
    bad, rows, labels = ["scumbag", "idiotic", "worthless"], [], []
    for i in range(600):
        ws = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            ws[int(rng.integers(0, 30))] = bad[i % 3]
        rows.append((i, " ".join(ws), "en"))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_and_disguised_rows(spark):
    rows, labels = labelled(spark)
    extra = [(9001, "aeino w0rthle55 snrot", "x"), (9002, "anein i d i o t i c tesan", "x"), (9003, "", "x"), (9004, None, "x"), (9005, "s.c.u.m.b.a.g", "x"), (None, "aeino", None), (9006, "1234 !!! 555", "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs.withColumn("held_out", language.held_out(F.col("doc_id"), 5, 0)), model, ["held_out"]).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(got) == len(rows) + len(extra) and len(held) > 60 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.98
    assert all(by[i].predicted == 1 for i in (9001, 9002, 9005)) and all(by[i].predicted == 0 for i in (9003, 9004, None, 9006)) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and toxicity.scored(docs, none).first().score == 0.0
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_language_on_held_out_rows(spark):
    rng = np.random.default_rng(9)
    kinds = {"xx": "abcde", "yy": "defgh", "zz": "hijéñ"}
    rows = [(i, " ".join("".join(rng.choice(list(kinds[k]), 4)) for _ in range(12)), k) for i in range(300) for k in [list(kinds)[i % 3]]]
    rows += [(901, None, "xx"), (902, "", "xx"), (903, "12 34 !", "yy"), (904, "a", None), (None, "abcde abc", "xx"), (905, "hijé " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.held_out(F.col("doc_id"), 3, 1)
    got = language.predicted(docs.withColumn("held_out", out), language.fit(docs, ~out, 50), ["held_out"]).collect()
    by = {r.doc_id: r for r in got}
    held = [(r, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 60 and np.mean([r.lang_pred == k for r, k in held]) > 0.98
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (901, 902, 903)) and by[905].lang_pred == "zz" and len(got) == len(rows)
    none = language.fit(docs.limit(0), ~out)
    assert none is None and language.predicted(docs, none).where("lang_pred <> 'und'").count() == 0


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", "<article><h1>A title of it</h1><p>Some text, with words, and more of them. Yes.</p></article><footer>x</footer>", 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<p>", 5), (3, "u", "", 5)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["A title of it\n\nSome text, with words, and more of them. Yes."]


def test_registry_names_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert json.dumps(sorted(oracle_sql()))


def test_short_items_are_all_found(spark):
    """Items of one shingle and more, each whole or with one word in nine changed, inside long documents."""
    rng = np.random.default_rng(12)
    items, docs = [], []
    for n in range(5, 30):
        for k in range(8):
            words = [f"w{n}x{k}y{i}" for i in range(n)]
            items.append((n * 100 + k, " ".join(words)))
            docs.append((n * 100 + k, f"{prose(rng, 300)} {' '.join(words)} {prose(rng, 200)}"))
            if k == 0 and n >= 9:
                docs.append((50_000 + n, f"{prose(rng, 50)} {' '.join(words[: n // 2])} other {' '.join(words[n // 2 :])}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, i) for d, t in docs for i, x in items if len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x)) - 1e-9 and x.split()[0] in t}
    for broadcast in (1000, 0):
        got = {(r.doc_id, r.item_id) for r in contamination.contained(frame, spark.createDataFrame(items, "item_id long, text string"), broadcast=broadcast).collect()}
        assert got == want and len(got) >= 200


def test_bitmap_has_cells_for_all_keys(spark):
    table = spark.createDataFrame([([1, 2, 1 << 40],), ([-5],), ([],)], "keys array<long>")
    bits = contamination._bitmap(table, "keys", 4)
    known = np.array([1, 2, 1 << 40, -5], dtype=np.int64).astype(np.uint64)
    assert bits.holds(known).all() and not bits.holds(np.array([7, 9], dtype=np.uint64)).any() and bits.holds(known.reshape(2, 2)).shape == (2, 2)
    assert len(contamination._bitmap(table, "keys", 10**6).packed) * 8 == 1 << 24


def test_pivots_and_salts_grow_with_the_rows(spark):
    assert [knn.pivots_for(n) for n in (0, 10_000, 10**6, 10**12)] == [16, 16, 125, 256] and [knn.salts_for(n) for n in (100, 10**9, 10**12)] == [8, 59, 64]
    rng = np.random.default_rng(14)
    x = rng.integers(-9, 9, (400, 5))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    few, many = ({tuple(r) for r in knn.topk(frame, F.col("vec_id") % 50 == 0, 7, p).collect()} for p in (1, 64))
    assert few == many and len(few) == 56


def test_more_languages_have_fewer_rows_each(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 30)
    rows = [(i, "abcdefghij"[i % 10] * 9 + " " + "klmnopqrst"[i % 10] * 5, f"l{i % 10}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in language.predicted(docs, model).collect()}
    assert len(model.langs) == 10 and got == {(i, lang) for i, _, lang in rows}


def test_templates_of_a_caller(spark):
    docs = spark.createDataFrame([(1, "This file\nmay be used under the\nFalcon terms of   use."), (2, "used under the terms of use"), (3, None), (4, "word " * 5000 + "used under the falcon terms of use" + " word" * 5000)], "doc_id long, text string")
    own = {"falcon": ["may be used under the falcon terms of use"]}
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in licenses.scanned(docs, 0.75, own, {own["falcon"][0]: "falcon"}).collect()}
    assert got == {1: ("falcon", 1.0), 2: ("", 0.0), 3: ("", 0.0), 4: ("falcon", 0.778)}


def test_letter_counts_and_scores_equal_brute_force(spark):
    rows, labels = labelled(spark)
    long = "aeino w0rthle55 " * 20_000 + "i" * 5000 + " x" * 3000
    rows = [*rows[:120], rows[0], rows[0], (9001, long, "x"), (9002, None, "x"), (9003, "ß ıŒ é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(1)
    want = Counter()
    codes = [[toxicity.letter(c) for c in (t or "").lower()] for _, t, _ in rows]
    for x in codes:
        want.update(zip(x, x[1:], x[2:]))
    got = toxicity.trigram_counts(docs)
    inner = {k: int(n) for k, n in np.ndenumerate(got) if n and 0 not in k}
    assert inner == {k: n for k, n in want.items() if 0 not in k}
    model = toxicity.fit(docs, labels)
    alone = {}
    for i, text, _ in rows:
        z = model.base + sum(model.weights.get(f, 0.0) for f in toxicity.features(model.restorer.words(text or "")))
        alone[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) and all(abs(r.score - alone[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id == rows[0][0]}) == 1


def test_language_model_is_kernel_ridge_regression(spark):
    """With every row a landmark, the margins are those of the dual solution over the kernel of n-gram sets."""
    rng = np.random.default_rng(15)
    texts = ["".join(rng.choice(list(a), 30)) for a in ("abcd", "cdefg", "xyza") for _ in range(12)]
    langs = [k for k in ("p", "q", "r") for _ in range(12)]
    x = np.concatenate([s for *_, s in language.spectra(pa.array([*texts, *texts[:3], "abxy cd"]))])
    train, asked = x[: len(texts)], x[len(texts) :]
    model = language.fitted((train > 0).astype(np.uint8), langs)
    size = lambda m: np.sqrt(m.sum(1))
    kernel = lambda a, b: (a @ b.T) / size(a)[:, None] / size(b)[None, :]
    target = np.where(np.array(langs)[:, None] == np.array(model.langs)[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(kernel(train, train) + language.RIDGE * len(langs) * np.eye(len(langs)), target)  # every language has as many rows
    want = kernel(asked, train) @ alpha
    margins = (asked @ model.weights) / size(asked)[:, None]
    assert np.abs(margins - want).max() < 1e-3 and (margins.argmax(1) == want.argmax(1)).all()
    docs = spark.createDataFrame([(1, "abab"), (1, "abab"), (2, "abab")], "doc_id long, text string")
    same = {(r.lang_pred, r.score) for r in language.predicted(docs, model).collect()}
    assert len(same) == 1
    tied = language.Model(["a", "b"], np.zeros((language.CELLS, 2), np.float32))
    assert {(r.lang_pred, r.score) for r in language.predicted(docs, tied).collect()} == {("a", 0.5)}  # ties go to the first language
