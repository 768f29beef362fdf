import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf int, tree string, pos int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def rising(nodes):
    """All levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at - at % 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 512, 513, 700, 4095, 4096])
def test_the_walk_gives_every_authentication_path(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = rising(leaves)
    height = merkle.levels_of(n)
    assert height == len(levels) - 1 and merkle.hashed(leaves, height) == levels[-1][0]
    assert [list(p) for p in merkle.walked(leaves, height)] == [siblings(levels, i) for i in range(n)]


def test_a_treehash_holds_little():
    tree, most = merkle.Treehash(4), 0
    for i in range(4096):
        tree.push(sha(str(i)))
        most = max(most, sum(map(len, tree.stack)))
    assert most == 4 * 7 and len(tree.close()) == 1


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda d, t, lang, s, n: sha(field(d), field(s), field(lang), field(n), field(t))
    trees = {}
    for d, t, lang, s, n in rows:
        told = leaf(d, low(t), lang, s, n) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf(d, t, lang, s, n)
        trees.setdefault((lang is not None, (lang or "").encode()), []).append(((d is not None, d or 0), leaf(d, t, lang, s, n), told))
    names = sorted(trees)
    grown = {k: rising([x[1] for x in sorted(trees[k])]) for k in names}
    forest = rising([grown[k][-1][0] for k in names])
    out = []
    for k in names:
        for at, ((known, d), own, told) in enumerate(sorted(trees[k])):
            path = siblings(grown[k], at) + siblings(forest, names.index(k))
            fold = told
            for a, b in path:
                fold = sha(a, fold, b)
            root = forest[-1][0]
            out.append((d if known else None, own, grown[k][-1][0], root, sha(*[a + b for a, b in path]), fold, fold == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    full = [(*r, 1, "t", 2, "p") for r in rows]
    spark.createDataFrame(full, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_manifest_equals_brute_force(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, empty and very long texts, and columns named as those made here."""
    rows = [(i * 3, f"Text {i} É", ["en", "de", None, "fr", ""][i % 5], "S" if i % 3 else None, i) for i in range(150)]
    rows += [(5, None, "en", None, None), (None, "A b", "en", "s", 1), (None, "A b", "en", "s", 1), (7, "", "ü", "s", 0), (7, "X" * 200_000, "ü", "s", 1), (9, "one", "zz", "s", 1), rows[3], rows[3]]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_one_key_of_many_blocks(spark, tmp_path):
    rows = [(i, "T", "en", "s", 1) for i in range(2 * merkle.BLOCK + 9)] + [(i, "T", "de", "s", 1) for i in range(70)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_many_keys(spark, tmp_path):
    rows = [(i, "Tx", f"l{i}", "s", 1) for i in range(600)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "Aa", "en", "s", 1)], [(1, "Aa", "en", "s", 1), (2, "b", "de", None, None)]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == brute(rows)


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("k").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.manifest(rows).withColumn("right", merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).withColumn("wrong", merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root"))
    assert [(r.right, r.wrong) for r in got.select("right", "wrong").distinct().collect()] == [(True, False)]
