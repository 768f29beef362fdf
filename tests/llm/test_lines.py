import hashlib
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import lines

DOCS = "doc_id long, text string, lang string, share int, h1 long, _gone string, n_lines long"
WS = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(texts, least_docs=10, least_chars=1):
    keys = [[low(x.strip(WS)) for x in (t or "").split("\n")] for t in texts]
    df = Counter(k for own in keys for k in set(own) if len(k) >= least_chars)
    out = []
    for t, own in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), own, strict=True) if df[k] < least_docs]
        out.append((len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(4)
    common = [f"Line {i} of all" for i in range(60)]
    texts = ["\n".join(common[k] for k in rng.integers(0, 60, rng.integers(1, 7))) for _ in range(80)]
    texts += ["own %d\nHot LINE\r\nEnd" % i for i in range(40)] + ["  hot line\t\n%d" % i for i in range(5)] + ["seen nine\nx%d" % i for i in range(9)] + ["seen ten\ny%d" % i for i in range(10)]
    texts += ["copy\nof\none"] * 30 + [None, None, "", "", "\n", "\n\n\n", "É\x0b", "é", "İ", " nbsp ", "a\n" * 5000 + "hot line", "twice\ntwice\ntwice", "Hot line\n\n hot LINE "]
    return texts


@pytest.mark.parametrize("batches,fanout,parts", [(1, 4, 3), (7, 2, 9), (3, 3, 6)])
def test_lines_equal_brute_force(spark, tmp_path, batches, fanout, parts):
    """Nulls, empty and very long texts, lines of nine and ten documents, repeated rows, columns named as those made here."""
    texts = corpus()
    rows = [(None if i % 50 == 3 else i, t, "en", 1, 2, "g", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = lines.deduped(docs, ["doc_id", "_gone"], batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "_gone", "text", "n_lines", "n_dropped"]
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect())
    assert found == Counter((r[0], *b) for r, b in zip(rows, brute(texts), strict=True))
    assert not spark.catalog.listTables()


def test_other_bounds(spark):
    texts = ["ab\nabc\nÉÉ"] * 4 + ["abc"]
    got = lines.deduped(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"], least_docs=3, least_chars=3)
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got.collect()) == [(0, "ab\nÉÉ", 1), (1, "ab\nÉÉ", 1), (2, "ab\nÉÉ", 1), (3, "ab\nÉÉ", 1), (4, "", 1)]


def test_empty_table_and_query(spark, tmp_path):
    assert lines.deduped(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
    spark.createDataFrame([(i, "Same\nown %d" % i, "x", 1, 2, "g", 3) for i in range(12)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = lines.op11_line_dedup(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    assert sorted(tuple(r) for r in got.collect()) == [(i, 2, 1, hashlib.sha256(b"own %d" % i).hexdigest()) for i in range(12)]


def test_settled_keys_are_not_counted_again(spark):
    runs = lines.Runs(spark, least=10, fanout=3)
    batch = lambda pairs: spark.createDataFrame([(k, k, n) for k, n in pairs], "h1 long, h2 long, n long")
    runs.add(batch([(1, 6), (1, 6), (2, 4), (3, 1)]))
    runs.add(batch([(1, 50), (2, 5)]))
    own = spark.table(runs.levels[0][1][0])
    assert [(r.h1, r.n) for r in own.collect()] == [(2, 5)]
    plan = runs.frequent()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    runs.add(batch([(2, 1), (3, 8)]))
    assert [len(x) for x in runs.levels] == [0, 1] and sorted(r.h1 for r in runs.frequent().collect()) == [1, 2]
    runs.clear()
    assert not spark.catalog.listTables()
