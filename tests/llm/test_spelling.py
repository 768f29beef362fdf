import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import spelling

DOCS = "doc_id long, text string, lang string, word string, n long, key long, path string"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a))) if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            if d is not None and (h := zlib.crc32(f"{d}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute(words):
    """(word, form, root, n, n_near, form_n)"""
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        found = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, n_near[w], words[form[w]] if w in form else None))
    return sorted(out)


def vocabulary(seed=3):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéÿß")
    words = {}
    for _ in range(60):
        w = "".join(rng.choice(letters, rng.integers(7, 15)))
        words[w] = int(rng.integers(2, 3000))
        for _ in range(12):
            i, c = int(rng.integers(0, len(w))), str(rng.choice(letters))
            for x in (w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]):
                words.setdefault(x, int(rng.integers(2, 40)))
    return words


def by_frames(spark, words, **kw):
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), **kw)
    return {r.word: (r.n_near, r.form, r.form_n) for r in got.collect()}


def by_hand(words):
    out = {}
    for w in words:
        found = [x for x in words if near(w, x)]
        if found:
            best = min(found, key=lambda x: (-words[x], x))
            out[w] = (len(found), best, words[best])
    return out


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 300, "hot_rows": 1}, {"shard_rows": 50, "hot_rows": 6}])
def test_near_words_equal_brute_force(spark, kw):
    """One shard and many; segments that are cut as far as they can be; short words, and words that share a half."""
    words = vocabulary() | {w: 5 for w in ("ab", "abc", "bb", "ac", "x" * 3000, "x" * 3001, "x" * 2999 + "y")}
    words |= {"gemeinsam" + x: 3 + k for k, x in enumerate(["abcdefg", "abcdefh", "abcdxfg", "abcdefgh", "bcdefg", "zzzzzzz"])} | {f"{a}{b}cdeestimmung": 4 for a in "abcdefgh" for b in "abcdefgh"}
    assert by_frames(spark, words, **kw) == by_hand(words)


def test_one_segment_of_many_words_is_looked_up(monkeypatch):
    words = {f"{a}{b}{c}ymmetrischerweise": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    asked = []
    whole = spelling.one_edit
    monkeypatch.setattr(spelling, "one_edit", lambda w, t: asked.append(1) or whole(w, t))
    batch = pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())})
    table = pa.Table.from_batches(list(spelling.routed([batch])))
    got = spelling.searched(None, table)
    assert set(got.column("n_near").to_pylist()) == {21} and len(asked) < 60 * len(words)


def test_one_edit():
    rng = np.random.default_rng(6)
    for _ in range(4000):
        w = "".join(rng.choice(list("ab"), rng.integers(1, 7)))
        t = "".join(rng.choice(list("ab"), len(w) + rng.integers(0, 2)))
        assert spelling.one_edit(w, t) == near(w, t), (w, t)


def rows():
    rng = np.random.default_rng(2)
    base = ["Bestimmung", "weitergehen", "élévation", "straßenlaterne", "possible", "possibly", "information"]
    texts = [" ".join(rng.choice(base, 40)) for _ in range(60)]
    texts += ["informatoin informatoin informatiön informatiön", "short six sevensx", "  ", "", None, "a" * 5000 + " " + "A" * 5000, "x×y÷zabcd X×Y÷ZABCD", "naïvetés naïvetés NAÏVETÉS"]
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[1])]


def test_query_equals_brute_force(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns named as those made here."""
    spark.createDataFrame([(*r, "en", "w", 1, 2, "p") for r in rows()], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = spelling.op12_spelling_variants(spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == brute(counts(rows()))


def test_forms_are_followed_to_the_end(spark):
    words = {"abcdefgh": 5000, "abcdefgi": 400, "abcdefhi": 30, "abcdeghi": 2, "zzzzzzzz": 9}
    docs = spark.createDataFrame([(None, " ".join(w for w, n in words.items() for _ in range(n)))], "doc_id long, text string")
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    assert got == brute(words) and {r[2] for r in got} == {"abcdefgh", "zzzzzzzz"}


def test_tables_without_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "none here"), (2, None)], "doc_id long, text string")).count() == 0
