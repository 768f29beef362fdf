"""Spelling variants: words one edit apart, each led to its most frequent spelling, by Aho-Corasick halves.

A word with one edit keeps one half of the word it came from: the left half at its start or the right half at its end.

1. Words are counted over all texts.
2. Every word is a pattern with two segments, its halves, and a text. A segment is dealt by the hash of itself, its
   place and its word's length; a text by those of its own that a segment could equal, so it meets every segment that it
   holds in the right place. Segments that too many words share are cut again: what stands between what is known has one
   edit, so one half of that is kept too. Words that share all but one character are few, so this ends.
3. A shard's automaton holds its segments. All its words are scanned once; a hit counts if its place and the lengths fit,
   and if the whole words are one edit apart. Patterns of one segment are looked up by their other half with one
   character out, so a segment of many words costs each of them as little as one of few.
4. A pair that shares both halves is told by the left one only, so each shard gives finished counts for its words.
5. Forms are followed to their roots by doubling; n grows tenfold with each form, which bounds the rounds.

Cases: a null or empty text has no words; a null doc_id deletes nothing from a run; rows that repeat count each; words of
any length are whole, but one character has no halves, so words have two at least; equal counts fall to the word that is first in code-point order; a table without words gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle import CRC_TABLE, sql_crc32
from .scratch import dropped, written
from .textkernel import released

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_N, EVERY, TIMES = 7, 2, 31, 10
SHARD_ROWS, HOT_ROWS = 100_000, 20_000
FEW = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROUTE = "key long, word string, n long, m int, path string, pattern boolean"
FOUND = "word string, n_near long, form_n long, form string"


def words_of(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, every: int = EVERY) -> DataFrame:
    """word and n of all words; one run in `every` loses a character, by the checksum of its document and itself."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(every)) == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= least_chars) & (F.col("n") >= least_n))


def known(m: int, path: str) -> tuple[int, int]:
    """How many characters at the start and at the end of a word of m are known to be kept, after these halves."""
    a = b = 0
    for side in path:
        half = (m - a - b) // 2
        if side == "L":
            a += half
        else:
            b = m - a - half
    return a, b


def segment(word: str, m: int, path: str) -> tuple[int, int]:
    """Where the segment that the last half gives begins in a word, and its length. The word has m characters, or one
    more if it may hold a pattern of m."""
    a, b = known(m, path[:-1])
    half = (m - a - b) // 2
    return (a, half) if path[-1] == "L" else (len(word) - (m - a - half), m - a - b - half)


def key_of(word: str, m: int, path: str) -> int:
    a, b = known(m, path)
    return xxhash.xxh3_64_intdigest(f"{m} {a} {b} {word[:a]} {word[len(word) - b :]}") - (1 << 63)


def one_edit(w: str, t: str) -> bool:
    """Whether t, as long as w or one longer, differs from it by exactly one character replaced or inserted."""
    i, n = 0, len(w)
    while i < n and w[i] == t[i]:
        i += 1
    return w[i + 1 :] == t[i + 1 :] and i < n if len(t) == n else w[i:] == t[i + 1 :]


def told_here(w: str, t: str, path: str) -> bool:
    """Whether this is the one path that tells the pair: at each cut the left half, if t keeps that of the pattern w."""
    m = len(w)
    for k, side in enumerate(path):
        a, b = known(m, path[:k])
        half = (m - a - b) // 2
        if (w[a : a + half] == t[a : a + half]) != (side == "L"):
            return False
    return True


class Bucket:
    """The patterns of one segment in one place: their words, and when there are many, an index of what isn't known."""

    def __init__(self, m: int, path: str):
        self.m, self.path, self.words, self.index = m, path, [], None
        self.a, self.b = known(m, path)

    def candidates(self, t: str) -> list[str]:
        if len(self.words) <= FEW:
            return self.words
        if self.index is None:
            self.index = {}
            for w in self.words:
                rest = w[self.a : self.m - self.b]
                for k in [(-1, rest), *((i, rest[:i] + rest[i + 1 :]) for i in range(len(rest)))]:
                    self.index.setdefault(k, []).append(w)
        rest, longer = t[self.a : len(t) - self.b], len(t) > self.m
        found = {}
        for i in range(len(rest)):
            for w in self.index.get((-1 if longer else i, rest[:i] + rest[i + 1 :]), ()):
                found[w] = True
        return list(found)


def routed(words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first halves of words (word, n)."""
    for batch in words:
        rows = []
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for path in "LR":
                rows += [(key_of(w, m, path), w, n, m, path, m == len(w)) for m in (len(w), len(w) - 1) if m > 1]
        yield _batch(rows)


def rerouted(routes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next halves of routes."""
    for batch in routes:
        rows = []
        for _, w, n, m, path, pattern in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(key_of(w, m, path + side), w, n, m, path + side, pattern) for side in "LR"]
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "word", "n", "m", "path", "pattern"])


def searched(key, table):
    """One shard: for its words how many patterns here are near, and the best of them."""
    count, segments, automaton = {}, {}, ahocorasick.Automaton()
    for w, n, m, path, pattern in zip(*(table.column(c).to_pylist() for c in ("word", "n", "m", "path", "pattern")), strict=True):
        count[w] = n
        if pattern:
            at, size = segment(w, m, path)
            places = segments.setdefault(w[at : at + size], {})
            place = (at, -1, m, path) if path[-1] == "L" else (-1, m - at - size, m, path)
            places.setdefault(place, Bucket(m, path)).words.append(w)
    for s, places in segments.items():
        automaton.add_word(s, (len(s), places))
    near: dict[str, list] = {}

    def told(w: str, other: str) -> None:
        n = count[other]
        got = near.setdefault(w, [0, 0, ""])
        got[0] += 1
        if n > got[1] or n == got[1] and other < got[2]:
            got[1:] = n, other

    if segments:
        automaton.make_automaton()
        for t in count:
            for end, (size, places) in automaton.iter(t):
                start = end + 1 - size
                for (at, left, m, path), bucket in places.items():
                    if not 0 <= len(t) - m <= 1 or (start != at if left < 0 else len(t) - end - 1 != left):
                        continue
                    for w in bucket.candidates(t):
                        if one_edit(w, t) and told_here(w, t, path):
                            told(t, w)
                            if len(t) > m:
                                told(w, t)
    released()
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    cols = [list(near), *([v[k] for v in near.values()] for k in range(3))]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("word", "n_near", "form_n", "form"), cols, kinds, strict=True)})


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, n_near, and form and form_n: the near word of largest n, the first of them in code-point order. words: word, n."""
    spark = words.sparkSession
    routes, at = written(words.mapInArrow(routed, ROUTE), "routes")
    cold, paths = None, []
    while True:
        a_key = routes.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("m").alias("m"), F.min("path").alias("path"))
        # of what the others know all but one to three characters; the letters bound how many words that can be
        hot, hot_at = written(a_key.where((F.col("rows") > hot_rows) & (F.col("m") >= F.pow(F.lit(2), F.length("path") + 1))).select("key"), "hot")
        paths += [at, hot_at]
        if not hot.head(1):
            cold = routes if cold is None else cold.unionByName(routes)
            break
        rest = routes.join(hot, "key", "left_anti")
        cold = rest if cold is None else cold.unionByName(rest)
        routes, at = written(routes.join(hot, "key", "left_semi").select(*routes.columns).mapInArrow(rerouted, ROUTE), "routes")
    shards = max(1, math.ceil(cold.count() / shard_rows))
    found = cold.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(searched, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    out, _ = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "near")
    dropped(spark, *paths)
    return out


def rooted(forms: DataFrame, rounds: int) -> DataFrame:
    """word and root: forms (word, form) followed up to 2 ** rounds times."""
    spark = forms.sparkSession
    now, at = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after, after_at = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        dropped(spark, at)
        now, at = after, after_at
    return now


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, every: int = EVERY, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    if least_chars < 2:
        raise ValueError("words of one character have no halves")
    words, _ = written(words_of(docs, least_chars, least_n, every), "words")
    most = words.agg(F.max("n")).first()[0] or 0
    near = near_words(words)
    near = near.join(words, "word", "right").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")
    is_form = F.col("form_n") >= F.col("n") * times
    near, _ = written(near.select("word", "n", "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    hops = max(1, math.floor(math.log(max(most, 1), times)) + 1)
    roots = rooted(near.where("form is not null"), math.ceil(math.log2(hops)))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BYTES = "list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))"
ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
x AS (SELECT run, hex(encode(doc_id || ':' || run)) AS x FROM r WHERE length(run) >= 7),
h AS (SELECT run, {sql_crc32(_BYTES)} AS h FROM x, crc),
c AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
o AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word AS word, b.word AS near FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT o.word, w.word FROM o JOIN w ON w.word = o.rest UNION SELECT w.word, o.word FROM o JOIN w ON w.word = o.rest),
b AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY w.n DESC, encode(p.near)) AS form, max(w.n) AS form_n FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT g.word, f.form, k + 1 FROM g JOIN f ON f.word = g.here WHERE f.form IS NOT NULL),
t AS (SELECT word, arg_max(here, k) AS root FROM g GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word)
"""
