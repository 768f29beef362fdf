"""Toxicity by a noisy channel: restore hidden words, then score the restored text.

1. A character trigram model of letters is counted over all documents.
2. Words that may be disguised (digits or symbols for letters, also at the ends, doubled letters and runs of one letter,
   single letters set apart) become lattices: each position holds the letters that it may stand for, with the channel's
   cost. Where letters are set apart or a word is very long, there may be word borders too. Viterbi search under the
   trigram model gives the most likely letters, in overlapping pieces of long lattices. Other words have one reading,
   themselves.
3. Restored words and their beginnings of 4 to 6 letters are the features. Presence counts over a sample of labelled
   rows select the features with the highest likelihood-ratio statistic, and logistic regression weighs them.

The fit uses at most TRAIN_ROWS labelled rows, taken by a hash of doc_id, and at most FEATURES features. The trigram
counts and the scores read every row and the whole text.

Cases: a null text is an empty one, whose score is the model's base rate; without labelled rows every score is 0; of
several labels for one doc_id the greatest counts, null labels don't; equal texts get equal scores; very long texts
are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .scratch import dropped, written

TRAIN_ROWS = 12_000
FEATURES = 3_000
LEAST_G2 = 10.0
LETTERS = 60
CACHED = 500_000
#: What a character may stand for beside itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "&": "a", "%": "o",
}
#: Letters of other scripts that look like Latin ones.
LOOKS_LIKE = str.maketrans({
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ӓ": "ä", "ё": "ë", "ї": "ï", "ӧ": "ö",
})
_LATIN = re.compile(r"[a-z]")
_ENDS = ".,;:!?\"'()[]{}<>«»“”‘’…-–—_/\\`~^=%#&*"
_JOINERS = set(".,-_*'/\\~|:;+=·")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t\n]{1,2}){2,}\S(?!\S)")
_RUN = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1")
_NO_LETTER = "".join(c for c in _ENDS if c not in STANDS_FOR)
#: Longer lattices are read in pieces of 2 * STEP positions, each STEP after the last, and may hold several words.
LONG, STEP = 40, 40
#: The channel's cost of a word border where nothing shows one, and of none where two spaces are.
BORDER = 0.5


def _letter_table() -> np.ndarray:
    """Index of each character below U+0250: a to z 1 to 26, U+00DF to U+00FF 27 to 58, other letters 59, else 0."""
    table = np.zeros(0x251, dtype=np.int64)
    for c in range(0x250):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch) - 96 if "a" <= ch <= "z" else c - 0xDF + 27 if 0xDF <= c <= 0xFF and c - 0xDF + 27 < 59 else 59
    return table


_TABLE = _letter_table()


def letter(ch: str) -> int:
    c = ord(ch)
    return int(_TABLE[c]) if c < 0x250 else 59 if ch.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three letters follow one another, over all rows. The alphabet bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 256):
                chars = np.frombuffer("  ".join(t for t in texts[k : k + 256] if t).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                x = _TABLE[np.minimum(chars, 0x250)]
                if len(x) > 2:
                    total += np.bincount(x[:-2] * LETTERS**2 + x[1:-1] * LETTERS + x[2:], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    got = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(LETTERS**3, dtype=np.int64)
    out[got.code.to_numpy(dtype=np.int64)] = got.n.to_numpy(dtype=np.int64)
    return out.reshape(LETTERS, LETTERS, LETTERS)


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), with lower orders as the prior of higher ones."""
    c3 = counts.astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * LETTERS)
    p2 = (c2 + 8 * p1) / (c2.sum(axis=1, keepdims=True) + 8)
    p3 = (c3 + 8 * p2) / (c3.sum(axis=2, keepdims=True) + 8)
    return -np.log(p3)


class Restorer:
    """Restores the words of texts by Viterbi search under the letter model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.flat = costs.astype(np.float32).ravel().tolist()
        self.cache: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return self.costs.astype(np.float32)

    def __setstate__(self, state):
        self.__init__(state)

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """For each position of the lattice the strings that it may stand for, with the channel's costs."""
        out, i = [], 0
        while i < len(token):
            ch, j = token[i], i
            while j < len(token) and token[j] == ch:
                j += 1
            if ch.isalpha():
                out.append([(ch, 0.0)] if j - i == 1 else [(ch * 2, 0.0), (ch, 1.0)] if j - i == 2 else [(ch, 0.5), (ch * 2, 1.0)])
            else:
                may = [(c * (j - i if j - i < 3 else 1), 0.7) for c in STANDS_FOR.get(ch, "")]
                if j - i == 2:
                    may += [(c, 1.7) for c in STANDS_FOR.get(ch, "")]
                if ch in _JOINERS or not may:
                    may.append(("", 0.7))
                out.append(may)
            i = j
        return out

    def best(self, lattice: list[list[tuple[str, float]]], n: int = 3) -> list[str]:
        """The likeliest strings of letters through the lattice, best first."""
        states = {(0, 0): (0.0, "")}
        flat = self.flat
        for options in lattice:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for add, channel in options:
                    x, y, c = a, b, cost + channel
                    for ch in add:
                        z = letter(ch)
                        c += flat[(x * LETTERS + y) * LETTERS + z]
                        x, y = y, z
                    if (x, y) not in after or c < after[x, y][0]:
                        after[x, y] = (c, text + add)
            states = after
        ended = sorted((c + flat[(a * LETTERS + b) * LETTERS], t) for (a, b), (c, t) in states.items())
        return [t for _, t in ended[:n]]

    def several(self, lattice: list[list[tuple[str, float]]], n: int = 3) -> list[str]:
        """The words of the n likeliest readings of a lattice with spaces in it, best first; of any length, in pieces."""
        out: list[str] = []
        flat = self.flat
        for at in range(0, max(1, len(lattice) - STEP), STEP):
            states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
            for options in lattice[at : at + 2 * STEP]:
                after: dict[tuple[int, int], list[tuple[float, str]]] = {}
                for (a, b), paths in states.items():
                    for add, channel in options:
                        x, y, c = a, b, channel
                        for ch in add:
                            z = letter(ch)
                            c += flat[(x * LETTERS + y) * LETTERS + z]
                            x, y = y, z
                        after.setdefault((x, y), []).extend([(cost + c, text + add) for cost, text in paths])
                states = {k: sorted(paths)[:n] for k, paths in after.items()}
            ended = sorted((c + flat[(a * LETTERS + b) * LETTERS], t) for (a, b), paths in states.items() for c, t in paths)
            for _, text in ended[:n]:
                words = text.split()
                if len(words) > 2:  # what goes on beyond the piece is whole in another one
                    words = words[at > 0 : len(words) - (at + 2 * STEP < len(lattice))]
                out += words
        return list(dict.fromkeys(out))

    def decoded(self, lattice: list[list[tuple[str, float]]], n: int = 3) -> list[str]:
        """The likeliest words of a lattice; several, between any positions, if it is long."""
        if len(lattice) <= LONG:
            return [t for t in self.best(lattice, n) if t]
        made: dict[tuple, list[tuple[str, float]]] = {}
        return self.several([made.setdefault(tuple(o), [*o, *((" " + x, c + BORDER) for x, c in o)]) for o in lattice], n)

    def reduced(self, word: str) -> tuple[str, ...]:
        """A word of letters and the likeliest of those with one letter for some of its doubled ones."""
        at = [m.start() for m in _TWICE.finditer(word)]
        if any(b - a == 2 for a, b in zip(at, at[1:])):
            return tuple(dict.fromkeys([word, *self.decoded(self.readings(word), 1)]))
        # doubled letters that others part don't bear on one another
        out, codes = word, [0, *map(letter, word), 0]
        for k in reversed(at):
            b, x, c = codes[k], codes[k + 1], codes[k + 3]
            if 1.0 + self.flat[(b * LETTERS + x) * LETTERS + c] < self.flat[(b * LETTERS + x) * LETTERS + x] + self.flat[(x * LETTERS + x) * LETTERS + c]:
                out = out[:k] + out[k + 1 :]
        return (word, out) if out != word else (word,)

    def word(self, token: str) -> tuple[str, ...]:
        """The words that a lower-case token stands for, none if it has no letters. Where it has Latin letters beside some
        that look like them, these stand for Latin ones too."""
        if not token.isascii():
            latin = token.translate(LOOKS_LIKE)
            if latin != token and _LATIN.search(token):
                return tuple(dict.fromkeys([*self._word(latin), *self._word(token)]))
        return self._word(token)

    def _word(self, token: str) -> tuple[str, ...]:
        whole = token.strip(_NO_LETTER)
        if whole.isalpha() and not _RUN.search(whole):
            return self.reduced(whole) if _TWICE.search(whole) else (whole,)
        plain = token.strip(_ENDS)
        bare = plain.rstrip("$").lstrip("$") if plain.count("$") > 2 else plain
        out: list[str] = []
        if bare.isalpha() and not _RUN.search(bare):
            out = [*self.reduced(bare)]
        elif any(map(str.isalpha, bare)):
            out = self.decoded(self.readings(bare))
        elif bare:
            out = [bare]
        if whole != bare and bare:
            # what stands at the ends may be punctuation or letters
            k = whole.index(bare)
            ends = [[[*o, ("", 0.7)] for o in self.readings(e)] for e in (whole[:k], whole[k + len(bare) :])]
            out += self.decoded([*ends[0], *self.readings(bare), *ends[1]])
        elif not any(map(str.isalpha, whole)) and len(set(whole)) > 1 and sum(c in STANDS_FOR for c in whole) > 1:
            out += self.decoded(self.readings(whole))
        return tuple(dict.fromkeys(out))

    def spaced(self, run: str) -> list[str]:
        """The words of single characters set apart, where each space may be a word border or not."""
        made: dict[tuple[str, bool, int], list[tuple[str, float]]] = {}
        lattice, last = [], ""
        for part in re.findall(r"\s*\S", run):
            ch, wide = part[-1], len(part) - 1
            key = ch, ch == last, wide
            if key not in made:
                may = [(ch, 0.0)] if ch.isalpha() else [(c, 0.7) for c in STANDS_FOR.get(ch, "")]
                if ch == last or ch in _JOINERS or not may:
                    may.append(("", 0.7))
                made[key] = [(x, c + (BORDER if wide > 1 else 0.0)) for x, c in may] + [(" " + x, c + (0.0 if wide > 1 else BORDER)) for x, c in may if wide]
            lattice.append(made[key])
            last = ch
        return self.several(lattice)

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        out: set[str] = set()
        find = self.cache.get
        low = text.lower()
        for token in set(low.split()):
            got = find(token)
            if got is None:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                got = self.cache[token] = self.word(token)
            out.update(got)
        for m in _SPACED.finditer(low):
            joined = "".join(m[0].split())
            if sum(c.isalnum() or c in STANDS_FOR for c in joined) >= 3:
                if len(joined) <= LONG:
                    out.update(self.word(joined))
                out.update(self.spaced(m[0]))
        return out


def features(words: set[str]) -> set[str]:
    out = set(words)
    for n in (4, 5, 6):
        out.update([f"{w[:n]}…" for w in words if len(w) > n])
    return out


class Model:
    def __init__(self, restorer: Restorer, weights: dict[str, float], base: float):
        self.restorer, self.weights, self.base = restorer, weights, base
        self.longest = max(map(len, weights), default=0)

    def score(self, text: str) -> float:
        w, z = self.weights, self.base
        words = self.restorer.words(text)
        for x in words:
            if x in w:
                z += w[x]
        for n in (4, 5, 6):
            for x in {f"{x[:n]}…" for x in words if len(x) > n}:
                if x in w:
                    z += w[x]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Gradient descent with per-weight steps over rows of feature indices."""
    at, row = np.concatenate(rows) if rows else np.zeros(0, int), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    gw, gb = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[at], minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(at, weights=err[row], minlength=n) + ridge * 0.1 * w
        gw, gb = gw + g * g, gb + err.sum() ** 2
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.1 * err.sum() / math.sqrt(gb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, n_features: int = FEATURES, fold: tuple[int, int] = (5, 0)) -> Model | None:
    """A model of at most train_rows labelled rows outside the held-out fold; None if there are none. Both doc_ids and rows
    are taken by a hash, so a doc_id with many rows brings no more than that; equal rows count once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Restorer(letter_costs(trigram_counts(docs))))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *fold))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows doc_ids, which may have any number of rows
    every, every_at = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "toxic", "text").alias("h")), "of-labelled-ids")
    top = every.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    rows, rows_at = written(every.where(F.col("h") <= F.lit(top).cast("long")).groupBy("h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    dropped(spark, every_at)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        restorer = shared.value
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally[toxic > 0].update(features(restorer.words(text or "")))
                tally[toxic > 0][""] += 1
        names = list(tally[0] | tally[1])
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([tally[1][x] for x in part], pa.int64()), pa.array([tally[0][x] for x in part], pa.int64())], names=["feature", "pos", "neg"])

    tally = rows.mapInArrow(counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).cache()
    whole = tally.where("feature = ''").first()
    if whole is None or not whole.pos or not whole.neg:
        tally.unpersist()
        dropped(spark, rows_at)
        return Model(shared.value, {}, -30.0) if whole else None
    p, q = float(whole.pos), float(whole.neg)
    term = lambda n, all_n: F.when(n > 0, n * F.log(n * (p + q) / ((F.col("pos") + F.col("neg")) * all_n))).otherwise(0.0)
    gone = lambda n, all_n: F.when(n < all_n, (all_n - n) * F.log((all_n - n) * (p + q) / ((p + q - F.col("pos") - F.col("neg")) * all_n))).otherwise(0.0)
    g2 = 2 * (term(F.col("pos"), p) + term(F.col("neg"), q) + gone(F.col("pos"), p) + gone(F.col("neg"), q))
    top = tally.where("feature <> '' and pos + neg > 1").withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(n_features).toPandas()
    tally.unpersist()
    chosen = {x: k for k, x in enumerate(top.feature)}
    picked = spark.sparkContext.broadcast(chosen)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, at = shared.value, picked.value
        for batch in batches:
            found = [sorted(at[x] for x in features(restorer.words(t or "")) if x in at) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["at", "toxic"])

    got = rows.mapInArrow(indexed, "at array<int>, toxic int").toPandas()
    dropped(spark, rows_at)
    order = sorted(range(len(got)), key=lambda i: (tuple(got["at"][i]), got.toxic[i]))
    w, b = _logistic([np.array(got["at"][i], dtype=int) for i in order], got.toxic.to_numpy()[order].astype(float), len(chosen))
    return Model(shared.value, {x: float(w[k]) for x, k in chosen.items() if abs(w[k]) > 1e-4}, float(b))


def scored(docs: DataFrame, model: Model | None, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the columns in `extra`, score and predicted of every row."""
    extra = extra or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *extra, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_columns - 1
            score = [model.score(t or "") if model else 0.0 for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=[*batch.schema.names[:n], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0)), fit(docs, labels), ["held_out"])
