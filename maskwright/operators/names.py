"""Person names in running text: pieces of words, segments, and what a token classifier's logits say.

The classifier is a callable from (ids, mask) to logits, given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from .vault import dictionary

# Fixed values of the model.
LABELS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]
SEGMENT, BATCH, LEAST_SCORE, LONGEST_WORD = 128, 16, 0.7, 100
#: Texts whose pieces a task holds at once, and words whose pieces it remembers.
SLICE, REMEMBERED = 256, 50_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]")


class Piece(NamedTuple):
    id: int
    start: int
    end: int
    word: int
    stop: bool


def read_vocabulary(text: str) -> dict[str, int]:
    """A piece's id is the number of its line."""
    return {piece: i for i, piece in enumerate(text.replace("\r\n", "\n").split("\n"))}


def _split(word: str, vocabulary: dict[str, int]) -> list[tuple[int, int, int]]:
    """(id, start, end) of the longest known pieces of a word, first piece first."""
    at, own = 0, []
    while at < len(word) <= LONGEST_WORD:
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            break
        own.append((vocabulary[("##" if at else "") + word[at:end]], at, end))
        at = end
    return own if at == len(word) else [(vocabulary["[UNK]"], 0, len(word))]


def pieces(text: str, vocabulary: dict[str, int], seen: dict[str, list] | None = None) -> list[Piece]:
    """Words split into the longest known pieces, first piece first; a word with an unknown rest is one unknown piece.
    seen: remembers the pieces of words."""
    out: list[Piece] = []
    seen = {} if seen is None else seen
    for n, m in enumerate(_WORD.finditer(text)):
        word, at = m[0], m.start()
        own = seen.get(word)
        if own is None:
            if len(seen) >= REMEMBERED:
                seen.clear()
            own = seen[word] = _split(word, vocabulary)
        stop = word in (".", "!", "?")
        for i, a, b in own:
            out.append(Piece(i, at + a, at + b, n, stop))
    return out


def segments(all_pieces: list[Piece], most: int = SEGMENT) -> list[list[Piece]]:
    """Runs of at most `most` pieces that end at a sentence's end where there is one, else between words."""
    out, at = [], 0
    while at < len(all_pieces):
        end = min(len(all_pieces), at + most)
        if end < len(all_pieces):
            last = next((k for k in range(end, at + 1, -1) if all_pieces[k - 1].stop), None)
            end = last or next((k for k in range(end, at, -1) if all_pieces[k].word != all_pieces[k - 1].word), at + 1)
        out.append(all_pieces[at:end])
        at = end
    return out


def names_of(text: str, segment: list[Piece], logits: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, value, mean score) of the names that the logits (a row for each piece) tell, words by first piece."""
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    label, prob = logits.argmax(axis=1).tolist(), (1 / z.sum(axis=1)).tolist()
    spans: list[list] = []
    running = False
    before = None
    for k, p in enumerate(segment):
        if p.word == before:
            if running:
                spans[-1][1] = p.end
            continue
        before, told = p.word, LABELS[label[k]]
        if told == "I-PER" and running:
            spans[-1][1] = p.end
            spans[-1][2].append(prob[k])
        elif told in ("B-PER", "I-PER"):
            spans.append([p.start, p.end, [prob[k]]])
        running = told in ("B-PER", "I-PER")
    return [(a, b, text[a:b], score) for a, b, s in spans if (score := s[0] if len(s) == 1 else float(np.mean(s))) >= LEAST_SCORE]


def candidate(text: Column) -> Column:
    """Whether a text may hold a name in prose: a capitalised word, and four words at least."""
    return text.rlike(r"\p{Lu}\p{Ll}+") & (F.size(F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))) >= 4)


def budgeted(texts: DataFrame, most: int = X.NER_BUDGET) -> DataFrame:
    """Of each snapshot's candidate texts those before which less than the budget of characters lies. texts:
    snapshot_id, ord, text."""
    before = Window.partitionBy("snapshot_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.where(candidate(F.col("text")))
    return rows.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_before") < most).drop("_before")


def find_names(texts: DataFrame, vocabulary: dict[str, int], model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """snapshot_id, ord, start, end, value and score of the names in texts. model: makes the classifier for a worker."""
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify, v, seen = None, known.value, {}
        for whole in batches:
            classify = classify or model()
            for at in range(0, len(whole), SLICE):
                b = whole.iloc[at : at + SLICE]
                of, ords, said = b["snapshot_id"].tolist(), b["ord"].tolist(), b["text"].tolist()
                parts = [(i, s) for i, t in enumerate(said) for s in segments(pieces(t, v, seen))]
                out = []
                for k in range(0, len(parts), BATCH):
                    part = parts[k : k + BATCH]
                    wide = max(len(s) for _, s in part) + 2
                    ids, mask = np.full((len(part), wide), v["[PAD]"], dtype=np.int64), np.zeros((len(part), wide), dtype=np.int64)
                    for r, (_, s) in enumerate(part):
                        ids[r, : len(s) + 2] = [v["[CLS]"], *[p.id for p in s], v["[SEP]"]]
                        mask[r, : len(s) + 2] = 1
                    logits = np.asarray(classify(ids, mask))
                    for r, (i, s) in enumerate(part):
                        out += [(of[i], int(ords[i]), *n) for n in names_of(said[i], s, logits[r, 1 : len(s) + 1])]
                yield pd.DataFrame(out, columns=["snapshot_id", "ord", "start", "end", "value", "score"])

    return texts.select("snapshot_id", "ord", "text").mapInPandas(run, "snapshot_id string, ord long, start int, end int, value string, score double")


def name_texts(snapshots: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """snapshot_id, source, ord and text of all that may hold names in prose: texts, then values of fields that aren't
    passwords, then lines read from images. ord numbers the texts of a snapshot from 1."""
    place = lambda part, *at: F.struct(F.lit(part).alias("part"), *[x.alias(f"k{i}") for i, x in enumerate(at)]).alias("place")
    none = F.lit("")
    texts = snapshots.select("snapshot_id", "source", F.posexplode("texts").alias("i", "t")).select("snapshot_id", "source", place(0, none, F.col("i"), F.lit(0)), F.col("t.text").alias("text"))
    values = snapshots.select("snapshot_id", "source", F.posexplode("elements").alias("i", "e")).where((F.col("e.value") != "") & ~F.col("e.role").eqNullSafe("password"))
    out = texts.unionByName(values.select("snapshot_id", "source", place(1, none, F.col("i"), F.lit(0)), F.col("e.value").alias("text")))
    if vision is not None:
        lines = vision.join(snapshots.select("snapshot_id", "source"), "snapshot_id").select("snapshot_id", "source", "key", F.posexplode("lines").alias("i", "l"))
        out = out.unionByName(lines.select("snapshot_id", "source", place(2, F.col("key"), F.col("i"), F.lit(0)), F.col("l.text").alias("text")))
    return out.select("snapshot_id", "source", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("place")).cast("long").alias("ord"), "text")


def learned(snapshots: DataFrame, vision: DataFrame | None, vocabulary: dict[str, int], model: Callable[[], Callable], known: DataFrame) -> DataFrame:
    """snapshot_id, source, ord, start, value and score of the names that are new to the vault `known`, for sanitize()."""
    texts = name_texts(snapshots, vision)
    found = find_names(budgeted(texts), vocabulary, model)
    return fresh_names(found, known).join(texts.select("snapshot_id", "ord", "source"), ["snapshot_id", "ord"]).select("snapshot_id", "source", "ord", "start", S.strip(F.col("value")).alias("value"), "score")


def fresh_names(names: DataFrame, vault: DataFrame) -> DataFrame:
    """Names worth learning: three characters at least, no label of a field, not in the dictionary in any case."""
    rows = names.withColumn("term", F.lower(S.strip(F.col("value")))).where((F.length("term") >= 3) & S.class_from_context(F.col("value")).isNull())
    return rows.join(dictionary(vault).select(F.lower("term").alias("term")).distinct(), "term", "left_anti").drop("term")
