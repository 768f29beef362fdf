"""Language ID by string kernels: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest ridge regression.

A text's spectrum is the set of its byte n-grams of 1 to ORDER bytes, lower-cased, with ASCII characters that aren't
letters read as spaces, hashed to CELLS cells. The kernel of two texts is the number of common cells over the root of
the product of both sizes. Landmarks give the Nyström features, on which one ridge regression for each language is
solved. As the kernel is a product of presence vectors, landmarks and coefficients fold into one matrix, and a batch
of texts is scored by one matrix product.

The fit uses at most PER_LANG rows of each language and ROWS in all, taken by a hash, of the LANGS most frequent
languages; LANDMARKS of them, or two for each language where that is more, are landmarks. Everything else reads every row and the whole text.

Cases: a null text, or one with no letter, is `und` with score 0, as is every text where no row could be learned
from; equal texts get equal results; rows that repeat are learned once, rows of one doc_id each for itself; ties go to the language that sorts first; a null doc_id isn't held out; very
long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, written
from .textkernel import arrow_bytes, released, slices

ORDER = 4
CELLS = 1 << 14
PER_LANG, ROWS, LANGS = 400, 25_600, 512
LANDMARKS = 300
RIDGE = 1e-2
SHARPNESS = 4.0
SHARES = 16
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def spectra(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from row, to row, presence of each cell as float32) for runs of rows."""
    data, offsets = arrow_bytes(pc.utf8_lower(col))
    for a, b in slices(offsets, 1 << 20):
        for lo in range(a, b, 512):
            hi = min(b, lo + 512)
            part, at = _PLAIN[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
            seen = np.zeros((hi - lo) * CELLS, dtype=np.float32)
            row = np.repeat(np.arange(hi - lo, dtype=np.int64) * CELLS, np.diff(at))
            left = np.repeat(at[1:], np.diff(at)) - np.arange(len(part))
            code = np.zeros(len(part), dtype=np.uint32)
            for n in range(1, ORDER + 1):
                m = len(part) - n + 1
                if m <= 0:
                    break
                code[:m] = code[:m] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
                cell = ((code[:m] ^ np.uint32(n << 28)) * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)
                seen[(row[:m] + cell)[left[:m] >= n]] = 1
            yield lo, hi, seen.reshape(hi - lo, CELLS)


class Model:
    """langs in order; weights: CELLS x langs."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        margins = (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        e = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def fitted(x: np.ndarray, langs: list[str]) -> Model:
    """Nyström features over evenly taken landmarks, then ridge regression of +1 / -1 targets. x: presence as bytes."""
    names = sorted(set(langs))
    sizes = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))
    own = np.linspace(0, len(x) - 1, min(max(LANDMARKS, 2 * len(names)), len(x))).astype(int)
    marks = (x[own] / sizes[own, None]).astype(np.float32)
    k_nm = np.concatenate([x[k : k + 128].astype(np.float32) @ marks.T for k in range(0, len(x), 128)]).astype(np.float64) / sizes[:, None]
    k_mm = k_nm[own]
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_nm @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([langs.count(n) for n in langs], dtype=float)
    weight = (1 / share)[:, None] * len(langs) / len(names)
    coef = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * len(langs) * np.eye(phi.shape[1]), phi.T @ (target * weight))
    return Model(names, (marks.T @ (root @ coef)).astype(np.float32))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, allowed: Column, per_lang: int = PER_LANG, rows_in_all: int = ROWS, most_langs: int = LANGS) -> Model | None:
    """A model of at most per_lang rows of each lang and rows_in_all together, from rows with a lang and letters where
    `allowed` holds; None if there are none. Where there are more, the most_langs most frequent langs are learned.

    Rows are taken by a hash of doc_id, lang and text, below a bound for each lang; equal rows count once. The first pass
    reads hashes only, the second brings the spectra of the rows below the bounds to the driver, and no others.
    """
    spark = docs.sparkSession
    fine = allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")
    rows = docs.where(fine).select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    keys, keys_at = written(rows.select("lang", "h").distinct(), "language-keys")
    langs = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not langs:
        dropped(spark, keys_at)
        return None
    per_lang = min(per_lang, max(1, rows_in_all // len(langs)))
    known = spark.createDataFrame([(r.lang,) for r in langs], "lang string")
    first = keys.join(F.broadcast(known), "lang").withColumn("share", F.pmod("h", F.lit(SHARES)))
    # the first rows of a language are among the first of each of its shares, so no task reads a whole language
    for by in (["lang", "share"], ["lang"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= per_lang)
    # one row for each language, most_langs at most
    bounds = spark.createDataFrame(first.groupBy("lang").agg(F.max("h").alias("top")).collect(), "lang string, top long")
    dropped(spark, keys_at)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(r > 0).tobytes() for _, _, x in spectra(batch.column(1)) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary())], names=["lang", "h", "bits"])

    chosen = rows.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("top")).select("lang", "text", "h")
    spectrum = chosen.mapInArrow(packed, "lang string, h long, bits binary").groupBy("lang", "h").agg(F.first("bits").alias("bits"))
    got = spectrum.toPandas().sort_values(["lang", "h"], kind="stable")
    x = np.unpackbits(np.frombuffer(b"".join(got.bits), dtype=np.uint8).reshape(len(got), -1), axis=1)
    return fitted(x, got.lang.tolist())


def predicted(docs: DataFrame, model: Model | None, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the columns in `extra`, lang_pred and score of every row."""
    extra = extra or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *extra, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), *([] if "text" in extra else [F.col("text").alias("_text")]))
    n = 1 + len(extra)  # the columns that stay; the text is one of them or comes last
    text_at = 1 + extra.index("text") if "text" in extra else n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = batch.column(n).to_numpy(zero_copy_only=False)
            names, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            for lo, hi, x in spectra(batch.column(text_at)) if model else ():
                p = model.scores(x)
                best = p.argmax(axis=1)
                ok = letters[lo:hi]
                names[lo:hi][ok] = np.array(model.langs, dtype=object)[best][ok]
                score[lo:hi][ok] = p[np.arange(len(best)), best][ok]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names[:n], "lang_pred", "score"])
            released()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    return predicted(docs.withColumn("held_out", out), fit(docs, ~out), ["held_out"])
