"""A pipeline over `documents`: language ID, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, contamination, language, neardup, substrings
from maskwright.llm.scratch import dropped, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language reaches this score.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; texts without letters and with no likely language go."""
    model = language.fit(docs, ~language.held_out(F.col("doc_id"), 3, 1))
    found = language.predicted(docs, model, COLUMNS[1:])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar documents, that of the least doc_id, and all without words."""
    return neardup.firsts(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 13 and more words that a smaller doc_id holds too out of the texts; a document of which
    nothing is left goes."""
    cut = substrings.deduped(docs, carry=["doc_id", "lang", "source", "n_chars"])
    cut = cut.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold less than 0.8 of the shingles of each benchmark item. Rows are told by their text, which
    alone decides, so that others of a null or repeated doc_id stay."""
    text = F.unhex(F.sha2("text", 256))
    pairs = contamination.contained(docs.select(text.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks, _ = written(pairs.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return docs.join(leaks, text == F.col("leak"), "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    return bpe.encoded(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: SQL cannot express the language model, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each but the last written and read again; what the one before wrote then goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, at = written(stage(spark, docs, sf_dir), name)
        if before:
            dropped(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
