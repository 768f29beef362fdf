"""License scans by an exact set-similarity join. DataFrame functions only.

Text blocks are pieces of the lower-cased text's words, whatever lines these are on. Pieces overlap so far that each run
of words as long as a notice may be lies in one. Templates and blocks are sets of distinct words. A block matches a
template if it holds at least `threshold` of the template's tokens within as many words in a row as a text has of which
the template makes the share `threshold`; words that lie wider apart don't count together. Tokens are ordered by how many
blocks of the corpus hold them, rarest first (then by themselves). A matching block must hold one of the first
|T| - ceil(threshold * |T|) + 1 tokens of template T (prefix filter) and as many tokens as must be common (length
filter), and where a token is met at place i of T and place j of the block's template tokens, what is left behind
these places must suffice (positional filter). What passes is verified on the places of the words, and the words
that tell a license from others (NEEDED) must stand among them, one after another.

The places where a phrase's words stand one after another, which the base labels come from, are found on the whole
text, where a phrase may go on over line ends.

Cases: a null text is an empty one: no words, no labels, score 0; a text without a phrase has null first and last
words; equal texts get equal results; a text that matches several templates has all their labels; a notice is found over
line ends and in very long lines, which are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

THRESHOLD = 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and words of each template: what the notices of common licenses say.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3"],
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": [
        "licensed under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["dedicated to the public domain under the cc0 1 0 universal dedication"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["licensed under the gnu lesser general public license version 2 1"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
    "copyright": ["no part of this publication may be reproduced or transmitted in any form without prior written permission"],
}

#: Words of a template that tell its license from others and so must stand in a notice as they do there, whatever share of
#: the rest is there.
NEEDED = {
    "licensed under the gnu affero general public license version 3": "gnu affero",
    "licensed under the apache license version 2 0": "apache license",
    "licensed under the bsd 3 clause license": "bsd",
    "licensed under cc by nc 4 0": "cc by nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "creative commons attribution",
    "dedicated to the public domain under the cc0 1 0 universal dedication": "cc0",
    "this work is licensed under the gnu general public license version 3": "gnu general public",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gnu general public",
    "licensed under the gnu lesser general public license version 2 1": "gnu lesser",
    "released under the mit license": "mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "associated",
    "this source code form is subject to the terms of the mozilla public license": "mozilla public license",
}


def template_rows(threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[int, str, list[str], int]]:
    """(template, label, distinct tokens, tokens that must be common) of each template; the given list bounds them."""
    texts = [(label, t) for label, ts in templates.items() for t in ts]
    return [(k, label, sorted(set(t.split())), math.ceil(threshold * len(set(t.split())) - 1e-9)) for k, (label, t) in enumerate(texts)]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def widths(threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> list[int]:
    """For each template the words in a row that a notice may take: the template's share of them is the threshold."""
    return [math.ceil(len(t.split()) / threshold - 1e-9) for ts in templates.values() for t in ts]


def needed(templates: dict[str, list[str]] = TEMPLATES, words: dict[str, str] = NEEDED) -> list[list[str]]:
    """For each template the words that must stand in a notice, one after another."""
    return [words.get(t, "").split() for ts in templates.values() for t in ts]


def matches(blocks: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES, needed_words: dict[str, str] = NEEDED) -> DataFrame:
    """row, label, score of the blocks' matches. blocks: row, block, tokens (the block's distinct tokens that any template
    has), placed (all of these tokens with their places).

    The number of the templates' tokens bounds what is read to the driver: one count for each.
    """
    spark = blocks.sparkSession
    told = template_rows(threshold, templates)
    vocabulary = sorted({t for _, _, ts, _ in told for t in ts})
    held = blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.token: r.n for r in held.collect()}
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    rank = {t: k for k, t in enumerate(order)}
    prefix = []
    for (k, label, tokens, common), width, must in zip(told, widths(threshold, templates), needed(templates, needed_words), strict=True):
        laid = sorted(tokens, key=rank.get)
        for i, t in enumerate(laid[: len(laid) - common + 1]):
            prefix.append((t, k, label, i, len(laid), common, width, laid, must))
    index = spark.createDataFrame(prefix, "token string, template int, label string, i int, size int, common int, width int, all array<string>, needed array<string>")
    ranks = F.create_map(*[x for t, k in rank.items() for x in (F.lit(t), F.lit(k))])
    laid = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(F.element_at(ranks, t).alias("k"), t.alias("t")))), lambda s: s["t"])
    placed = blocks.select("row", "block", "placed", laid.alias("tokens"), F.size("tokens").alias("n")).select("row", "block", "placed", "tokens", "n", F.posexplode("tokens").alias("j", "token"))
    # the template list bounds the index
    met = placed.join(F.broadcast(index), "token").where((F.col("n") >= F.col("common")) & (F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j")) >= F.col("common")))
    met = met.where(F.size(F.array_intersect("tokens", "all")) >= F.col("common"))
    met = met.withColumn("own", F.filter("placed", lambda x: F.array_contains("all", x["token"])))
    window = lambda x: F.array_distinct(F.transform(F.filter("own", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("width"))), lambda y: y["token"]))
    stands = lambda x: F.forall(F.transform("needed", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda z: F.exists("own", lambda y: (y["at"] == x["at"] + z["k"]) & (y["token"] == z["w"])))
    met = met.withColumn("starts", F.transform(F.filter("own", stands), lambda x: x["at"]))
    whole = lambda x: (F.size("needed") == 0) | F.exists("starts", lambda s: (s >= x["at"]) & (s + F.size("needed") <= x["at"] + F.col("width")))
    met = met.withColumn("held", F.transform(F.filter("own", whole), window))
    met = met.withColumn("common_here", F.array_max(F.transform("held", lambda ts: F.size(ts))))
    return met.where(F.col("common_here") >= F.col("common")).groupBy("row", "label").agg(F.max(F.col("common_here") / F.col("size")).alias("score"))


def scanned(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES, needed_words: dict[str, str] = NEEDED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row. templates: the texts of
    each label, lower-cased words set apart by spaces; needed_words: of a template those that must stand in a notice one after another."""
    told = template_rows(threshold, templates)
    known = sorted({t for _, _, ts, _ in told for t in ts})
    vocabulary = F.array(*[F.lit(t) for t in known])
    least = min(c for *_, c in told)
    low = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), lowered(F.col("text")).alias("low"))
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NOT_WORD, " ")), F.lit(" "))
    rows = low.withColumn("flat", flat)
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")
    rows = rows.withColumn("n_words", F.when(F.length("flat") <= 2, F.lit(0)).otherwise(spaces(F.col("flat")) - 1).cast("long"))
    found, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        has = F.contains(F.col("flat"), F.lit(f" {phrase} "))
        n = F.when(has, F.regexp_count("flat", F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long")
        firsts.append(F.when(has, spaces(F.substring_index("flat", f" {phrase} ", 1))))
        lasts.append(F.when(has, F.col("n_words") - spaces(F.substring_index("flat", f" {phrase} ", -1)) - len(phrase.split())))
        found, labels = found + n, [*labels, F.when(has, F.lit(label))]
    # a text that lacks a template's tokens as a whole has no block that holds them
    rows = rows.withColumn("words", F.split(F.trim("flat"), " ")).withColumn("held", F.array_intersect("words", vocabulary))
    may = F.lit(False)
    for (_, _, tokens, common), must in zip(told, needed(templates, needed_words), strict=True):
        has = [F.array_contains("held", t) for t in must]
        may = may | functools.reduce(operator.and_, [*has, F.size(F.array_intersect("held", F.array(*map(F.lit, tokens)))) >= common])
    wide = max(widths(threshold, templates))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - wide - 1).cast("int"), F.lit(wide)),
        lambda k: F.filter(F.transform(F.slice("words", k + 1, F.lit(2 * wide)), lambda w, at: F.struct(at.alias("at"), w.alias("token"))), lambda x: x["token"].isin(known)),
    )
    pieces = F.filter(pieces, lambda placed: F.size(F.array_distinct(F.transform(placed, lambda x: x["token"]))) >= least)
    blocks = F.when((F.size("held") >= least) & may, pieces)
    rows = rows.select(
        "doc_id", "row", "n_words", found.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"), blocks.alias("blocks"),
    )
    rows, _ = written(rows, "scanned")
    block = rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "placed"))
    block = block.withColumn("tokens", F.array_distinct(F.transform("placed", lambda x: x["token"])))
    hits = matches(block, threshold, templates, needed_words).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    all_labels = lambda *c: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*c))))
    none = F.array().cast("array<string>")
    return rows.join(hits, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", all_labels(F.col("base")).alias("base_labels"),
        all_labels(F.col("base"), F.coalesce("more", none)).alias("labels"), F.coalesce("best", F.when(F.col("n_base") > 0, 1.0), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    places, labels = [], []
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(ws) - 1}, 0)), lambda i: {same})")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN '{label}' END")
    best = []
    for (_, label, tokens, common), width, must in zip(template_rows(), widths(), needed(), strict=True):
        ts = f"[{', '.join(repr(t) for t in tokens)}]"
        own = f"list_filter(range(0, len(w)), lambda i: list_contains({ts}, w[i + 1]))"
        phrase = " AND ".join(f"w[s + {k + 1}] = {m!r}" for k, m in enumerate(must))
        whole = f"len(list_filter(range(i, least(i + {width}, len(w)) - {len(must) - 1}), lambda s: {phrase})) > 0" if must else "true"
        held = f"list_max(list_transform({own}, lambda i: CASE WHEN {whole} THEN len(list_distinct(list_intersect(w[i + 1 : i + {width}], {ts}))) ELSE 0 END))"
        best.append((label, f"CASE WHEN {held} >= {common} THEN {held} / {len(tokens)}.0 END"))
    more = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN '{label}' END" for label, x in best)
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL))), ','), '')"
    return f"""
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{word}') AS w FROM l),
p AS (SELECT *, {' || '.join(f'({x})' for x in places)} AS places, {joined(', '.join(labels))} AS base_labels, {joined(', '.join([*labels, more]))} AS labels, greatest({', '.join(x for _, x in best)}) AS best FROM w)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
  CAST(list_max(places) AS BIGINT) AS last_word, base_labels, labels, CAST(coalesce(best, CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS score
FROM p"""


ORACLE_SQL = _oracle()
