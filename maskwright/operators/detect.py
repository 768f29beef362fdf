"""Typed spans in text: patterns with checks, label and value pairs, dictionary terms; merged by priority.

A span is struct(cls, start, end, value, valid, token, layer); offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import scalars as S
from .automata import AUTOMATON_BYTES, found_in, total_bytes
from .ranking import durable

SPAN = "struct<cls:string,start:int,end:int,value:string,valid:boolean,token:string,layer:string>"
NO_SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


# A match of EMAIL begins where a run of its characters begins, or where the match before ends; told so, the search
# reads a long run once.
_RUN = "[A-Za-z0-9._%+-]+@"


def _searched(pattern: str) -> str:
    return pattern.replace(_RUN, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@", 1) if pattern.startswith(_RUN) else pattern


def span(cls, start, end, value, valid=None, token=None, layer="L1") -> Column:
    of = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(
        of(cls, "string").alias("cls"), of(start, "int").alias("start"), of(end, "int").alias("end"), of(value, "string").alias("value"),
        of(valid, "boolean").alias("valid"), of(token, "string").alias("token"), of(layer, "string").alias("layer"),
    )


def matches(text: Column, pattern: Column) -> Column:
    """array<struct(value, start)> of all matches: where a match begins follows from the lengths of gaps and matches.

    One fold over gaps and matches, so that each is worked out once.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int>>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        begin = a["at"] + F.length(z["gap"])
        more = F.concat(a["out"], F.array(F.struct(z["hit"].alias("value"), begin.alias("start"))))
        return F.struct((begin + F.coalesce(F.length(z["hit"]), F.lit(0))).alias("at"), F.when(z["hit"].isNull(), a["out"]).otherwise(more).alias("out"))

    return F.aggregate(zipped, start, step, lambda a: a["out"])


CHECKED = ("CARD", "AADHAAR")


def _verdict(cls: str, value: Column) -> tuple[Column, Column]:
    """(valid, kept) of a match of a class with a check."""
    if cls == "CARD":
        n = F.length(S.digits(value))
        return F.lit(True), n.between(13, 19) & S.luhn(value)
    good = S.verhoeff(value)
    return good, good | value.rlike("[ -]")


def pattern_spans(text: Column, cls: str, detectors: dict[str, str] = X.DETECTORS, read=lambda v: v) -> Column:
    """Spans of one class. Offsets are only worked out where the pattern occurs. read: what a value is checked as."""
    pattern = _searched(detectors[cls])
    found = matches(text, F.lit(pattern))
    if cls in CHECKED:
        found = F.filter(found, lambda m: _verdict(cls, read(m["value"]))[1])
    spans = F.transform(found, lambda m: span(cls, m["start"], m["start"] + F.length(m["value"]), m["value"], _verdict(cls, read(m["value"]))[0] if cls in CHECKED else None))
    return F.when(text.rlike(pattern), spans).otherwise(no_spans())


def merged(*lists: Column) -> Column:
    """Spans of the lists in order of priority that overlap none kept before, sorted by start."""
    every = F.concat(*lists) if len(lists) > 1 else lists[0]
    kept = F.aggregate(every, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("k"), s.alias("s"))), lambda a, b: a["k"] - b["k"])
    return F.transform(ordered, lambda x: x["s"])


#: What every match of a detector holds: an at sign, four digits that at most a space or a hyphen parts, or a bank code's
#: beginning. Each is sought for itself, as a search for all at once takes twice the time, and the last only where a 0 is.
FOUR_DIGITS, BANK = "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "[A-Z]{4}0"


def may_hold(text: Column) -> Column:
    return F.contains(text, F.lit("@")) | text.rlike(FOUR_DIGITS) | (F.contains(text, F.lit("0")) & text.rlike(BANK))


def detect_patterns(text: Column, classes: tuple[str, ...] = tuple(X.DETECTORS)) -> Column:
    """Merged spans of the classes, in the detectors' order of priority."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(may_hold(whole), merged(*[pattern_spans(whole, c) for c in X.DETECTORS if c in classes])).otherwise(no_spans())


def label_values(text: Column) -> Column:
    """Spans of values after a label that tells their class."""
    text = F.coalesce(text, F.lit(""))
    group = lambda k: F.regexp_extract_all(text, F.lit(X.LABEL_VALUE), F.lit(k))
    rows = F.transform(F.arrays_zip(matches(text, F.lit(X.LABEL_VALUE)).alias("m"), group(1).alias("before"), group(2).alias("label"), group(3).alias("v")), lambda z: F.struct(
        S.class_from_context(z["label"]).alias("cls"), z["v"].alias("v"), (z["m"]["start"] + F.length(z["before"]) + F.length(z["label"])).alias("from")))
    rows = F.filter(rows, lambda r: r["cls"].isNotNull())
    spans = F.transform(rows, lambda r: _at(r, text))
    return F.when(text.rlike("[:：]"), spans).otherwise(no_spans())


def _at(r: Column, text: Column) -> Column:
    """The span of r.v, at its first place from r.from on."""
    start = r["from"] + F.call_function("locate", r["v"], F.substring(text, r["from"] + 1, F.length(text)), F.lit(1)) - 1
    return span(r["cls"], start, start + F.length(r["v"]), r["v"], layer="L4")


def context_span(text: Column, cls: Column) -> Column:
    """The whole visible text as a value of a class that its surroundings tell; none if there is no class."""
    start, end = S.first_visible(text), S.trimmed_length(text)
    return S.bound(cls, lambda c: F.when(c.isNotNull() & (start >= 0), F.array(span(c, start, end, F.substring(text, start + 1, end - start), layer="L4"))).otherwise(no_spans()))


def block_spans(text: Column, context_class: Column, dictionary: Column | None = None) -> Column:
    """Of a text block: patterns, then dictionary, then label and value pairs; its context only if these find nothing."""
    found = merged(detect_patterns(text), *([dictionary] if dictionary is not None else []), label_values(text))
    return S.bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(context_span(text, context_class)))


# --- dictionary ---


def term_pattern(term: Column) -> Column:
    """Whole words, any case, any white space."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.regexp_replace(S.escaped(term), f"{X.SPACE}+", r"\\s+"), F.lit(r"(?![\p{L}\p{N}])"))


def clean_terms(raw: Column) -> Column:
    """Terms of a comma- or line-separated setting: trimmed, three characters at least, distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(raw, r"[,\n]"), S.strip), lambda t: F.length(t) >= 3))


def words_of(text: Column | str) -> Column:
    """The distinct words of a text, folded so far that what a case-insensitive pattern matches is the same words."""
    put = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    # what is put in between keeps the optimizer from taking lower(upper(x)) for lower(x)
    folded = put(put(F.lower(put(F.upper(put(text, "ẞ", "ß")), "\u0307", "")), "\u0307", ""), "ς", "σ")
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


#: The one mark whose capital is a letter: part of a word, or the border of one.
_IOTA = "\u0345"


def _met(rows: DataFrame, entries: DataFrame, text: str, key: str) -> DataFrame:
    """key and _terms of the rows that may hold terms, by the word of each term that the fewest terms have."""
    entry = [c for c in entries.columns if c not in ("form", "kind")]
    each = entries.select(F.struct(*entry).alias("e"), F.explode(words_of(F.col("form"))).alias("w"))
    common = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    sought = each.join(common, "w").groupBy("e").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    words = words_of(F.col(text))
    words = F.when(F.contains(text, F.lit(_IOTA)), F.array_union(words, words_of(F.replace(text, F.lit(_IOTA), F.lit(" "))))).otherwise(words)
    return rows.select(key, F.explode(words).alias("w")).join(sought, "w").groupBy(key).agg(F.collect_set("e").alias("_terms"))


def dictionary_spans(texts: DataFrame, terms: DataFrame, text: str = "text", most: int = AUTOMATON_BYTES, key: str | None = None) -> DataFrame:
    """texts with a column dict_spans: merged spans of the terms (term, cls, token), longer terms first, equal ones in the
    order of the terms' column `ord`, or of the term where there is none.

    Each text is read by an automaton of all terms and meets only those that it may hold; no word of it travels. key: a
    column that tells the texts apart; with it, terms that one automaton can't hold meet the texts by a join on words, so
    that no task and not the driver holds them all.
    """
    order = F.col("ord") if "ord" in terms.columns else F.col("term")
    entries = terms.where(S.strip(F.col("term")) != "").select(F.col("term").alias("form"), F.lit("text").alias("kind"), (-F.length("term")).alias("k"), order.alias("o"), F.col("term").alias("t"), "cls", "token", term_pattern(F.col("term")).alias("pattern"))
    rows = texts.drop("dict_spans")
    if key is not None and total_bytes(entries) > most:
        rows, entries = durable(rows), durable(entries)
        bare = entries.where(F.size(words_of(F.col("form"))) == 0)  # signs alone
        held = F.coalesce("_met", F.array().cast(_kind(entries)))
        hits = F.concat(held, found_in(F.col(text), bare, most=most)) if not bare.isEmpty() else held
        rows = rows.join(_met(rows, entries, text, key).withColumnRenamed("_terms", "_met"), key, "left")
        met = rows.select("*", F.explode(F.array(F.array_sort(F.array_distinct(hits)))).alias("_terms")).drop("_met")
    else:
        # a generated column, so that the automaton runs once
        met = rows.select("*", F.explode(F.array(F.array_sort(F.array_distinct(found_in(F.col(text), entries, most=most))))).alias("_terms"))
    found = F.transform("_terms", lambda r: F.transform(matches(F.col(text), r["pattern"]), lambda m: span(r["cls"], m["start"], m["start"] + F.length(m["value"]), m["value"], token=r["token"])))
    return met.withColumn("dict_spans", F.when(F.size("_terms") == 0, no_spans()).otherwise(merged(F.flatten(found)))).drop("_terms")


def _kind(entries: DataFrame) -> T.ArrayType:
    return T.ArrayType(T.StructType([f for f in entries.schema.fields if f.name not in ("form", "kind")]))


def replaced(text: Column, spans: Column, shown) -> Column:
    """The text with each span (sorted, apart) replaced by shown(span)."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), shown(s)).alias("out"), s["end"].alias("at"))
    whole = F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, text: str = "text", changed_only: bool = False, classes: tuple[str, ...] = tuple(X.DETECTORS)) -> DataFrame:
    """docs with `spans` of the classes and `redacted`, where each span is ⟦CLASS⟧. changed_only: only rows with spans; most others are
    left out by one fast search."""
    rows = (docs.where(may_hold(F.col(text))) if changed_only else docs).drop("spans", "redacted")
    # a generated column, so that a filter on it isn't worked out from the patterns once more
    found = rows.select("*", F.explode(F.array(detect_patterns(F.col(text), classes))).alias("spans"))
    found = found.where(F.size("spans") > 0) if changed_only else found
    return found.withColumn("redacted", replaced(F.col(text), F.col("spans"), lambda s: F.concat(F.lit("⟦"), s["cls"], F.lit("⟧"))))
