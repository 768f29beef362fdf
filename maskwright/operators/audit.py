"""Audit of outgoing payloads: all their strings, values of the vault in them, patterns, and the verdict of the checks."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import scalars as S
from .automata import AUTOMATON_BYTES, found_in
from .detect import detect_patterns, pattern_spans
from .ranking import durable

SKIPPED = ("image",)
LEAVES = "array<struct<path:string,value:string>>"


def leaves(value: Column, schema: T.DataType, path: Column | None = None, skip: tuple[str, ...] = SKIPPED) -> Column:
    """array<struct(path, value)> of all strings in a nested column, by its schema; keys in `skip` are left out."""
    here = path if path is not None else F.lit("")
    none = F.array().cast(LEAVES)
    if isinstance(schema, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(here.alias("path"), value.alias("value")))).otherwise(none)
    if isinstance(schema, T.StructType):
        parts = [leaves(value[f.name], f.dataType, F.concat(here, F.when(here == "", F.lit(f.name)).otherwise(F.lit(f".{f.name}"))), skip) for f in schema.fields if f.name not in skip]
        return F.concat(none, *parts)
    if isinstance(schema, T.ArrayType):
        inner = F.transform(value, lambda v, i: leaves(v, schema.elementType, F.concat(here, F.lit("["), i.cast("string"), F.lit("]")), skip))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(schema, T.MapType):
        inner = F.transform(F.map_entries(value), lambda e: F.when(e["key"].isin(list(skip)), none).otherwise(leaves(e["value"], schema.valueType, F.concat(here, F.when(here == "", e["key"]).otherwise(F.concat(F.lit("."), e["key"]))), skip)))
        return F.coalesce(F.flatten(inner), none)
    return none


#: Levels of nesting that one plan opens; what is deeper is written and opened by the next.
LEVELS = 16


def nesting(json: Column) -> Column:
    """How many brackets of a JSON text are open at most, those in strings aside."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, "(?!^)"), start, step, lambda a: a["most"])


def _opened(rows: DataFrame) -> DataFrame:
    """id, path, v with each container replaced by what it holds; scalars and empty containers stay."""
    inner = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    inner = inner.where(F.col("key").isNull() | ~F.col("key").isin(*SKIPPED))
    step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
    return inner.select("id", F.concat("path", F.when(F.col("pos").isNull(), F.lit("")).otherwise(step)).alias("path"), F.coalesce("value", "v").alias("v"))


def json_leaves(payloads: DataFrame, column: str = "json") -> DataFrame:
    """id, path, value of all strings of JSON payloads (id, json) of any shape, and error: for a payload that can't be
    read one row that tells why, so that nobody takes it for one without strings. A null or empty payload has no rows.

    Payloads are parsed once to variants and opened level by level where they are, with no shuffle. What can't be read:
    no JSON, an object that names a key twice, and what is nested or as large as the parser refuses.
    """
    whole = payloads.select("id", F.col(column).alias("json")).where("json <> ''")
    rows = whole.select("id", F.lit("").alias("path"), F.try_parse_json("json").alias("v"), nesting(F.col("json")).alias("depth"))
    error = F.when(F.col("v").isNull(), F.lit("not JSON that can be read"))
    bad = rows.where(error.isNotNull()).select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"), error.alias("error"))
    depth = rows.where("v is not null").agg(F.max("depth")).first()[0] or 0
    rows, told = rows.where("v is not null").select("id", "path", "v"), [bad]
    kind = F.schema_of_variant("v")
    while True:
        for _ in range(min(LEVELS, depth)):
            rows = _opened(rows)
        told.append(rows.where(kind == "STRING").select("id", "path", F.variant_get("v", "$", "string").alias("value"), F.lit(None).cast("string").alias("error")))
        depth -= LEVELS
        if depth <= 0:
            return reduce(DataFrame.unionByName, told)
        rows = durable(rows.where(kind.startswith("OBJECT<") | kind.startswith("ARRAY<")))


def joined_text(leaf: Column) -> Column:
    """All strings in one text, a line each, placeholders blanked."""
    return S.without_tokens(F.concat_ws("\n", F.transform(leaf, lambda x: x["value"])))


def value_patterns(cls: Column, value: Column) -> Column:
    """array<struct(pattern, form, kind)>: regular expressions by which a stored value is found, its digits however spaced,
    or itself in any case, and what an automaton seeks to find texts that may match."""
    told = lambda pattern, form, kind: F.struct(pattern.alias("pattern"), form.alias("form"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<pattern:string,form:string,kind:string>>")
    v = S.strip(value)
    d = S.digits(v)
    packed = F.length(F.regexp_replace(v, f"{X.SPACE}+", ""))
    core = F.when(cls == "PHONE", F.right(d, F.lit(10))).otherwise(d)
    spaced = F.regexp_replace(core, "(?<=[0-9])(?=[0-9])", r"[\\s-]?")
    flexible = lambda s: F.regexp_replace(S.escaped(s), f"{X.SPACE}+", r"\\s+")
    whole = F.when(F.length(v) >= 3, F.array(told(F.concat(F.lit("(?iu)"), flexible(v)), v, "text"))).otherwise(none)
    words = F.transform(F.filter(F.split(v, f"{X.SPACE}+"), lambda w: F.length(w) >= 3), lambda w: told(F.concat(F.lit("(?iu)" + X.BORDER), S.escaped(w), F.lit(X.BORDER)), w, "text"))
    named = F.when(cls == "NAME", words).otherwise(none)
    return F.when((F.length(d) >= 6) & (F.length(d) / packed > 0.6), F.array(told(spaced, core, "digits"))).otherwise(F.concat(whole, named))


def leaked_values(texts: DataFrame, vault: DataFrame, most: int = AUTOMATON_BYTES) -> DataFrame:
    """id, token, cls, ord of the vault entries whose value shows in a text. texts: id, scope, text; vault also scope.

    Each text is read by an automaton of all values and meets those of its own scope (session or user) that it may hold;
    only leaks travel.
    """
    known = vault.where(F.col("value") != "").select(F.col("scope").cast("string").alias("scope"), F.col("n").alias("ord"), "cls", "token", F.explode(value_patterns(F.col("cls"), F.col("value"))).alias("p")).select("scope", "ord", "cls", "token", "p.pattern", "p.form", "p.kind")
    met = texts.select("id", "text", F.explode(found_in(F.col("text"), known, F.col("scope").cast("string"), most)).alias("e"))
    shown = met.where(F.rlike(F.col("text"), F.col("e.pattern")))
    return shown.groupBy("id", "e.token", "e.cls").agg(F.min("e.ord").alias("ord"))


def firewall(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """id, ok and checks (name, ok, detail) of each outgoing request.

    requests: id, scope, payload (struct), dest, server_url, mode, has_image, integrity, audit (array, null if it
    failed), audited (whether it was asked for). A null verdict is never ok.
    """
    schema = requests.schema["payload"].dataType
    rows = requests.withColumn("text", joined_text(leaves(F.col("payload"), schema))).withColumn("seen", F.concat_ws("\n", "audit"))
    told = lambda c: leaked_values(rows.select("id", "scope", F.col(c).alias("text")), vault).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "ord", "token"))), lambda x: x["token"]).alias(f"{c}_leaks"))
    rows = rows.join(told("text"), "id", "left").join(told("seen"), "id", "left")
    n = vault.where(F.col("value") != "").groupBy("scope").agg(F.count(F.lit(1)).alias("n_values"))
    rows = rows.join(n, "scope", "left")
    classes = lambda c: F.array_distinct(F.transform(detect_patterns(F.col(c)), lambda s: s["cls"]))
    rows = rows.withColumn("text_classes", classes("text")).withColumn("seen_classes", classes("seen"))
    leaks = lambda c: F.coalesce(F.col(f"{c}_leaks"), F.array().cast("array<string>"))
    check = lambda name, ok, detail: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"))
    nothing = lambda a: F.size(a) == 0
    found = F.concat(leaks("seen"), F.col("seen_classes"))
    image = check("Mask integrity", F.col("integrity") & F.col("has_image"), F.when(F.col("integrity"), F.lit("All masks opaque")).otherwise(F.lit("A mask failed verification")))
    plain = check("No image in structure mode", ~F.col("has_image"), F.lit(None))
    audit = F.when(F.col("audit").isNull(), check("OCR audit", F.lit(False), F.lit("Could not read back the outgoing image"))).otherwise(
        check("OCR audit", nothing(found), F.when(nothing(found), F.concat(F.size("audit").cast("string"), F.lit(" text lines read back, none sensitive"))).otherwise(F.concat(F.lit("Readable in the image: "), F.concat_ws(", ", found))))
    )
    checks = F.concat(
        F.array(
            check("Destination", S.destination_allowed(F.col("dest"), F.col("server_url")), S.origin_of(F.col("dest"))),
            check("Vault match", nothing(leaks("text")), F.when(nothing(leaks("text")), F.concat(F.coalesce("n_values", F.lit(0)).cast("string"), F.lit(" values checked"))).otherwise(F.concat(F.lit("Raw values for "), F.concat_ws(", ", leaks("text"))))),
            check("Pattern re-scan", nothing(F.col("text_classes")), F.when(nothing(F.col("text_classes")), F.lit("No raw identifiers")).otherwise(F.concat(F.lit("Untokenized "), F.concat_ws(", ", "text_classes")))),
            F.when(F.col("mode") == "pixel", image).otherwise(plain),
        ),
        F.when(F.coalesce("audited", F.lit(False)), F.array(audit)).otherwise(F.array().cast("array<struct<name:string,ok:boolean,detail:string>>")),
    )
    return rows.select("id", checks.alias("checks")).select("id", F.forall("checks", lambda c: c["ok"]).alias("ok"), "checks")


def plain_digits(text: Column) -> Column:
    """Decimal digits of all scripts as ASCII digits."""
    others = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return F.translate(text, "".join(others), "".join(str(unicodedata.digit(c)) for c in others))


#: What detect.may_hold seeks, with digits of all scripts.
GUARD_MAY_HOLD = r"(?U)@|\d[ -]?\d[ -]?\d[ -]?\d|[A-Z]{4}0"


def guard_class(text: Column, classes: tuple[str, ...] = tuple(X.GUARD_DETECTORS)) -> Column:
    """First of the classes that the receiving side's guard finds in one string, null if none."""
    shown = S.without_tokens(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for cls in (c for c in X.GUARD_DETECTORS if c in classes):
        out = out.when(F.size(pattern_spans(shown, cls, X.GUARD_DETECTORS, plain_digits)) > 0, F.lit(cls))
    return F.when(shown.rlike(GUARD_MAY_HOLD), out)


def guard_leaks(leaf: Column, classes: tuple[str, ...] = tuple(X.GUARD_DETECTORS)) -> Column:
    """array<struct(path, class)> of the strings in which the guard finds one of the classes."""
    told = F.transform(leaf, lambda x: F.struct(x["path"].alias("path"), guard_class(x["value"], classes).alias("class")))
    return F.filter(told, lambda x: x["class"].isNotNull())
