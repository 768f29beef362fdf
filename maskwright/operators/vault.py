"""The vault: one placeholder for each normalised value, numbered by class in the order of first sight.

vault: key, token, cls, value, source, valid, n, first_ord. Values of SECRET, FACE, SIGNATURE, QR and IMAGE are not
stored and have the class in their key; other keys don't, so one value in two classes keeps the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from .ranking import numbered

COLUMNS = ["key", "token", "cls", "value", "source", "valid", "n", "first_ord"]


def vault_key(cls: Column, value: Column) -> Column:
    return F.when(cls.isin(X.NO_VALUE), F.concat(cls, F.lit("|"), value)).otherwise(S.normalize_value(cls, value))


def secret_slot(source: Column, label: Column, name: Column, id_attr: Column) -> Column:
    """The value under which the secret of a field goes: where it is, never what it is."""
    shown = S.collapse(label)
    return F.concat(source, F.lit("|"), F.when(shown != "", shown).when(name != "", name).otherwise(id_attr))


def first_seen(sightings: DataFrame) -> DataFrame:
    """Of sightings (cls, value, source, valid, ord) the first for each key. ord: anything that sorts, without ties."""
    keyed = sightings.withColumn("key", vault_key(F.col("cls"), F.col("value")))
    one = keyed.groupBy("key").agg(F.min("ord").alias("first_ord"), F.min_by(F.struct("cls", "value", "source", "valid"), "ord").alias("e"))
    value = F.when(F.col("e.cls").isin(X.NO_VALUE), F.lit("")).otherwise(F.col("e.value"))
    return one.select("key", "first_ord", F.col("e.cls").alias("cls"), value.alias("value"), F.col("e.source").alias("source"), F.col("e.valid").alias("valid"))


def build_vault(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The vault after these sightings; `known` entries keep their placeholders, new ones are numbered after them."""
    new = first_seen(sightings)
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
    new = numbered(new, "cls", ["first_ord", "key"], "n")
    if known is not None:
        tops = known.groupBy("cls").agg(F.max("n").alias("top"))
        new = new.join(tops, "cls", "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0))).drop("top")
    new = new.withColumn("token", S.make_token(F.col("cls"), F.col("n")))
    return new.select(*COLUMNS) if known is None else known.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def entities(vault: DataFrame) -> DataFrame:
    """What may be told of entries: never the value nor the key."""
    hint = F.when(F.col("value") != "", S.format_hint(F.col("cls"), F.col("value")))
    return vault.select("token", F.col("cls").alias("class"), S.group_of(F.col("cls")).alias("group"), hint.alias("format"), F.col("valid").alias("valid_checksum"), "source")


def stored(vault: DataFrame) -> DataFrame:
    return vault.where(F.col("value") != "")


def dictionary(vault: DataFrame) -> DataFrame:
    """term, cls, token: values of dictionary classes, and for names each of their words, three characters at least."""
    v = S.strip(F.col("value"))
    words = F.when(F.col("cls") == "NAME", F.split(v, f"{X.SPACE}+")).otherwise(F.array().cast("array<string>"))
    terms = F.array_distinct(F.filter(F.concat(F.array(v), words), lambda t: F.length(t) >= 3))
    return stored(vault).where(F.col("cls").isin(X.DICTIONARY_CLASSES)).select(F.explode(terms).alias("term"), "cls", "token")


def rehydrate(texts: DataFrame, vault: DataFrame, text: str = "text", out: str = "rehydrated") -> DataFrame:
    """Placeholders replaced by their values; unknown ones, and those without a stored value, stay.

    texts has `item`, a unique id. Only the placeholders travel to the vault.
    """
    tokens = S.tokens_in(F.col(text))
    asked = texts.select("item", F.posexplode(tokens).alias("i", "token"))
    told = asked.join(stored(vault).select("token", "value"), "token", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", "token").alias("v")))).alias("_told"))
    gaps = F.split(F.col(text), X.TOKEN, -1)
    whole = F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_told"), i)["v"], F.lit("")))))
    return texts.join(told, "item", "left").withColumn(out, F.when(F.col("_told").isNull(), F.col(text)).otherwise(whole)).drop("_told")


def expired(last_used: Column, now: Column) -> Column:
    return now - last_used > F.expr(f"INTERVAL {X.TTL_SECONDS} SECONDS")


def to_json(vault: DataFrame) -> DataFrame:
    return vault.select(F.to_json(F.struct(*COLUMNS)).alias("json"))


def from_json(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(F.from_json("json", schema).alias("e")).select("e.*")


def save_vault(vault: DataFrame, path: str, used: str) -> None:
    """To a new folder, with the time of last use; readers change over by the folder's name."""
    vault.withColumn("last_used", F.to_timestamp(F.lit(used))).write.mode("errorifexists").parquet(path)


def restore_vault(spark, path: str, now: str) -> DataFrame:
    """The saved vault, or an empty one if it has been unused for more than its time to live."""
    kept = spark.read.parquet(path)
    return kept.where(~expired(F.col("last_used"), F.to_timestamp(F.lit(now)))).drop("last_used")
