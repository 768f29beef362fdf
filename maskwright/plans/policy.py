"""Verdicts on actions, by ordered rules: allow, confirm or deny."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def decide(actions: DataFrame, vault: DataFrame) -> DataFrame:
    """actions (id, scope, type, text, requires_confirmation, field_class, label, origin, allowed_origins) with
    `verdict` and `reason`. vault has scope, token and cls. The first placeholder that fails decides."""
    asked = actions.where("type = 'type'").select("id", "scope", "field_class", "label", F.posexplode(S.tokens_in(F.col("text"))).alias("i", "token"))
    told = asked.join(vault.select("scope", "token", "cls"), ["scope", "token"], "left")
    into = F.when(F.coalesce("label", F.lit("")) == "", F.lit("unlabelled field")).otherwise(F.col("label"))
    verdict = lambda v, *r: F.struct(F.lit(v).alias("verdict"), F.concat(*r).alias("reason"))
    fails = (
        F.when(F.col("cls").isNull(), verdict("deny", F.col("token"), F.lit(" is not a known placeholder.")))
        .when(F.col("cls") == "SECRET", verdict("deny", F.lit("Secrets are never typed automatically.")))
        .when(~S.compatible(F.col("field_class"), F.col("cls")), verdict("confirm", F.lit("Type "), F.col("token"), F.lit(" ("), F.col("cls"), F.lit(") into “"), into, F.lit("”?")))
    )
    first = told.withColumn("f", fails).where("f is not null").groupBy("id").agg(F.min_by("f", "i").alias("f"))
    acts = F.col("type").isin("type", "click", "select")
    away = ~F.coalesce(F.array_contains("allowed_origins", F.col("origin")), F.lit(False)) & acts
    once = (F.col("type") == "click") & (F.coalesce("requires_confirmation", F.lit(False)) | S.irreversible(F.col("label"), "client"))
    out = (
        F.when(away, verdict("confirm", F.lit("The page is now "), F.coalesce("origin", F.lit("")), F.lit(", which was not part of this task.")))
        .when((F.col("type") == "type") & F.col("f").isNotNull(), F.col("f"))
        .when(once, verdict("confirm", F.lit("Click “"), F.coalesce("label", F.lit("")), F.lit("”? This may not be reversible.")))
        .otherwise(F.struct(F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("reason")))
    )
    return actions.join(first, "id", "left").withColumn("v", out).select(*[actions[c] for c in actions.columns], "v.verdict", "v.reason")
