"""The planning service over recorded calls: each step request gets a status, an error, and its plan if it is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..operators.audit import guard_leaks, leaves
from .planner import broken_references, plan


def same_major(version: Column) -> Column:
    return F.coalesce(F.split(version, r"\.")[0] == X.VERSION.split(".")[0], F.lit(False))


def created_sessions(calls: DataFrame, salt: str | None = None) -> DataFrame:
    """status, session_id, token and max_steps for each call (call_id, vrs_version) that asks for a session; 409 and no
    session where the major version differs. Ids and tokens are random, or follow from call_id and a salt in tests."""
    key = F.uuid() if salt is None else F.col("call_id").cast("string")
    made = calls.withColumn("_a", F.sha2(F.concat_ws("|", F.lit(salt or "id"), key), 256)).withColumn("_b", F.sha2(F.concat_ws("|", F.lit(salt or "token"), F.uuid() if salt is None else F.reverse(key), F.col("_a")), 256))
    fine = same_major(F.col("vrs_version"))
    return made.select("call_id", F.when(fine, 200).otherwise(409).alias("status"), F.when(fine, F.concat(F.lit("s_"), F.left("_a", F.lit(8)))).alias("session_id"), F.when(fine, F.col("_b")).alias("token"), F.when(fine, F.lit(X.MAX_STEPS_SERVER)).alias("max_steps"))


def live_sessions(calls: DataFrame) -> DataFrame:
    """calls (call_id, session_id, ts, kind, bearer, session_token) with `authorised`.

    kind is create, step or delete. A session lives from its creation until its deletion, or until it has gone without
    an authorised call for more than its time to live; calls with a wrong bearer don't keep it alive.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "call_id")
    rows = calls.withColumn("opens", (F.col("kind") == "create").cast("int"))
    right = (F.col("kind") == "create") | F.coalesce(F.col("bearer") == F.col("session_token"), F.lit(False))
    rows = rows.withColumn("right", right).withColumn("life", F.sum("opens").over(order))
    within = Window.partitionBy("session_id", "life").orderBy("ts", "call_id")
    last = F.last(F.when(F.col("right"), F.col("ts")), True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("ts") - last > F.expr(f"INTERVAL {X.TTL_SECONDS} SECONDS")
    over = F.max(F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)) > 0
    ended = F.coalesce(F.max(F.when(F.col("right") & (F.col("kind") == "delete"), 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    return rows.withColumn("authorised", F.col("right") & (F.col("life") > 0) & ~over & ~ended).drop("opens", "right", "life")


def step_calls(requests: DataFrame) -> DataFrame:
    """requests: request_id, ts, schema_ok, authorised, n_bytes and the fields of a step request.

    Returns request_id, status, error, leaks, actions, rationale and done. The first rule that fails gives the status:
    413 size, 422 schema, 401 session, 409 version, 422 raw values, 400 image, 429 steps, 500 references. Steps count
    once a request passes all rules before the limit.
    """
    body = F.struct("session_id", "vrs_version", "goal", "mode", "screen", "entities", "history")
    kind = T.StructType([requests.schema[c] for c in ("session_id", "vrs_version", "goal", "mode", "screen", "entities", "history")])
    yes = lambda c: F.coalesce(c, F.lit(False))
    refused = (
        F.when(F.col("n_bytes") > X.MAX_BODY, 413)
        .when(~yes(F.col("schema_ok")), 422)
        .when(~yes(F.col("authorised")), 401)
        .when(~same_major(F.col("vrs_version")), 409)
    )
    rows = requests.withColumn("refused", refused)
    found = guard_leaks(leaves(body, kind))
    rows = rows.withColumn("leaks", F.when(F.col("refused").isNull(), found).otherwise(F.array().cast("array<struct<path:string,class:string>>")))
    early = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.size("leaks") > 0, 422)
        .when((F.col("mode") == "pixel") & (F.coalesce("screen.image", F.lit("")) == ""), 400)
    )
    rows = rows.withColumn("early", early).withColumn("counts", F.col("early").isNull())
    so_far = Window.partitionBy("session_id", "counts").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n_steps", F.when(F.col("counts"), F.count(F.lit(1)).over(so_far)))
    rows = rows.withColumn("status", F.coalesce("early", F.when(F.col("n_steps") > X.MAX_STEPS_SERVER, 429)))
    fine = rows.where("status is null")
    plans = plan(fine.withColumn("step", F.col("n_steps").cast("int")))
    broken = broken_references(plans, fine).select("request_id", F.lit(True).alias("broken"))
    out = rows.join(plans.drop("session_id", "step"), "request_id", "left").join(broken, "request_id", "left")
    status = F.coalesce("status", F.when(F.col("broken"), 500), F.lit(200))
    words = {413: "Payload too large", 401: "Unknown session or bad token", 409: f"Server speaks {X.VERSION}", 400: "Pixel mode requires an image", 429: "Step limit reached", 500: "Planner referenced what the request lacks"}
    error = F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), status)
    error = F.coalesce(error, F.when(status == 422, F.when(F.size("leaks") > 0, F.lit("raw_pii")).otherwise(F.lit("schema"))))
    good = lambda c: F.when(status == 200, F.col(c)).alias(c)
    return out.select("request_id", status.cast("int").alias("status"), error.alias("error"), "leaks", good("actions"), good("rationale"), good("done"))
