"""The rule planner: actions for a sanitized screen, by ordered rules over its elements and entities.

requests: request_id, session_id, step, screen (path_template, elements), entities. All rules are expressions over one
row; only the loop guard looks at other rows, the earlier clicks of a session on the same button of the same screen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import scalars as S
from ..streaming.live import stream_clicks

ACTION = "struct<type:string,target:int,text:string,requires_confirmation:boolean,message:string>"
ACTIONS = f"array<{ACTION}>"


def action(type_: str, target=None, text=None, confirm=None, message=None) -> Column:
    of = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(F.lit(type_).alias("type"), of(target, "int").alias("target"), of(text, "string").alias("text"), of(confirm, "boolean").alias("requires_confirmation"), of(message, "string").alias("message"))


def screen_signature(path_template: Column, elements: Column) -> Column:
    """Path and a hash of role and label of the first elements."""
    told = F.transform(F.slice(elements, 1, X.MAX_SIGNATURE), lambda e: F.concat_ws(":", e["role"], e["label"]))
    return F.concat(path_template, F.lit("#"), F.xxhash64(F.concat_ws("|", told)).cast("string"))


def _or(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in cols:
        out = out.when(F.coalesce(c, F.lit("")) != "", c)
    return out


def _why(filled: Column, tail: Column) -> Column:
    return F.when(F.size(filled) > 0, F.concat(F.lit("Fill "), F.array_join(filled, ", "), F.lit("; "), tail, F.lit("."))).otherwise(F.concat(F.upper(F.left(tail, F.lit(1))), F.substring(tail, 2, 1 << 30), F.lit(".")))


#: What deciding needs of a request.
PREPARED = ["request_id", "session_id", "step", "typed", "filled", "missing", "asked", "button", "presses"]


def prepared(requests: DataFrame) -> DataFrame:
    """requests with what can be typed, is missing, is asked for, and the button; whether it is pressed, and on which
    screen (screen_key). Each row for itself, so batches and streams alike."""
    usable = F.filter("entities", lambda e: ~e["class"].isin(X.NO_VALUE))
    first = F.aggregate(usable, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["class"]), m).otherwise(F.map_concat(m, F.create_map(e["class"], e["token"]))))
    rows = requests.withColumn("first", first).withColumn("els", F.col("screen.elements"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    off = lambda e: F.coalesce(e["disabled"], F.lit(False))
    secret = lambda e: e["field_class"].eqNullSafe(F.lit("SECRET")) | (e["role"] == "password")
    rows = rows.withColumn("open", F.filter("els", lambda e: e["role"].isin("textbox", "password") & ~off(e) & blank(e["value"])))
    rows = rows.withColumn("asked", F.filter("open", secret))
    rows = rows.withColumn("fill", F.filter("open", lambda e: ~secret(e) & F.coalesce(F.map_contains_key(F.col("first"), e["field_class"]), F.lit(False))))
    rows = rows.withColumn("typed", F.transform("fill", lambda e: action("type", e["id"], F.try_element_at(F.col("first"), e["field_class"]))))
    rows = rows.withColumn("filled", F.transform("fill", lambda e: _or(e["label"], e["field_class"])))
    rows = rows.withColumn("missing", F.filter("els", lambda e: (e["role"] == "textbox") & F.coalesce(e["required"], F.lit(False)) & blank(e["value"]) & ~F.exists("typed", lambda a: a["target"] == e["id"])))
    rows = rows.withColumn("button", F.try_element_at(F.filter("els", lambda e: (e["role"] == "button") & ~off(e) & F.coalesce(e["label"], F.lit("")).rlike(S.java(X.PRIMARY))), F.lit(-1)))
    rows = rows.withColumn("presses", (F.size("asked") == 0) & F.col("button").isNotNull() & (F.size("missing") == 0))
    return rows.withColumn("screen_key", F.concat(screen_signature(F.col("screen.path_template"), F.col("els")), F.lit(":"), F.col("button.label")))


def plan(requests: DataFrame) -> DataFrame:
    """request_id, session_id, step, actions, rationale and done."""
    rows = prepared(requests)
    earlier = Window.partitionBy("session_id", "presses", "screen_key").orderBy("step", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    return decided(rows.withColumn("clicked", F.col("presses") & (F.count(F.lit(1)).over(earlier) > 0)))


def stream_plan(requests: DataFrame, ttl_seconds: int = X.TTL_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """plan() over a stream of requests, which also have `ts`: the clicks of a session are running state, and go when
    nothing came for the time to live."""
    rows = prepared(requests)
    kind = T.StructType([rows.schema[c] for c in PREPARED])
    fed = rows.select("session_id", "request_id", "ts", "presses", "screen_key", F.to_json(F.struct(*PREPARED)).alias("note"))
    told = stream_clicks(fed, ttl_seconds, watermark)
    return decided(told.select(F.from_json("note", kind).alias("r"), F.coalesce("clicked", F.lit(False)).alias("clicked")).select("r.*", "clicked"))


def decided(rows: DataFrame) -> DataFrame:
    """The actions of prepared requests, by the first rule that holds; clicked: whether the loop guard knows the click."""
    asked, button, lacks = F.get("asked", F.lit(0)), F.col("button"), F.get("missing", F.lit(0))
    result = lambda actions, why, done=False: F.struct(actions.cast(ACTIONS).alias("actions"), why.alias("rationale"), F.lit(done).alias("done"))
    plus = lambda a: F.concat(F.col("typed"), F.array(a))
    names = lambda n, *alt: F.array_join(F.transform(n, lambda e: F.coalesce(_or(e["label"], *[e[a] for a in alt]), F.lit("field"))), ", ")
    press = action("click", button["id"], None, S.irreversible(button["label"], "server"))
    none = F.array().cast(ACTIONS)
    decided = (
        F.when(F.size("asked") > 0, result(
            plus(action("ask_user", asked["id"], None, None, F.concat(F.lit("Please enter your "), F.coalesce(_or(asked["label"]), F.lit("secret")), F.lit(" yourself. Secrets are never typed for you.")))),
            _why(F.col("filled"), F.concat(F.lit("waiting for the user to fill “"), F.coalesce(asked["label"], F.lit("")), F.lit("”")))))
        .when(F.col("clicked") & (F.size("typed") == 0), result(
            F.concat(none, F.array(action("done", None, None, None, F.lit("The page did not change after the last click. Handing back to you.")))), F.lit("Stopped to avoid a loop."), True))
        .when(F.col("presses"), result(plus(press), _why(F.col("filled"), F.concat(F.lit("then press “"), button["label"], F.lit("”")))))
        .when(F.size("typed") > 0, result(F.col("typed"), _why(F.col("filled"), F.concat(F.lit("still missing: "), F.coalesce(_or(names(F.col("missing"), "field_class")), F.lit("none"))))))
        .when(F.size("missing") > 0, result(
            F.concat(none, F.array(action("ask_user", lacks["id"], None, None, F.concat(F.lit("I don't have values for: "), names(F.slice("missing", 1, X.MAX_MISSING)), F.lit(". Please fill them in."))))), F.lit("Missing information the page requires.")))
        .otherwise(result(F.concat(none, F.array(action("done", None, None, None, F.lit("Nothing left to fill on this page.")))), F.lit("No fillable fields or next step found."), True))
    )
    return rows.withColumn("r", decided).select("request_id", "session_id", "step", "r.actions", "r.rationale", "r.done")


def broken_references(plans: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and the targets and placeholders of its actions that the request doesn't have."""
    both = plans.join(requests.select("request_id", "screen", "entities"), "request_id")
    targets = F.array_except(F.filter(F.transform("actions", lambda a: a["target"]), lambda t: t.isNotNull()), F.transform("screen.elements", lambda e: e["id"].cast("int")))
    used = F.flatten(F.transform(F.filter("actions", lambda a: a["type"] == "type"), lambda a: S.tokens_in(a["text"])))
    tokens = F.array_sort(F.array_except(used, F.transform("entities", lambda e: e["token"])))
    return both.select("request_id", targets.alias("unknown_targets"), tokens.alias("unknown_tokens")).where((F.size("unknown_targets") > 0) | (F.size("unknown_tokens") > 0))


def described(a: Column) -> Column:
    """An action for the log: placeholders only."""
    return F.concat_ws(" ", a["type"], F.when(a["target"].isNotNull(), F.concat(F.lit("#"), a["target"].cast("string"))), F.when(a["type"] == "type", a["text"]))
