"""Queries over strings, the vault, recorded calls of the planning service and streams; with SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import fixed as X
from .functions import scalars as S
from .operators import audit, ranking
from .operators import detect as D
from .operators import vault as V
from .plans import api, planner
from .queries import _ISLANDS, _read, _sql_rules, query
from .screen_queries import _padded, _text
from .sources import synth, wire
from .streaming import live, sessions, vaults


def _new_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{ranking.shared_folder(spark)}/maskwright-queries/{uuid.uuid4().hex}"


# --- strings ---


@query("""SELECT c_custkey, 'to ' || repeat(' ', 7 + length(CAST(c_custkey AS VARCHAR))) || ' and ' || repeat(' ', 5) || '.' AS blanked, c_name || ' x ' || c_mktsegment AS collapsed, 2 AS first_at, length(c_name) + 5 + length(c_mktsegment) AS until FROM customer""")
def text_forms(spark, sf_dir):
    """Placeholders blanked, white space collapsed, and where visible text begins and ends."""
    odd = _text("  ", F.col("c_name"), " \t", F.lit("x"), "\n ", F.col("c_mktsegment"), "\r\n")
    bounds = _text("  ", F.col("c_name"), " x ", F.col("c_mktsegment"), " ﻿ ")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", S.blanked_tokens(_text("to ⟦NAME_", F.col("c_custkey"), "⟧ and ⟦A_1⟧.")).alias("blanked"), S.collapse(odd).alias("collapsed"), S.first_visible(bounds).alias("first_at"), S.trimmed_length(bounds).alias("until"))


_OCR = ["Dateofbirth", "Fullname", "UPI PIN", "Pincode", "Account no", "Landmark x", "Validthru", "Permanentaccount", "Status", "Username"]
_LOOSE = [(re.sub(r" \??", " ?", p), c) for p, c in X.CONTEXT_RULES]


@query(f"""WITH l AS (SELECT c_custkey, [{", ".join(f"'{x}'" for x in _OCR)}][CAST(c_custkey % {len(_OCR)} + 1 AS BIGINT)] || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_mktsegment ELSE '' END AS label FROM customer)
SELECT c_custkey, {_sql_rules("regexp_replace(lower(label), '[_-]+', ' ', 'g')", _LOOSE)} AS cls FROM l""")
def ocr_label_class(spark, sf_dir):
    """Classes by labels read from pixels, with spaces missing."""
    label = F.element_at(F.array(*map(F.lit, _OCR)), (F.col("c_custkey") % len(_OCR) + 1).cast("int"))
    label = F.concat(label, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(F.lit("")))
    return _read(spark, sf_dir, "customer").select("c_custkey", S.class_from_ocr_label(label).alias("cls"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment AS terms, 'a\\.b\\*' || c_custkey AS escaped FROM customer")
def custom_terms(spark, sf_dir):
    """Terms of a setting: trimmed, three characters at least, distinct; and a literal made a pattern."""
    raw = _text(" ", F.col("c_name"), ", ab,", F.col("c_mktsegment"), "\n", F.col("c_name"), "\n\n")
    return _read(spark, sf_dir, "customer").select("c_custkey", F.array_join(D.clean_terms(raw), "|").alias("terms"), S.escaped(_text("a.b*", F.col("c_custkey"))).alias("escaped"))


# --- payloads ---


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 9 = 8 THEN '{"role":' ELSE CAST(json_object('role', role, 'image', json_object('text', text), 'said', json_array(json_object('text', text, 'marks', json_array('a', json_array(role, turn))), turn, json_object(), NULL), 'to be', json_object('deep', json_array(json_array(json_array(text))))) AS VARCHAR) END AS json FROM conversations),
t AS (SELECT conv_id, turn, j.fullkey AS k, j.atom->>'$' AS v FROM p, LATERAL json_tree(p.json) j WHERE p.turn % 9 <> 8 AND j.type = 'VARCHAR' AND NOT starts_with(j.fullkey, '$.image'))
SELECT conv_id, turn, replace(CASE WHEN starts_with(k, '$.') THEN substr(k, 3) ELSE substr(k, 2) END, '"', '') AS path, v AS value, false AS unreadable FROM t UNION ALL SELECT conv_id, turn, NULL, NULL, true FROM p WHERE turn % 9 = 8""")
def payload_leaves(spark, sf_dir):
    """All strings of nested payloads of conversations, whatever their shape; cut ones are told."""
    role, text = F.expr("substring(r, 6, length(r) - 6)"), F.expr("substring(t, 6, length(t) - 6)")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("x"))).alias("r"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x"))).alias("t"))
    whole = _text('{"role":', role, ',"image":{"text":', text, '},"said":[{"text":', text, ',"marks":["a",[', role, ",", F.col("turn"), "]]},", F.col("turn"), ',{},null],"to be":{"deep":[[[', text, "]]]}}")
    rows = rows.select(F.struct("conv_id", "turn").alias("id"), F.when(F.col("turn") % 9 == 8, F.lit('{"role":')).otherwise(whole).alias("json"))
    return audit.json_leaves(rows).select("id.conv_id", "id.turn", "path", "value", F.col("error").isNotNull().alias("unreadable"))


@query(r"""WITH a AS (SELECT conv_id, 'CUSTOM' AS cls, regexp_extract(text, '[A-Za-z]{4,}') AS v FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 'NAME', regexp_extract(text, '[A-Za-z]{3,} [A-Za-z]{3,}') FROM conversations WHERE turn = 1),
v AS (SELECT DISTINCT conv_id, cls, v FROM a WHERE v <> ''), c AS (SELECT DISTINCT conv_id, turn, text FROM conversations)
SELECT c.conv_id, c.turn, v.cls, v.v AS value FROM c JOIN v USING (conv_id) WHERE contains(lower(c.text), lower(v.v)) AND v.cls = 'CUSTOM'
 OR v.cls = 'NAME' AND (regexp_matches(c.text, '(?i)' || replace(v.v, ' ', '\s+')) OR regexp_matches(c.text, '(?i)\b(' || replace(v.v, ' ', '|') || ')\b'))""")
def conversation_leaks(spark, sf_dir):
    """Turns in which what the vault of their conversation holds shows: a word of the first turn, two of the second as a name."""
    c = _read(spark, sf_dir, "conversations")
    taken = lambda turn, cls, pattern: c.where(F.col("turn") == turn).select(F.col("conv_id").cast("string").alias("scope"), F.lit(cls).alias("cls"), F.regexp_extract("text", pattern, 0).alias("value"))
    vault = taken(0, "CUSTOM", "[A-Za-z]{4,}").unionByName(taken(1, "NAME", "[A-Za-z]{3,} [A-Za-z]{3,}")).where("value <> ''").distinct()
    vault = vault.withColumn("n", F.lit(1)).withColumn("token", F.to_json(F.struct("cls", "value")))
    texts = c.select("conv_id", "turn", "text").distinct().select(F.struct("conv_id", "turn", "text").alias("id"), F.col("conv_id").cast("string").alias("scope"), "text")
    found = audit.leaked_values(texts, vault)
    return found.select("id.conv_id", "id.turn", "cls", F.get_json_object("token", "$.value").alias("value"))


# --- vault ---


def _entries(spark, sf_dir) -> DataFrame:
    """A vault of a name, an e-mail, a card and a secret in turn for each customer."""
    k = F.col("c_custkey")
    cls = F.element_at(F.array(*map(F.lit, ["NAME", "EMAIL", "CARD", "SECRET"])), (k % 4 + 1).cast("int"))
    value = F.when(k % 4 == 0, _text("Ana ", F.col("c_name"))).when(k % 4 == 1, _text("u", k, "@mail.example")).when(k % 4 == 2, _text("4111 ", k)).otherwise(_text("s|PIN", k))
    return V.build_vault(_read(spark, sf_dir, "customer").select(cls.alias("cls"), value.alias("value"), F.lit("s").alias("source"), F.lit(None).cast("boolean").alias("valid"), k.alias("ord")))


_SQL_ENTRIES = """v AS (SELECT c_custkey, ['NAME', 'EMAIL', 'CARD', 'SECRET'][CAST(c_custkey % 4 + 1 AS BIGINT)] AS cls, CASE c_custkey % 4 WHEN 0 THEN 'Ana ' || c_name WHEN 1 THEN 'u' || c_custkey || '@mail.example' WHEN 2 THEN '4111 ' || c_custkey ELSE '' END AS value,
 '⟦' || ['NAME', 'EMAIL', 'CARD', 'SECRET'][CAST(c_custkey % 4 + 1 AS BIGINT)] || '_' || row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) || '⟧' AS token, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS n FROM customer)"""


@query(f"""WITH {_SQL_ENTRIES} SELECT value AS term, cls, token FROM v WHERE cls IN ('NAME', 'EMAIL') UNION ALL SELECT unnest(['Ana', substr(value, 5)]), cls, token FROM v WHERE cls = 'NAME'""")
def dictionary_terms(spark, sf_dir):
    """Values that texts are searched for, and the words of names."""
    return V.dictionary(_entries(spark, sf_dir))


@query(f"WITH {_SQL_ENTRIES} SELECT token, cls, value, n FROM v")
def vault_json(spark, sf_dir):
    """The vault as lines of JSON, and back."""
    vault = _entries(spark, sf_dir)
    return V.from_json(V.to_json(vault), vault.schema.simpleString()).select("token", "cls", "value", "n")


@query(f"WITH {_SQL_ENTRIES} SELECT token, value FROM v")
def vault_restored(spark, sf_dir):
    """A vault that was saved and read within its time to live, and one that was read a second too late, of which nothing is left."""
    saved, late = _new_folder(spark), _new_folder(spark)
    V.save_vault(_entries(spark, sf_dir), saved, "2026-01-01 10:00:00")
    V.save_vault(_entries(spark, sf_dir), late, "2026-01-01 09:59:59")
    return V.restore_vault(spark, saved, "2026-01-01 10:15:00").unionByName(V.restore_vault(spark, late, "2026-01-01 10:15:00")).select("token", "value")


@query("SELECT c_custkey, c_custkey || '|' || CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'pin' ELSE 'id' || c_custkey END AS slot FROM customer")
def secret_slots(spark, sf_dir):
    """What a secret goes under: its label, else its name, else its id."""
    k = F.col("c_custkey")
    label, name = F.when(k % 3 == 0, _text("  ", F.col("c_mktsegment"), " ")).otherwise(F.lit(" ")), F.when(k % 3 == 1, F.lit("pin")).otherwise(F.lit(""))
    return _read(spark, sf_dir, "customer").select("c_custkey", V.secret_slot(k.cast("string"), label, name, _text("id", k)).alias("slot"))


def _streamed(spark, sf_dir, table: str) -> DataFrame:
    return spark.readStream.schema(_read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parquet*")


@query("""WITH s AS (SELECT 'NAME' AS cls, c_mktsegment AS value, c_custkey AS ord FROM customer UNION ALL SELECT 'ADDRESS', c_nationkey || ' Lake Road', c_custkey FROM customer), f AS (SELECT cls, value, min(ord) AS ord FROM s GROUP BY ALL)
SELECT '⟦' || cls || '_' || row_number() OVER (PARTITION BY cls ORDER BY ord) || '⟧' AS token, value FROM f""")
def vault_running(spark, sf_dir):
    """The vault that a stream of sightings fills; a second stream of the same finds nothing new, and a vault that was
    wiped in between is the same again."""
    path = _new_folder(spark)
    seen = F.explode(F.array(F.struct(F.lit("NAME").alias("cls"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("ADDRESS").alias("cls"), _text(F.col("c_nationkey"), " Lake Road").alias("value")))).alias("e")
    stream = _streamed(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.lit("s").alias("source"), F.lit(None).cast("boolean").alias("valid"), seen).select("ord", "source", "valid", "e.*")
    for again in range(3):
        if again == 1:
            vaults.wipe_vault(spark, path)
        vaults.keep_vault(stream, path, f"{path}-state-{again}").awaitTermination()
    return vaults.vault_version(spark, path).select("token", "value")


@query("""WITH s AS (SELECT 'NAME' AS cls, c_name AS value, c_custkey AS ord, c_custkey % 2 AS w FROM customer UNION ALL SELECT 'ADDRESS', c_nationkey || ' Lake Road', c_custkey, c_custkey % 2 FROM customer),
f AS (SELECT cls, value, max(w) AS won, coalesce(min(CASE WHEN w = 1 THEN ord END), min(ord)) AS ord FROM s GROUP BY ALL)
SELECT '⟦' || cls || '_' || row_number() OVER (PARTITION BY cls ORDER BY won DESC, ord) || '⟧' AS token, value, won = 1 AS seen_before FROM f""")
def vault_two_writers(spark, sf_dir):
    """Two writers of one vault at once: the one that loses the commit numbers after the one that won; and what a reader
    sees who holds on to the version in between."""
    path = _new_folder(spark)
    c = _read(spark, sf_dir, "customer")
    seen = F.explode(F.array(F.struct(F.lit("NAME").alias("cls"), F.col("c_name").alias("value")), F.struct(F.lit("ADDRESS").alias("cls"), _text(F.col("c_nationkey"), " Lake Road").alias("value")))).alias("e")
    s = c.select("c_custkey", F.struct("c_custkey").alias("ord"), F.lit("s").alias("source"), F.lit(None).cast("boolean").alias("valid"), seen).select("c_custkey", "ord", "source", "valid", "e.*")
    part = lambda k: s.where(F.col("c_custkey") % 2 == k).drop("c_custkey")
    first, won = vaults.VaultStore(spark, path), []

    def other() -> None:
        if not won:
            won.append(vaults.VaultStore(spark, path).update(part(1)))

    first.update(part(0), before_commit=other)
    before = first.read(won[0]).select("key", F.lit(True).alias("b"))
    return first.read().join(before, "key", "left").select("token", "value", F.coalesce("b", F.lit(False)).alias("seen_before"))


# --- calls ---


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 409 ELSE 200 END AS status, CASE WHEN c_custkey % 3 > 0 THEN 's_' || left(sha256('t|' || c_custkey), 8) END AS session_id, c_custkey % 3 > 0 AS has_token, CASE WHEN c_custkey % 3 > 0 THEN 25 END AS max_steps FROM customer""")
def session_calls(spark, sf_dir):
    """Sessions made for calls of the same major version."""
    calls = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.when(F.col("c_custkey") % 3 == 0, "2.0").when(F.col("c_custkey") % 3 == 1, "1.7").otherwise("1.0").alias("vrs_version"))
    return api.created_sessions(calls, "t").select(F.col("call_id").alias("c_custkey"), "status", "session_id", (F.length("token") == 64).alias("t"), "max_steps").select("c_custkey", "status", "session_id", F.coalesce("t", F.lit(False)).alias("has_token"), "max_steps")


@query("""WITH RECURSIVE c AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN 'create' WHEN event_id % 7 = 0 THEN 'delete' ELSE 'step' END AS kind, event_id % 5 > 0 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT event_id, user_id, i, kind = 'create' AS alive, ts AS last, kind = 'create' AS authorised FROM c WHERE i = 1
 UNION ALL SELECT c.event_id, c.user_id, c.i,
  CASE WHEN c.kind = 'create' THEN true WHEN NOT w.alive OR c.ts - w.last > INTERVAL 15 MINUTE THEN false WHEN c.kind = 'delete' AND c.good THEN false ELSE true END,
  CASE WHEN c.kind = 'create' OR c.good THEN c.ts ELSE w.last END,
  c.kind = 'create' OR (c.good AND w.alive AND c.ts - w.last <= INTERVAL 15 MINUTE)
 FROM w JOIN c ON c.user_id = w.user_id AND c.i = w.i + 1)
SELECT event_id, authorised FROM w""")
def live_calls(spark, sf_dir):
    """Which calls of a user's session find it alive and have the right bearer."""
    k = F.col("event_id")
    kind = F.when(k % 11 == 0, "create").when(k % 7 == 0, "delete").otherwise("step")
    calls = _read(spark, sf_dir, "events").select(k.alias("call_id"), F.col("user_id").alias("session_id"), "ts", kind.alias("kind"), F.when(k % 5 > 0, "a").otherwise("b").alias("bearer"), F.lit("a").alias("session_token"))
    return api.live_sessions(calls).select(F.col("call_id").alias("event_id"), "authorised")


def _calls(spark, sf_dir) -> DataFrame:
    """A step request for each order, one in ten of each fault; customers share forty sessions."""
    k = F.col("o_orderkey") % 10
    element = "array<struct<id:int,role:string,label:string,value:string,field_class:string,required:boolean,disabled:boolean>>"
    row = lambda i, role, label, cls: F.struct(F.lit(i), F.lit(role), F.lit(label), F.lit(None).cast("string"), F.lit(cls).cast("string"), F.lit(False), F.lit(False))
    screen = F.struct(_text("/form/", F.col("o_orderkey")).alias("path_template"), F.lit(None).cast("string").alias("image"), F.array(row(1, "textbox", "Full name", "NAME"), row(3, "button", "Continue", None)).cast(element).alias("elements"))
    goal = F.when(k == 4, F.lit("use PAN ABCPR1234K")).otherwise(F.lit("open an account for ⟦NAME_1⟧"))
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 40).cast("string").alias("session_id"), F.when(k == 0, X.MAX_BODY + 1).otherwise(100).alias("n_bytes"), (k != 1).alias("schema_ok"), (k != 2).alias("authorised"),
        F.when(k == 3, "2.1").otherwise("1.0").alias("vrs_version"), goal.alias("goal"), F.when(k == 5, "pixel").otherwise("structure").alias("mode"), screen.alias("screen"),
        F.array(F.struct(F.lit("⟦NAME_1⟧").alias("token"), F.lit("NAME").alias("class"))).alias("entities"), F.array().cast("array<struct<step:int,summary:string>>").alias("history"),
    )


@query("""WITH k AS (SELECT o_orderkey, o_custkey % 40 AS s, o_orderkey % 10 AS k, o_orderdate FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY s, k > 5 ORDER BY o_orderdate, o_orderkey) AS n FROM k)
SELECT o_orderkey, CASE k WHEN 0 THEN 413 WHEN 1 THEN 422 WHEN 2 THEN 401 WHEN 3 THEN 409 WHEN 4 THEN 422 WHEN 5 THEN 400 ELSE CASE WHEN n > 25 THEN 429 ELSE 200 END END AS status,
 CASE k WHEN 0 THEN 'Payload too large' WHEN 1 THEN 'schema' WHEN 2 THEN 'Unknown session or bad token' WHEN 3 THEN 'Server speaks 1.0' WHEN 4 THEN 'raw_pii' WHEN 5 THEN 'Pixel mode requires an image' ELSE CASE WHEN n > 25 THEN 'Step limit reached' END END AS error,
 CASE WHEN k = 4 THEN 'goal PAN' ELSE '' END AS leaks, CASE WHEN k > 5 AND n <= 25 THEN 'type #1 ⟦NAME_1⟧;click #3' END AS actions FROM n""")
def step_statuses(spark, sf_dir):
    """Status of each step request by the first rule that fails, and the described actions of those that pass."""
    out = api.step_calls(_calls(spark, sf_dir))
    leaks = F.array_join(F.transform("leaks", lambda x: F.concat_ws(" ", x["path"], x["class"])), ",")
    actions = F.array_join(F.transform("actions", planner.described), ";")
    return out.select(F.col("request_id").alias("o_orderkey"), "status", "error", leaks.alias("leaks"), actions.alias("actions"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '9' ELSE '' END AS unknown_targets, CASE WHEN c_custkey % 2 = 0 THEN '⟦NAME_2⟧' ELSE '' END AS unknown_tokens FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def broken_plans(spark, sf_dir):
    """Targets and placeholders of plans that their requests lack."""
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer").select(k.alias("request_id"), "c_custkey")
    requests = c.select("request_id", F.struct(F.array(F.struct(F.lit(1).alias("id"))).alias("elements")).alias("screen"), F.array(F.struct(F.lit("⟦NAME_1⟧").alias("token"))).alias("entities"))
    act = F.array(F.struct(F.lit("type").alias("type"), F.when(k % 3 == 0, 9).otherwise(1).alias("target"), F.concat(F.lit("⟦NAME_1⟧"), F.when(k % 2 == 0, F.lit(" ⟦NAME_2⟧")).otherwise(F.lit(""))).alias("text"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("boolean").alias("confirm")))
    broken = planner.broken_references(c.select("request_id", act.cast(planner.ACTIONS).alias("actions")), requests)
    return broken.select(F.col("request_id").alias("c_custkey"), F.array_join(F.transform("unknown_targets", lambda x: x.cast("string")), ",").alias("unknown_targets"), F.array_join("unknown_tokens", ",").alias("unknown_tokens"))


def _requests_built(spark, sf_dir) -> DataFrame:
    """The request that each customer's screen makes, after some steps."""
    k = F.col("c_custkey")
    screen = F.from_json(F.lit('{"origin": "https://a.example", "path_template": "/f", "title": "t", "state": {"class": "form", "confidence": 0.6, "src": "heuristic"}, "viewport": [1, 2], "elements": [], "texts": []}'), wire.SCREEN)
    history = F.transform(F.sequence(F.lit(1), (k % 12 + 1).cast("int")), lambda i: F.struct(i.alias("step"), _text("did ", i).alias("summary")))
    mode = F.when(k % 2 == 0, "pixel").otherwise("structure")
    made = wire.request_of(_text("buy for ⟦NAME_", k, "⟧"), screen, F.array().cast(f"array<{wire.ENTITY}>"), history, _text("s", k), (k % 12 + 2).cast("int"), mode, F.lit("data:image/png;base64,AA=="))
    return _read(spark, sf_dir, "customer").select("c_custkey", made.alias("r"))


@query("""SELECT c_custkey, 's' || c_custkey AS session_id, 'buy for ⟦NAME_' || c_custkey || '⟧' AS goal, least(8, c_custkey % 12 + 1) AS n_history, greatest(1, c_custkey % 12 + 1 - 7) AS first_step, c_custkey % 2 = 0 AS has_image FROM customer""")
def built_requests(spark, sf_dir):
    """Requests: the last eight steps, an image only in pixel mode."""
    return _requests_built(spark, sf_dir).select("c_custkey", "r.session_id", "r.goal", F.size("r.history").cast("long").alias("n_history"), F.get("r.history", F.lit(0))["step"].cast("long").alias("first_step"), F.col("r.screen.image").isNotNull().alias("has_image"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'extra' WHEN 2 THEN 'screen.secret' ELSE '' END AS unknown, CASE c_custkey % 5 WHEN 3 THEN 'goal' WHEN 4 THEN 'body' ELSE '' END AS missing, c_custkey % 5 = 0 AS schema_ok, CASE c_custkey % 5 WHEN 4 THEN NULL ELSE 's' || c_custkey END AS session_id FROM customer""")
def strict_requests(spark, sf_dir):
    """Requests as JSON: unknown and missing fields refuse them, and text that isn't JSON."""
    k = F.col("c_custkey")
    raw = _requests_built(spark, sf_dir).select("c_custkey", F.to_json("r").alias("json"))
    body = F.when(k % 5 == 1, F.regexp_replace("json", r"^\{", '{"extra":1,')).when(k % 5 == 2, F.regexp_replace("json", r'"screen":\{', '"screen":{"secret":2,')).when(k % 5 == 3, F.regexp_replace("json", r'"goal":"[^"]*",', "")).when(k % 5 == 4, F.lit("no json")).otherwise(F.col("json"))
    got = wire.parsed_requests(raw.select("c_custkey", body.alias("json")))
    return got.select("c_custkey", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"), "schema_ok", "session_id")


@query("SELECT c_custkey, 'buy for ⟦NAME_' || c_custkey || '⟧' AS goal, least(8, c_custkey % 12 + 1) AS n_history FROM customer")
def read_requests(spark, sf_dir):
    """Requests written as JSON files and read by their schema."""
    path = _new_folder(spark)
    _requests_built(spark, sf_dir).select("r.*").write.json(path)
    return wire.read_requests(spark, path, lines=True).select(F.substring("session_id", 2, 20).cast("long").alias("c_custkey"), "goal", F.size("history").cast("long").alias("n_history"))


@query("""SELECT * FROM (VALUES ('none', 'http://localhost:8000', false, 0), ('stored', 'https://p.example', false, 1), ('patched', 'https://p.example', true, 1)) t("case", server, paranoid, n_terms)""")
def settings_overlay(spark, sf_dir):
    """Defaults, stored settings over them, and a patch over these."""
    stored = {"serverUrl": "https://p.example", "terms": ["Falcon"]}
    rows = [("none", wire.read_settings(None)), ("stored", wire.read_settings(stored)), ("patched", wire.read_settings(stored, {"paranoid": True}))]
    return spark.createDataFrame([(c, s["serverUrl"], s["paranoid"], len(s["terms"])) for c, s in rows], "case string, server string, paranoid boolean, n_terms int")


# --- streams ---


def _drained(stream: DataFrame, path: str) -> DataFrame:
    """All rows that a stream appends until its source is at its end."""
    spark = stream.sparkSession
    sessions.to_sink(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


@query(f"WITH {_ISLANDS} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS BIGINT) AS step, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) > 2 AS limited, ts FROM g")
def streamed_steps(spark, sf_dir):
    """Steps of a user's sessions counted over a stream of events."""
    out = _drained(sessions.stream_step_limits(_streamed(spark, sf_dir, "events"), "user_id", "ts", most=2), _new_folder(spark))
    return out.select(F.col("key").cast("long").alias("user_id"), "step", "limited", F.col("ts").cast("timestamp_ntz").alias("ts"))


_DAY = 86_400_000
_SETTLED = f"""e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, ms AS first_ms, ms + {_DAY} AS settled_ms, 1 AS n FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.ms < r.settled_ms THEN r.first_ms ELSE e.ms END, CASE WHEN e.ms < r.settled_ms THEN least(e.ms + {_DAY}, r.first_ms + {7 * _DAY}) ELSE e.ms + {_DAY} END, CASE WHEN e.ms < r.settled_ms THEN r.n + 1 ELSE 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
s AS (SELECT user_id, first_ms, max(settled_ms) AS settled_ms, max(n) AS n FROM r GROUP BY user_id, first_ms)"""


@query(f"WITH RECURSIVE {_SETTLED} SELECT CAST(user_id AS VARCHAR) AS key, first_ms, settled_ms, CAST(n AS BIGINT) AS n FROM s WHERE settled_ms <= (SELECT max(epoch_ms(ts)) FROM events) - 60000")
def streamed_settling(spark, sf_dir):
    """Runs of a user's events that have settled by the end of a stream of them."""
    return _drained(sessions.stream_settled(_streamed(spark, sf_dir, "events"), "user_id", "ts", quiet=_DAY, most=7 * _DAY), _new_folder(spark))


def _kept(stream: DataFrame, path: str, sinks=None, mode: str = "append") -> SparkSession:
    """Runs a stream into folders under a path, one for each sink."""
    spark = stream.sparkSession
    live.started(stream, live.fan_out(spark, sinks or {"out": lambda b: b}, path), f"{path}/state", mode).awaitTermination()
    return spark


_PASSED = "(SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"
_LIFE = 86_400


@query(f"""WITH RECURSIVE c AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'step' END AS kind, event_type = 'purchase' OR value < 12 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS i FROM events),
w AS (SELECT event_id, user_id, i, ts, kind = 'create' AS alive, ts AS last, kind = 'create' AS authorised, 0 AS step FROM c WHERE i = 1
 UNION ALL SELECT c.event_id, c.user_id, c.i, c.ts, c.kind = 'create' OR (o.up AND NOT (c.kind = 'delete' AND c.good)), CASE WHEN c.kind = 'create' OR (o.up AND c.good) THEN c.ts ELSE w.last END, c.kind = 'create' OR (o.up AND c.good), CASE WHEN c.kind = 'step' AND o.up AND c.good THEN w.step + 1 WHEN c.kind = 'create' THEN 0 ELSE w.step END
 FROM w JOIN c ON c.user_id = w.user_id AND c.i = w.i + 1, LATERAL (SELECT w.alive AND c.ts - w.last <= INTERVAL {_LIFE} SECONDS AS up) o)
SELECT w.event_id, authorised, CAST(CASE WHEN authorised AND c.kind = 'step' THEN step ELSE 0 END AS BIGINT) AS step, authorised AND c.kind = 'step' AND step > 2 AS limited FROM w JOIN c USING (event_id) WHERE w.ts <= {_PASSED}""")
def streamed_sessions(spark, sf_dir):
    """Calls of sessions over a stream of events: which find theirs alive and bring its bearer, and which step each is."""
    kind = F.when(F.col("event_type") == "purchase", "create").when(F.col("event_type") == "error", "delete").otherwise("step")
    bearer = F.when((kind == "create") | (F.col("value") < 12), "a").otherwise("b")
    calls = _streamed(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), "ts", kind.alias("kind"), bearer.alias("bearer"))
    path = _new_folder(spark)
    _kept(live.stream_sessions(calls, most=2, ttl_seconds=_LIFE), path)
    return spark.read.parquet(f"{path}/out").select(F.col("id").cast("long").alias("event_id"), "authorised", "step", "limited")


_LIVES = f"g AS (SELECT *, sum(CASE WHEN gap > INTERVAL {_LIFE} SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS gap FROM events))"


@query(f"""WITH {_LIVES}, e AS (SELECT *, event_type IN ('click', 'view') AS presses FROM g)
SELECT event_id, CASE WHEN presses THEN row_number() OVER (PARTITION BY user_id, s, event_type ORDER BY ts, CAST(event_id AS VARCHAR)) > 1 END AS clicked FROM e WHERE ts <= {_PASSED}""")
def streamed_clicks(spark, sf_dir):
    """Which clicks of a session were made before, over a stream of events."""
    asked = _streamed(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("request_id"), "ts", F.col("event_type").isin("click", "view").alias("presses"), F.col("event_type").alias("screen_key"), F.lit(None).cast("string").alias("note"))
    path = _new_folder(spark)
    _kept(live.stream_clicks(asked, ttl_seconds=_LIFE), path)
    return spark.read.parquet(f"{path}/out").select(F.col("id").cast("long").alias("event_id"), "clicked")


@query(f"""WITH {_LIVES}, e AS (SELECT *, value < 6 AS typed, event_type = 'error' AS asks, value > 15 AS lacks, event_id % 3 > 0 AS button, event_id % 2 AS way FROM g),
p AS (SELECT *, NOT asks AND NOT lacks AND button AS presses FROM e),
c AS (SELECT *, presses AND row_number() OVER (PARTITION BY user_id, s, presses, event_type, way ORDER BY ts, CAST(event_id AS VARCHAR)) > 1 AS clicked FROM p)
SELECT event_id, CASE WHEN asks THEN CASE WHEN typed THEN 'type1,' ELSE '' END || 'ask_user4' WHEN clicked AND NOT typed THEN 'done' WHEN presses THEN CASE WHEN typed THEN 'type1,' ELSE '' END || 'click3' || CASE WHEN way = 1 THEN '!' ELSE '' END
 WHEN typed THEN 'type1' WHEN lacks THEN 'ask_user5' ELSE 'done' END AS actions FROM c WHERE ts <= {_PASSED}""")
def streamed_plans(spark, sf_dir):
    """Plans for a stream of requests, one for each event: what a screen holds follows from the event, and the loop guard
    knows the clicks of the session so far."""
    k, none = F.col("event_id"), F.lit(None).cast("string")

    def el(id_, role, label, cls, value, required, disabled=None):
        label = label if isinstance(label, Column) else F.lit(label)
        return F.struct(F.lit(id_).alias("id"), F.lit(role).alias("role"), label.alias("label"), value.alias("value"), F.lit(cls).cast("string").alias("field_class"), F.lit(required).alias("required"), (F.lit(False) if disabled is None else disabled).alias("disabled"))

    name = el(1, "textbox", "Full name", "NAME", F.when(F.col("value") >= 6, F.lit("⟦NAME_1⟧")), False)
    voucher = el(5, "textbox", "Voucher", None, F.when(F.col("value") <= 15, F.lit("x")), True)
    go = el(3, "button", F.when(k % 2 == 1, F.lit("Submit application")).otherwise(F.lit("Continue")), None, none, False, k % 3 == 0)
    screen = F.when(F.col("event_type") == "error", F.array(name, el(4, "password", "PIN", "SECRET", none, True), voucher, go)).otherwise(F.array(name, voucher, go))
    known = F.array(F.struct(F.lit("⟦NAME_1⟧").alias("token"), F.lit("NAME").alias("class")))
    asked = _streamed(spark, sf_dir, "events").select(k.cast("string").alias("request_id"), F.col("user_id").cast("string").alias("session_id"), "ts", F.lit(1).alias("step"), F.struct(F.concat(F.lit("/"), F.col("event_type")).alias("path_template"), screen.alias("elements")).alias("screen"), known.alias("entities"))
    path = _new_folder(spark)
    _kept(planner.stream_plan(asked, ttl_seconds=_LIFE), path)
    told = F.array_join(F.transform("actions", lambda a: F.concat(a["type"], F.coalesce(a["target"].cast("string"), F.lit("")), F.when(a["requires_confirmation"], F.lit("!")).otherwise(F.lit("")))), ",")
    return spark.read.parquet(f"{path}/out").select(F.col("request_id").cast("long").alias("event_id"), told.alias("actions"))


@query("""SELECT user_id, place, event_id, n_seen FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, least(60, count(*) OVER (PARTITION BY user_id)) AS n_seen FROM events) WHERE place <= 60""")
def streamed_ring(spark, sf_dir):
    """The latest 60 events of each user as running state, and from the same batches in a second folder how many rings
    hold."""
    path = _new_folder(spark)
    sizes = lambda b: b.groupBy("key").agg(F.count(F.lit(1)).alias("n_seen"))
    _kept(live.stream_ring(_streamed(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type"), path, {"rings": lambda b: b, "sizes": sizes}, "update")
    rings = live.latest_of(spark.read.parquet(f"{path}/rings")).join(live.latest_of(spark.read.parquet(f"{path}/sizes")), "key")
    return rings.select(F.col("key").cast("long").alias("user_id"), "place", F.col("id").alias("event_id"), "n_seen")


# --- made-up pages ---


@query("""SELECT template, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_truth, count(*) AS n_html FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'parcel' WHEN 1 THEN 'clinic' ELSE 'refund' END AS template, CASE WHEN c_custkey % 3 = 2 THEN 5 ELSE 3 END AS n FROM customer) GROUP BY template""")
def saved_pages(spark, sf_dir):
    """Made-up pages written with their truth and a manifest, and read again."""
    path = _new_folder(spark)
    synth.save_pages(synth.pages(synth.people(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))), path)
    manifest = spark.read.schema("page string, template string, entities long").json(f"{path}/manifest").groupBy("template").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("entities").alias("n_truth"))
    html = spark.read.parquet(f"{path}/pages").where(F.col("html").contains("data-gt")).groupBy("template").agg(F.count(F.lit(1)).alias("n_html"))
    return manifest.join(html, "template")
