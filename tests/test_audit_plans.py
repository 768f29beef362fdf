import json

from pyspark.sql import functions as F

from maskwright.operators import audit as A
from maskwright.plans import api, planner, policy
from maskwright.sources import wire

ELEMENT = "struct<id:int,role:string,label:string,value:string,field_class:string,required:boolean,disabled:boolean>"
REQUEST = f"request_id string, session_id string, step int, screen struct<path_template:string,elements:array<{ELEMENT}>>, entities array<struct<token:string,class:string>>"
BODY = {
    "session_id": "u-17", "vrs_version": "1.3", "goal": "Join the library", "step": 4, "mode": "structure",
    "screen": {
        "origin": "https://library.example", "path_template": "/join/{id}", "title": "Join", "state": {"class": "form", "confidence": 0.6, "src": "heuristic"}, "viewport": [900, 640],
        "elements": [
            {"id": 11, "role": "combobox", "label": "Branch", "bbox": [7, 7, 207, 31], "src": "dom", "options": ["North", "South"]},
            {"id": 12, "role": "textbox", "label": "Member name", "bbox": [7, 41, 407, 65], "src": "dom", "value": "", "field_class": "NAME", "required": True},
            {"id": 13, "role": "textbox", "label": "Aadhaar no", "bbox": [7, 75, 407, 99], "src": "dom", "value": "", "field_class": "AADHAAR"},
            {"id": 14, "role": "button", "label": "Next", "bbox": [7, 120, 87, 150], "src": "dom"},
        ],
        "texts": [{"id": 15, "text": "Welcome", "bbox": [7, 160, 99, 180]}],
    },
    "entities": [{"token": "⟦AADHAAR_3⟧", "class": "AADHAAR", "group": "GOV_ID"}, {"token": "⟦NAME_2⟧", "class": "NAME", "group": "PERSON"}],
    "history": [{"step": 3, "summary": "opened the form"}],
}


def calls(spark, *bodies):
    raw = spark.createDataFrame([(f"r{i}", i, json.dumps(b)) for i, b in enumerate(bodies)], "request_id string, ts int, json string")
    rows = wire.parsed_requests(raw).withColumn("ts", F.timestamp_seconds("ts")).withColumn("authorised", F.lit(True)).withColumn("n_bytes", F.octet_length("json"))
    return {r.request_id: r for r in api.step_calls(rows).collect()}


def changed(path, value):
    out = json.loads(json.dumps(BODY))
    at = out
    *head, last = path.split(".")
    for k in head:
        at = at[int(k)] if k.isdigit() else at[k]
    at[last] = value
    return out


def test_request_gets_its_three_actions(spark):
    r = calls(spark, BODY)["r0"]
    assert r.status == 200 and [(a.type, a.target, a.text, a.requires_confirmation) for a in r.actions] == [("type", 12, "⟦NAME_2⟧", None), ("type", 13, "⟦AADHAAR_3⟧", None), ("click", 14, None, False)]
    assert r.rationale == "Fill Member name, Aadhaar no; then press “Next”."


def test_statuses(spark):
    got = calls(spark, changed("extra", 1), changed("vrs_version", "2.0"), changed("screen.texts", [{"id": 9, "text": "PAN ABCPR1234K", "bbox": [0, 0, 1, 1]}]), changed("mode", "pixel"), changed("goal", "x" * (2 * 1024 * 1024)), changed("screen.elements", None), changed("mode", "other"))
    assert [got[f"r{i}"].status for i in range(7)] == [422, 409, 422, 400, 413, 422, 422]
    assert [(x.path, x["class"]) for x in got["r2"].leaks] == [("screen.texts[0].text", "PAN")]
    assert got["r0"].error == "schema" and got["r2"].error == "raw_pii" and got["r1"].actions is None


def test_step_limit(spark):
    got = calls(spark, *[BODY] * 27)
    assert [got[f"r{i}"].status for i in range(27)] == [200] * 25 + [429] * 2


def plans(spark, *screens, entities=(("⟦NAME_1⟧", "NAME"),)):
    rows = [(f"r{i}", "s", i, ("/f", els), list(entities)) for i, els in enumerate(screens)]
    return {r.request_id: r for r in planner.plan(spark.createDataFrame(rows, REQUEST)).collect()}


def acts(r):
    return [(a.type, a.target) for a in r.actions]


def test_planner_rules(spark):
    name = (1, "textbox", "Full name", "", "NAME", True, False)
    secret = (4, "password", "PIN", "", None, False, False)
    go, submit = (3, "button", "Continue", None, None, False, False), (5, "button", "Submit application", None, None, False, False)
    other = (6, "textbox", "", "", None, True, False)
    off = (7, "textbox", "Name", "", "NAME", True, True)
    got = plans(spark, [name, go], [name, secret, go], [go, submit], [go, submit], [name, other, go], [other], [], [off, go], [name, go])
    assert acts(got["r0"]) == [("type", 1), ("click", 3)]
    assert acts(got["r1"]) == [("type", 1), ("ask_user", 4)]
    assert acts(got["r2"]) == [("click", 5)] and got["r2"].actions[0].requires_confirmation
    assert acts(got["r3"]) == [("done", None)] and got["r3"].done
    assert acts(got["r4"]) == [("type", 1)] and got["r4"].rationale == "Fill Full name; still missing: field."
    assert acts(got["r5"]) == [("ask_user", 6)]
    assert acts(got["r6"]) == [("done", None)] and got["r6"].done
    assert acts(got["r7"]) == [("ask_user", 7)]
    assert acts(got["r8"]) == [("type", 1), ("click", 3)]  # the same screen again, but with something to fill


def test_broken_references(spark):
    rows = spark.createDataFrame([("r", "s", 1, ("/f", []), [("⟦NAME_1⟧", "NAME")])], REQUEST)
    plan = spark.createDataFrame([("r", [("type", 9, "⟦NAME_1⟧ ⟦NAME_2⟧", None, None)])], f"request_id string, actions {planner.ACTIONS}")
    assert [(r.unknown_targets, r.unknown_tokens) for r in planner.broken_references(plan, rows).collect()] == [([9], ["⟦NAME_2⟧"])]


def test_policy(spark):
    vault = spark.createDataFrame([("u", "⟦NAME_1⟧", "NAME"), ("u", "⟦EMAIL_1⟧", "EMAIL"), ("u", "⟦SECRET_1⟧", "SECRET")], "scope string, token string, cls string")
    a, b = "https://a.example", "https://b.example"
    rows = [
        (1, "u", "type", "⟦NAME_1⟧", None, "NAME", "Name", a, [a]), (2, "u", "type", "⟦NAME_1⟧", None, "NAME", "Name", b, [a]), (3, "u", "type", "⟦NAME_7⟧", None, "NAME", "Name", a, [a]), (4, "u", "type", "⟦SECRET_1⟧", None, "SECRET", "PIN", a, [a]),
        (5, "u", "type", "⟦EMAIL_1⟧", None, "NAME", "", a, [a]), (6, "u", "type", "⟦EMAIL_1⟧", None, "USERNAME", "User", a, [a]), (7, "u", "click", None, None, None, "Pay now", a, [a]), (8, "u", "click", None, True, None, "Go", a, [a]),
        (9, "u", "click", None, None, None, "Go", a, [a]), (10, "u", "scroll", None, None, None, None, b, [a]), (11, "u", "type", "plain", None, None, "x", a, [a]), (12, "u", "type", "⟦EMAIL_1⟧ ⟦SECRET_1⟧", None, "NAME", "N", a, [a]),
    ]
    frame = spark.createDataFrame(rows, "id int, scope string, type string, text string, requires_confirmation boolean, field_class string, label string, origin string, allowed_origins array<string>")
    got = {r.id: (r.verdict, r.reason) for r in policy.decide(frame, vault).collect()}
    assert [got[i][0] for i in range(1, 13)] == ["allow", "confirm", "deny", "deny", "confirm", "allow", "confirm", "confirm", "allow", "allow", "allow", "confirm"]
    assert got[3][1] == "⟦NAME_7⟧ is not a known placeholder." and got[5][1] == "Type ⟦EMAIL_1⟧ (EMAIL) into “unlabelled field”?"


def test_firewall(spark):
    phone, name = ("PHONE", "+91 98450 12345"), ("NAME", "Ananya Rao")
    cases = [
        # text, values in the vault, what differs from a plain request, checks that fail
        ("hello ⟦PHONE_1⟧", [phone, name], {}, []),
        ("call 98450-12345", [phone], {}, ["Vault match", "Pattern re-scan"]),
        ("9 8 4 5 0 1 2 3 4 5", [phone], {}, ["Vault match"]),
        ("dear ANANYA", [name], {}, ["Vault match"]),
        ("ananyas", [name], {}, []),
        ("PAN ABCPR1234K", [], {}, ["Pattern re-scan"]),
        ("12345", [phone], {"goal": "98450"}, ["Vault match"]),  # across fields
        ("x", [], {"mode": "pixel", "image": True, "integrity": False}, ["Mask integrity"]),
        ("x", [], {"mode": "pixel"}, ["Mask integrity"]),
        ("x", [], {"image": True}, ["No image in structure mode"]),
        ("x", [], {"audited": True}, ["OCR audit"]),
        ("x", [name], {"audit": ["Rao"], "audited": True}, ["OCR audit"]),
        ("x", [name], {"audit": ["fine"], "audited": True}, []),
        ("x", [], {"dest": "https://q.example/v1"}, ["Destination"]),
        ("x", [], {"integrity": None, "mode": "pixel", "image": True}, ["Mask integrity"]),  # a null verdict is never ok
    ]
    plain = {"goal": "g", "mode": "structure", "image": False, "integrity": True, "audit": None, "audited": False, "dest": "https://p.example/v1"}
    rows, entries = [], []
    for i, (text, values, more, _) in enumerate(cases):
        c = plain | more
        rows.append((i, str(i), (c["goal"], ([(text,)], "9845012345")), c["dest"], "https://p.example", c["mode"], c["image"], c["integrity"], c["audit"], c["audited"]))
        entries += [(str(i), f"⟦{k}_{n}⟧", k, v, n) for n, (k, v) in enumerate(values, 1)]
    schema = "id int, scope string, payload struct<goal:string,screen:struct<texts:array<struct<text:string>>,image:string>>, dest string, server_url string, mode string, has_image boolean, integrity boolean, audit array<string>, audited boolean"
    vault = spark.createDataFrame(entries, "scope string, token string, cls string, value string, n int")
    got = {r.id: r for r in A.firewall(spark.createDataFrame(rows, schema), vault).collect()}
    for i, (*_, failed) in enumerate(cases):
        assert [c.name for c in got[i].checks if not c.ok] == failed, cases[i]
        assert got[i].ok == (not failed)


def test_guard_reads_digits_of_all_scripts(spark):
    of = lambda t: spark.createDataFrame([(t,)], "t string").select(A.guard_class(F.col("t")).alias("c")).first().c
    assert of("⟦PAN_1⟧ ok") is None and of("a@b.in 4111 1111 1111 1111") == "EMAIL" and of("4111 1111 1111 111१") == "CARD" and of(None) is None


def test_json_leaves(spark):
    raw = spark.createDataFrame([(1, '{"a":["x",{"image":"no","b":"y"}],"n":1}'), (2, None)], "id int, json string")
    assert [(r.path, r.value) for r in A.json_leaves(raw).collect()] == [("a[0]", "x"), ("a[1].b", "y")]


def test_sessions_and_bearers(spark):
    rows = [("c1", "s", 0, "create", None), ("c2", "s", 60, "step", "T"), ("c3", "s", 120, "step", "bad"), ("c4", "s", 960, "step", "T"), ("c5", "s", 1861, "step", "T"), ("c6", "s", 1862, "step", "T"), ("d1", "t", 0, "create", None), ("d2", "t", 1, "delete", "T"), ("d3", "t", 2, "step", "T"), ("e1", "u", 5, "step", "T")]
    frame = spark.createDataFrame(rows, "call_id string, session_id string, sec int, kind string, bearer string").withColumn("ts", F.timestamp_seconds("sec")).withColumn("session_token", F.lit("T"))
    assert {r.call_id: r.authorised for r in api.live_sessions(frame).collect()} == {"c1": True, "c2": True, "c3": False, "c4": True, "c5": False, "c6": False, "d1": True, "d2": True, "d3": False, "e1": False}


def test_guard_reads_digits_of_all_scripts(spark):
    card = "4111111111111111"
    maths, devanagari = "".join(chr(0x1D7CE + int(c)) for c in card), "".join(chr(0x966 + int(c)) for c in card)
    rows = spark.createDataFrame([(f"pay {maths} now",), (devanagari,), (f"pay {maths[:-1]}2",), ("nothing",)], "t string")
    assert [r.c for r in rows.select(A.guard_class(F.col("t")).alias("c")).collect()] == ["CARD", "CARD", None, None]


def test_json_that_cannot_be_read(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = spark.createDataFrame([(1, '{"a": ["x", {"image": "no", "b": "y"}]}'), (2, "{"), (3, None), (4, deep)], "id int, json string")
    got = A.json_leaves(rows).collect()
    assert [(r.id, r.path, r.value) for r in got if r.error is None] == [(1, "a[0]", "x"), (1, "a[1].b", "y")]
    assert {r.id for r in got if r.error is not None} == {2, 4} and all(r.path is None for r in got if r.error)


def test_leaked_values_meet_by_grams(spark):
    vault = [("a", "⟦NAME_1⟧", "NAME", "Asha  Rao", 1), ("a", "⟦PHONE_1⟧", "PHONE", "+91 98450 12345", 2), ("a", "⟦CUSTOM_1⟧", "CUSTOM", "Straße x", 3), ("b", "⟦NAME_9⟧", "NAME", "Asha Rao", 1), ("a", "⟦NAME_3⟧", "NAME", "ab", 4)]
    texts = [(1, "a", "x ASHA\n rao y"), (2, "a", "tel 9845-0 1234 5!"), (3, "a", "a sha"), (4, "b", "98450 12345 asha rao"), (5, "a", "STRASSE x straße\tX"), (6, "a", None), (7, "a", "sub98450123456"), (8, "c", "Asha Rao")]
    v = spark.createDataFrame(vault, "scope string, token string, cls string, value string, n int")
    got = {(r.id, r.token) for r in A.leaked_values(spark.createDataFrame(texts, "id int, scope string, text string"), v).collect()}
    assert got == {(1, "⟦NAME_1⟧"), (2, "⟦PHONE_1⟧"), (4, "⟦NAME_9⟧"), (5, "⟦CUSTOM_1⟧"), (7, "⟦PHONE_1⟧")}


def test_created_sessions(spark):
    rows = spark.createDataFrame([(1, "1.0"), (2, "1.9"), (3, "2.0"), (4, None)], "call_id int, vrs_version string")
    got = {r.call_id: r for r in api.created_sessions(rows).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == [200, 200, 409, 409] and got[3].session_id is None and got[1].max_steps == 25
    assert got[1].session_id != got[2].session_id and got[1].token != got[2].token and len(got[1].token) == 64
    salted = [sorted(map(tuple, api.created_sessions(rows, "s").collect())) for _ in range(2)]
    assert salted[0] == salted[1]
