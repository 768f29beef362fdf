import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import fixed as X
from maskwright.operators import detect as D


def spans(spark, text, f=D.detect_patterns):
    return [(s.cls, s.value, s.valid, s.start, s.end) for s in spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("s")).first().s]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail ananya.rao@mail.in now", [("EMAIL", None)]), ("Aadhaar 4821 6630 1979", [("AADHAAR", True)]), ("PAN ABCPR1234K", [("PAN", None)]), ("Card 4111 1111 1111 1111", [("CARD", True)]), ("IFSC HDFC0001234", [("IFSC", None)]),
        ("Pay ananya@okaxis", [("UPI", None)]), ("Call +91 98450 12345", [("PHONE", None)]), ("Order 482166301978", []), ("Total 1,250.00 on 12/08/2024", []), ("Ref 4111111111111112", []), ("UID 4821 6630 1978", [("AADHAAR", False)]),
        ("éABCPR1234K", [("PAN", None)]), ("", []), (None, []),
    ],
)
def test_patterns(spark, text, want):
    found = spans(spark, text)
    assert [(c, v) for c, _, v, _, _ in found] == want
    assert all(text[a:b] == v for _, v, _, a, b in found)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Name: Ananya Rao", ["NAME"]), ("Account number: 12345678901. IFSC: HDFC0ABC123", ["ACCOUNT", "IFSC"]), ("Address: 14, 3rd Cross, Jayanagar, Mobile: +91 98450 12345", ["ADDRESS", "PHONE"]),
        ("Email: a.b@mail.in", ["EMAIL"]), ("Account holder: Ananya Rao", ["NAME"]), ("Status: Active. Plan: Plus", []),
    ],
)
def test_labelled_values(spark, text, want):
    assert [s[0] for s in spans(spark, text, lambda t: D.merged(D.detect_patterns(t), D.label_values(t)))] == want


def test_context_only_where_nothing_else(spark):
    of = lambda t, c: spans(spark, t, lambda x: D.block_spans(x, F.lit(c)))
    assert of("  Ananya Rao ", "NAME") == [("NAME", "Ananya Rao", None, 2, 12)]
    assert [s[0] for s in of("a@b.in", "NAME")] == ["EMAIL"]
    assert of("   ", "NAME") == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["ab@cd.in", "ABCPR1234K", "x", " ", "98450 12345", "4111111111111111", ".", "😀", "\n", "é"]), max_size=14))
def test_offsets_equal_a_plain_scan(spark, parts):
    text = "".join(parts)
    for cls in ("EMAIL", "PAN", "PHONE"):
        want = [(m[0], m.start()) for m in re.finditer(X.DETECTORS[cls], text)]
        got = spark.createDataFrame([(text,)], "t string").select(D.matches(F.col("t"), F.lit(X.DETECTORS[cls])).alias("m")).first().m
        assert [(m.value, m.start) for m in got] == want


def test_dictionary(spark):
    texts = spark.createDataFrame([(1, "Hello Ananya  rao, and ANANYA"), (2, "Ananyas"), (3, ""), (4, None)], "item int, text string")
    terms = spark.createDataFrame([("Ananya Rao", "NAME", "⟦NAME_1⟧"), ("Ananya", "NAME", "⟦NAME_1⟧")], "term string, cls string, token string")
    got = {r.item: [(s.value, s.start) for s in r.dict_spans] for r in D.dictionary_spans(texts, terms).collect()}
    assert got == {1: [("Ananya  rao", 6), ("ANANYA", 23)], 2: [], 3: [], 4: []}


def test_redact(spark):
    docs = spark.createDataFrame([("to ab@cd.in, call 98450 12345.",), (None,)], "text string")
    assert [r.redacted for r in D.redact(docs).collect()] == ["to ⟦EMAIL⟧, call ⟦PHONE⟧.", None]


def test_clean_terms(spark):
    assert spark.createDataFrame([(" Acme , ab,Acme\nZeta ",)], "t string").select(D.clean_terms(F.col("t")).alias("v")).first().v == ["Acme", "Zeta"]


def test_spans_from_sql(spark):
    from maskwright.functions.udtf import pii_spans

    spark.createDataFrame([(1, "to ab@cd.in"), (2, None)], "id int, text string").createOrReplaceTempView("mails")
    assert [(r.id, r.cls, r.value, r.start) for r in pii_spans(spark, "mails", "id").collect()] == [(1, "EMAIL", "ab@cd.in", 3)]


def test_long_runs_are_read_once(spark):
    import time

    began = time.time()
    assert spans(spark, "x" * 300_000 + " @ " + "y" * 300_000 + "@cd.in", lambda t: D.pattern_spans(t, "EMAIL"))[0][3] == 300_003
    assert time.time() - began < 30


def test_terms_of_signs_only_and_the_order_of_terms(spark):
    texts = spark.createDataFrame([(1, "pay $$$ now, Falcon-9 FALCON 9"), (2, None), (3, "$ $$ falcon")], "item int, text string")
    terms = spark.createDataFrame([("$$$", "CUSTOM", "⟦C_1⟧", 3), ("Falcon", "CUSTOM", "⟦C_2⟧", 2), ("falcon", "NAME", "⟦N_1⟧", 1), ("Falcon 9", "CUSTOM", "⟦C_3⟧", 4)], "term string, cls string, token string, ord int")
    got = {r.item: [(s.value, s.token) for s in r.dict_spans] for r in D.dictionary_spans(texts, terms).collect()}
    assert got == {1: [("$$$", "⟦C_1⟧"), ("Falcon", "⟦N_1⟧"), ("FALCON 9", "⟦C_3⟧")], 2: [], 3: [("falcon", "⟦N_1⟧")]}


def test_redacting_only_what_changes(spark):
    docs = spark.createDataFrame([(1, "to a.b@mail.in"), (2, "Order 482166301978"), (3, None)], "id int, text string")
    assert [(r.id, r.redacted) for r in D.redact(docs, changed_only=True).collect()] == [(1, "to ⟦EMAIL⟧")]
    plan = D.redact(docs, changed_only=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == D.redact(docs)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_what_may_hold_a_span(spark):
    """No detector finds anything where the fast search finds nothing."""
    shown = ["a@b.co", "4-1-1-1 1-1-1-1 1-1-1-1 1-1-1-1", "2345 6789 0124", "ABCPD1234K", "HDFC0ABCDEF", "x.y@okaxis", "91 98765-43210", "no 12 3", "ABCD1"]
    rows = spark.createDataFrame([(i, f"see {t}.") for i, t in enumerate(shown)], "id int, text string")
    got = rows.select(D.may_hold(F.col("text")).alias("may"), F.size(D.merged(*[D.pattern_spans(F.col("text"), c) for c in D.X.DETECTORS])).alias("n"), F.size(D.detect_patterns(F.col("text"))).alias("own")).collect()
    assert all(r.n == r.own and (r.may or not r.n) for r in got) and [r.may for r in got] == [True] * 7 + [False] * 2 and sum(r.n > 0 for r in got) >= 6
