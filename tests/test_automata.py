import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import audit, automata, detect

WORDS = ["Asha", "asha", "ASHA", "Rao", "Lake Road", "lake  road", "Straße", "STRASSE", "x", "x1", "!!", "a.b", "é", "É", "ok"]


def texts_of(rng, n):
    return [None, "", " ", *["".join(str(rng.choice(WORDS)) + str(rng.choice([" ", "  ", "\n", ", ", "-", ""])) for _ in range(rng.integers(1, 9))) for _ in range(n)]]


@pytest.mark.parametrize("most", [automata.AUTOMATON_BYTES, 200])
def test_dictionary_spans_equal_a_search_for_each_term(spark, most):
    """One automaton and many; terms of any case, spacing and signs; nulls, empty texts, and texts that repeat."""
    rng = np.random.default_rng(1)
    texts = texts_of(rng, 60)
    terms = ["Asha", "Lake Road", "straße", "x1", "!!", "A.B", "é", "  ", "none here"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item int, text string")
    got = detect.dictionary_spans(frame, spark.createDataFrame([(t, "NAME", f"t{i}", i) for i, t in enumerate(terms)], "term string, cls string, token string, ord int"), most=most)
    want = {}
    for i, t in enumerate(texts):
        found = []
        for term in sorted((x for x in terms if x.strip()), key=lambda x: (-len(x), terms.index(x))):
            pattern = r"(?<![^\W_])" + r"\s+".join(re.escape(p) for p in term.split()) + r"(?![^\W_])"
            for m in re.finditer(pattern, t or "", re.IGNORECASE):
                if all(m.end() <= a or b <= m.start() for a, b, _ in found):
                    found.append((m.start(), m.end(), f"t{terms.index(term)}"))
        want[i] = sorted(found)
    assert {r.item: [(s.start, s.end, s.token) for s in r.dict_spans] for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_of_many_automata_meet_texts_by_words(spark):
    """The same spans as by automata, and no term passes the driver but those without a word."""
    rng = np.random.default_rng(3)
    odd = ["İzmir", "izmir", "ΟΔΟΣ", "οδος x", "a\u0345b", "aιb", "\u0345Asha", "Lake\u00a0Road", "u7@mail.example", "U7@MAIL.example"]
    texts = texts_of(rng, 40) + [f"{a}, {b}" for a in odd for b in odd]
    terms = ["Asha", "Lake Road", "straße", "x1", "!!", "A.B", "é", "  ", "izmir", "οδος", "a\u0345b", "Asha Rao", *[f"u{i}@mail.example" for i in range(30)]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item int, text string")
    told = spark.createDataFrame([(t, "NAME", f"t{i}", i) for i, t in enumerate(terms)], "term string, cls string, token string, ord int")
    of = lambda df: {r.item: [(s.start, s.end, s.token) for s in r.dict_spans] for r in df.collect()}
    joined = detect.dictionary_spans(frame, told, most=200, key="item")
    assert of(joined) == of(detect.dictionary_spans(frame, told))
    assert joined._jdf.queryExecution().toString().count("ArrowEvalPython") <= 5  # analyzed to executed plan: one for all


@pytest.mark.parametrize("most", [automata.AUTOMATON_BYTES, 150])
def test_leaks_equal_a_search_for_each_value(spark, most):
    rng = np.random.default_rng(2)
    vault = [(str(s), f"⟦{c}_{i}⟧", c, v, i) for s in "ab" for i, (c, v) in enumerate([("NAME", "Asha  Rao"), ("PHONE", "+91 98450 12345"), ("CUSTOM", "Straße x"), ("EMAIL", "a.b@c.in"), ("NAME", "ab"), ("CARD", "4111 1111 1111 1111"), ("NAME", "")])]
    pieces = ["asha", "rao", "Asha rao", "98450-1 2345", "984501234", "straße  X", "A.B@C.IN", "4111-1111 11111111", "4111  1111", "xab"]
    texts = [(i, str(rng.choice(list("abc"))), " ".join(rng.choice(pieces, rng.integers(0, 5)))) for i in range(80)] + [(99, None, "asha"), (98, "a", None)]
    v = spark.createDataFrame(vault, "scope string, token string, cls string, value string, n int")
    frame = spark.createDataFrame(texts, "id int, scope string, text string")
    got = {(r.id, r.token) for r in audit.leaked_values(frame, v, most).collect()}
    every = frame.join(v.where("value <> ''").select("scope", "token", F.explode(audit.value_patterns(F.col("cls"), F.col("value"))).alias("p")), "scope").where(F.rlike(F.col("text"), F.col("p.pattern")))
    assert got == {(r.id, r.token) for r in every.select("id", "token").collect()} and len(got) > 40


def test_a_text_is_folded_like_what_it_may_match():
    sought = automata.Sought([{"form": "İzmir", "kind": "text"}, {"form": "ΟΔΟΣ", "kind": "text"}, {"form": "123456", "kind": "digits"}, {"form": "ok", "kind": "word"}])
    assert sought.found("x izmir", None) == [0] and sought.found("οδος", None) == [1] and sought.found("οδοσ", None) == [1]
    assert sought.found("no. 12-34 56", None) == [2] and sought.found("12--3456", None) == [] and sought.found("book ok", None) == [3] and sought.found("book", None) == []


def test_a_hit_meets_the_entries_of_its_scope_alone():
    """One word of many scopes: each text reads the entries of its own."""

    class Read(list):
        n = 0

        def __getitem__(self, i):
            Read.n += 1
            return super().__getitem__(i)

    sought = automata.Sought(Read({"form": "asha", "kind": "text", "scope": f"s{i}"} for i in range(5000)))
    assert [sought.found("Asha, asha", f"s{i}") for i in (0, 4999, 7)] == [[0], [4999], [7]] and sought.found("Asha", "none") == sought.found("Asha", None) == []
    assert Read.n < 100


def leaves(x, path=""):
    if isinstance(x, str):
        yield path, x
    for k, v in x.items() if isinstance(x, dict) else ():
        if k != "image":
            yield from leaves(v, f"{path}.{k}" if path else k)
    for i, v in enumerate(x) if isinstance(x, list) else ():
        yield from leaves(v, f"{path}[{i}]")


def random_json(rng, depth):
    kind = rng.integers(0, 7) if depth else rng.integers(3, 7)
    if kind < 2:
        return {str(rng.choice(["a", "b c", "image", "d.e", "É\"\\"])) + str(i % 2): random_json(rng, depth - 1) for i in range(rng.integers(0, 4))} | ({"image": "no"} if kind else {})
    if kind == 2:
        return [random_json(rng, depth - 1) for _ in range(rng.integers(0, 4))]
    return [str(rng.choice(["x", "", "[{\"", "\\", "é\n"])), 1.5, None, True][kind - 3]


def test_json_leaves_equal_a_walk(spark):
    rng = np.random.default_rng(3)
    deep = "end"
    for i in range(60):
        deep = {"k": deep} if i % 2 else [deep]
    made = [random_json(rng, 5) for _ in range(150)] + [deep, "top", 3, None, [], {}]
    raw = [(i, json.dumps(x, ensure_ascii=bool(i % 2))) for i, x in enumerate(made)]
    bad = [(1000, "{"), (1001, '{"a":1,"a":2}'), (1002, "[" * 3000 + "]" * 3000), (1003, "nothing"), (1004, "[1,]")]
    got = audit.json_leaves(spark.createDataFrame([*raw, *bad, (2000, None), (2001, "")], "id int, json string")).collect()
    assert sorted((r.id, r.path, r.value) for r in got if r.error is None) == sorted((i, p, v) for i, x in enumerate(made) for p, v in leaves(x))
    assert {r.id for r in got if r.error} == {i for i, _ in bad} and all(r.path is None and r.value is None for r in got if r.error)
