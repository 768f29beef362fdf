"""What the fits of operators 2 and 3 learn from, and how much of it comes to the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import contamination, language, toxicity

DOCS = "doc_id long, text string, lang string, source string"
GERMAN = "der Hund und die Katze gehen über die alte Straße und schlafen nicht"
ENGLISH = "the dog and the cat walk over the old road and do not sleep"


@pytest.fixture()
def seen(monkeypatch):
    """What the driver fits."""
    got = {}
    whole, weighed = language.fitted, toxicity._logistic
    monkeypatch.setattr(language, "fitted", lambda x, langs: got.update(langs=langs) or whole(x, langs))
    monkeypatch.setattr(toxicity, "_logistic", lambda rows, y, *a: got.update(y=y) or weighed(rows, y, *a))
    return got


def test_language_learns_labelled_rows_only(spark, seen):
    """One doc_id with a German row, thousands of English ones without a lang, and two langs for the same text."""
    rows = [(7, GERMAN, "de", "s"), *[(7, f"{ENGLISH} {i}", None, "s") for i in range(3000)], *[(i + 100, f"{ENGLISH} {i}", "en", "s") for i in range(30)], (7, ENGLISH, "en", "s"), (7, ENGLISH, "xx", "s"), (8, "123", "de", "s"), (9, None, "de", "s"), (None, GERMAN, "de", "s")]
    model = language.fit(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert sorted(seen["langs"]) == ["de"] + ["en"] * 31 + ["xx"] and model.langs == ["de", "en", "xx"]


@pytest.mark.parametrize("same", [True, False])
def test_language_rows_of_one_id_are_bounded(spark, seen, same):
    rows = [(7, GERMAN if same else f"{GERMAN} {i}", "de", "s") for i in range(3000)] + [(i, f"{ENGLISH} {i}", "en", "s") for i in range(40)]
    language.fit(spark.createDataFrame(rows, DOCS).repartition(5), F.lit(True), per_lang=50)
    assert seen["langs"].count("de") == (1 if same else 50) and seen["langs"].count("en") == 40
    language.fit(spark.createDataFrame(rows, DOCS), F.lit(True), rows_in_all=20)
    assert len(seen["langs"]) == (11 if same else 20)


def test_language_bounds_langs(spark, seen):
    rows = [(i, f"{ENGLISH} {i}", f"l{i % 40}", "s") for i in range(200)] + [(i, f"{GERMAN} {i}", "de", "s") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, DOCS), F.lit(True), most_langs=3)
    assert len(model.langs) == 3 and "de" in model.langs


@pytest.mark.parametrize("same", [True, False])
def test_toxicity_rows_of_one_id_are_bounded(spark, seen, same):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(rng.choice(["good", "day", "sun", "tree", "river", "stone"], n))
    bad = lambda: f"you rotten scoundrel {words(3)}"
    rows = [(i, bad() if i % 3 == 0 else words(6), "en", "s") for i in range(60)] + [(1000, "again" if same else f"{words(4)} n{i}", "en", "s") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1000, 0), (1000, 1), (1000, None), (None, 1)], "doc_id long, toxic int")
    held = spark.createDataFrame(rows, DOCS).select("doc_id").distinct().where(~language.held_out(F.col("doc_id"), 5, 0)).count()
    toxicity.fit(spark.createDataFrame(rows, DOCS), labels, train_rows=100)
    assert len(seen["y"]) <= (held if same else 100)
    toxicity.fit(spark.createDataFrame(rows, DOCS), labels, train_rows=20)
    assert len(seen["y"]) <= 20


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "decimal(12,2)", "date", "string", "double"])
@pytest.mark.parametrize("broadcast", [1000, 0])
def test_benchmark_items_of_any_id(spark, kind, broadcast):
    items = spark.createDataFrame([(i, f"{ENGLISH} number {i} of them") for i in range(1, 5)], "i int, text string")
    ids = F.expr(f"date_add(date'2026-01-01', i)" if kind == "date" else f"cast(i as {kind})").alias("item_id")
    docs = spark.createDataFrame([(i, f"Some words before. {ENGLISH} number {i} of them and after.") for i in range(1, 9)], "doc_id int, text string")
    got = contamination.contained(docs, items.select(ids, "text"), broadcast=broadcast)
    assert dict(got.dtypes)["item_id"] == kind
    want = {(r.doc_id, r.item_id) for r in docs.join(items.select(F.col("i").alias("doc_id"), ids), "doc_id").collect()}
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()}
