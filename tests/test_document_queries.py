"""Queries over documents that hold more classes than their SQL names, against that SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "mail ann@mail.example or call 9876543210, then Ann@mail.example", "Aadhaar 4821 6630 1979 and card 4111-1111-1111-1111", "call +91 98450 12345 only", "PAN ABCPR1234K, HDFC0000123, pay@okaxis", None, "",
    "a4111111111111111@mail.example writes", "x 4111 1111 1111 1111, bob@mail.example, 4111-1111-1111-1111, 4111 1111 1111 1111", "zz@a.example z@a.example 5500 0000 0000 0004",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("documents"))
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def differs(spark, tables, name):
    """Rows that only one side has."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
    told = con.execute(entry.oracle_sql()[name])
    want = sorted(map(repr, told.fetchall()))
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, tables).select(*[c[0] for c in told.description]).collect())
    assert want
    return [x for x in got if x not in want] + [x for x in want if x not in got] + [len(got) - len(want)] * (len(got) != len(want))


def test_class_counts(spark, tables):
    assert not differs(spark, tables, "class_counts")


def test_redact_documents(spark, tables):
    assert not differs(spark, tables, "redact_documents")


def test_leak_scan(spark, tables):
    assert not differs(spark, tables, "leak_scan")


def test_vault_entities(spark, tables):
    assert not differs(spark, tables, "vault_entities")


def test_rehydrate_tokens(spark, tables):
    assert not differs(spark, tables, "rehydrate_tokens")


def test_vault_tokens_per_doc(spark, tables):
    assert not differs(spark, tables, "vault_tokens_per_doc")
