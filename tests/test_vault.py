from pyspark.sql import functions as F

from maskwright.operators import vault as V
from maskwright.operators.ranking import numbered


def sightings(spark, rows):
    return spark.createDataFrame([(c, v, "s", None, i) for i, (c, v) in enumerate(rows)], "cls string, value string, source string, valid boolean, ord int")


def tokens(vault):
    return {r.key: r.token for r in vault.collect()}


def test_first_seen_wins_and_classes_count_alone(spark):
    v = V.build_vault(sightings(spark, [("NAME", "Ananya Rao"), ("EMAIL", "A@b.in"), ("NAME", "ananya  rao"), ("NAME", "Ravi"), ("USERNAME", "a@B.in")]))
    assert tokens(v) == {"ananya rao": "⟦NAME_1⟧", "a@b.in": "⟦EMAIL_1⟧", "ravi": "⟦NAME_2⟧"}


def test_secrets_are_not_stored(spark):
    v = V.build_vault(sightings(spark, [("SECRET", "s|Password"), ("FACE", "s|x|face0")]))
    assert {(r.token, r.value, r.key) for r in v.collect()} == {("⟦SECRET_1⟧", "", "SECRET|s|Password"), ("⟦FACE_1⟧", "", "FACE|s|x|face0")}
    assert V.stored(v).count() == 0
    assert {(r["class"], r.group, r.format) for r in V.entities(v).collect()} == {("SECRET", "SECRET", None), ("FACE", "BIOMETRIC", None)}


def test_known_tokens_stay(spark):
    old = V.build_vault(sightings(spark, [("NAME", "Ravi"), ("NAME", "Asha")]))
    new = V.build_vault(sightings(spark, [("NAME", "Zoe"), ("NAME", "ravi"), ("EMAIL", "z@z.in")]), old)
    assert tokens(new) == {"ravi": "⟦NAME_1⟧", "asha": "⟦NAME_2⟧", "zoe": "⟦NAME_3⟧", "z@z.in": "⟦EMAIL_1⟧"}


def test_dictionary_has_words_of_names(spark):
    v = V.build_vault(sightings(spark, [("NAME", "Jo Ananya Rao"), ("PHONE", "9845012345"), ("DOB", "01-01-2000")]))
    assert {r.term for r in V.dictionary(v).collect()} == {"Jo Ananya Rao", "Ananya", "Rao", "01-01-2000"}


def test_rehydrate(spark):
    v = V.build_vault(sightings(spark, [("NAME", "Ravi"), ("SECRET", "s|p")]))
    texts = spark.createDataFrame([(1, "⟦NAME_1⟧ and ⟦NAME_2⟧, ⟦SECRET_1⟧⟦NAME_1⟧"), (2, "none"), (3, None)], "item int, text string")
    assert {r.item: r.rehydrated for r in V.rehydrate(texts, v).collect()} == {1: "Ravi and ⟦NAME_2⟧, ⟦SECRET_1⟧Ravi", 2: "none", 3: None}


def test_save_and_restore(spark, tmp_path):
    v = V.build_vault(sightings(spark, [("NAME", "Ravi")]))
    V.save_vault(v, str(tmp_path / "v"), "2026-01-01 00:00:00")
    assert tokens(V.restore_vault(spark, str(tmp_path / "v"), "2026-01-01 00:15:00")) == {"ravi": "⟦NAME_1⟧"}
    assert V.restore_vault(spark, str(tmp_path / "v"), "2026-01-01 00:15:01").count() == 0
    schema = "key string, token string, cls string, value string, source string, valid boolean, n long, first_ord int"
    assert tokens(V.from_json(V.to_json(v), schema)) == {"ravi": "⟦NAME_1⟧"}


def test_numbering_spans_partitions(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("g"), ((F.col("id") * 37) % 1000).alias("o"))
    got = numbered(rows, "g", ["o"], "n").toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values("o").n.tolist() == list(range(1, len(part) + 1))


def test_running_state(spark, tmp_path):
    from maskwright.streaming import vaults

    for k, rows in enumerate(([("NAME", "Ravi"), ("EMAIL", "a@b.in")], [("NAME", "Asha"), ("NAME", "ravi")])):
        sightings(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("cls string, value string, source string, valid boolean, ord int").parquet(str(tmp_path / "in"))
        vaults.keep_vault(stream, str(tmp_path / "vault"), str(tmp_path / "cp")).awaitTermination()
        assert vaults.vault_version(spark, str(tmp_path / "vault")).count() == (2, 3)[k]
    assert tokens(vaults.vault_version(spark, str(tmp_path / "vault"))) == {"ravi": "⟦NAME_1⟧", "a@b.in": "⟦EMAIL_1⟧", "asha": "⟦NAME_2⟧"}
    assert vaults.vault_version(spark, str(tmp_path / "none")) is None
