from conftest import plan, rows
from pyspark.sql import functions as F

from starmill.operators import cleanse as K


def test_newest_per_key_keeps_all_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "old", 1), (1, "new", 2), (None, "x", 1), (None, "y", 1), (2, "only", 5)],
        "k int, v string, _ingestion_ts int",
    )
    got = K.newest_per_key(df, ["k"])
    assert rows(got, "v") == [("new",), ("only",), ("x",), ("y",)]


def test_ties_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([(1, c, 1) for c in "dacb"], "k int, v string, _ingestion_ts int")
    picks = {
        tuple(rows(K.newest_per_key(df.orderBy(F.rand(seed)).repartition(3), ["k"]))) for seed in range(4)
    }
    assert len(picks) == 1
    assert rows(K.newest_per_key(df, ["k"], ties=["v"]), "v") == [("a",)]


def test_a_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS _ingestion_ts")
    text = plan(K.newest_per_key(df, ["k"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_trim_drop_flags(spark):
    df = spark.createDataFrame(
        [(1, " a ", "Y", None, ""), (2, "b", "N", None, None), (3, None, "yes", None, "")],
        "id int, t string, f string, e int, s string",
    )
    assert rows(K.trim_text(df), "t") == [("a",), ("b",), (None,)]
    assert K.empty_columns(df) == ["e", "s"]
    assert K.empty_columns(df.where("false")) == []
    assert K.drop_columns(df, ["e", "zz"]).columns == ["id", "t", "f", "s"]
    flags = K.text_flags_to_boolean(df, ["f", "zz"])
    assert rows(flags, "id", "f") == [(1, True), (2, False), (3, None)]
    wider = K.text_flags_to_boolean(df, ["f"], {"Y": True, "yes": True, "N": False})
    assert rows(wider, "id", "f") == [(1, True), (2, False), (3, True)]


def test_load_columns(spark):
    df = K.with_load_columns(spark.range(2), F.lit("2024-01-01").cast("timestamp"), "b7")
    assert df.columns == ["id", "_ingestion_ts", "_batch_id", "_source_layer"]
    assert rows(df, "_batch_id", "_source_layer") == [("b7", "raw")] * 2


def test_dedupe_and_upsert_scan_their_input_once(spark, tmp_path):
    from starmill.operators.merge import upsert

    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 8)], "k int, v int").write.parquet(path)
    df = spark.read.parquet(path)
    newest = K.newest_per_key(df, ["k"], ["v"])
    assert plan(newest).count("FileScan") == 1 and "WindowGroupLimit" in plan(newest)
    assert rows(newest) == [(1, 6), (None, 7), (None, 8)]
    source = spark.createDataFrame([(1, 9)], "k int, v int")
    merged = upsert(newest, source, ["k"], check=False)
    assert plan(merged).count("FileScan") == 1
    assert rows(merged) == [(1, 9), (None, 7), (None, 8)]


def test_rows_without_key_stay_and_maps_do_not_matter(spark):
    df = spark.sql("SELECT 1 AS k, 1 AS _ingestion_ts, map('a', 'b') AS m UNION ALL SELECT 1, 1, map('a', 'c')")
    assert K.newest_per_key(df, ["k"]).count() == 1
