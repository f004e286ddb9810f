import threading
from datetime import datetime

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from starmill.functions.columns import common_type
from starmill.operators import runlog as L
from starmill.operators.merge import delete_from_table, delete_where_equal, upsert, upsert_table
from starmill.operators.products import Products
from starmill.sources import files
from starmill.sources.lake import ConcurrentLoad, Lake


def test_overwrite_may_read_its_own_table_and_change_schema(spark, lake):
    lake.overwrite(spark.range(10), "silver", "t")
    lake.overwrite(lake.read("silver", "t").selectExpr("id", "id % 2 AS p"), "silver", "t", ["p"])
    assert lake.read("silver", "t").where("p = 1").count() == 5
    assert lake.tables("silver") == ["t"] and lake.exists("silver", "t") and not lake.exists("gold", "t")
    with pytest.raises(LookupError):
        lake.read("gold", "t")


def test_an_incomplete_load_is_not_seen(spark, lake, tmp_path):
    lake.overwrite(spark.range(3), "silver", "t")
    (tmp_path / "lake/silver/t/v=000002").mkdir()
    assert lake.read("silver", "t").count() == 3
    lake.overwrite(spark.range(4), "silver", "t")
    assert lake.read("silver", "t").count() == 4


def test_append_widens(spark, lake):
    lake.append(spark.createDataFrame([(1,)], "a int"), "gold", "log")
    lake.append(spark.createDataFrame([(2, "x")], "a int, b string"), "gold", "log")
    assert rows(lake.read("gold", "log", merge_schema=True)) == [(1, None), (2, "x")]


def test_layer_and_row_counts(spark, lake):
    lake.overwrite(spark.range(3), "bronze", "a")
    lake.overwrite(spark.range(4), "bronze", "b")
    assert rows(lake.layer_counts(("bronze", "gold"))) == [("bronze", 2, 7), ("gold", 0, 0)]
    assert rows(lake.row_counts("bronze")) == [("a", 3), ("b", 4)]


def test_sources(spark, tmp_path):
    folder = str(tmp_path)
    files.write_csv(spark.createDataFrame([(1, "é, x")], "a int, b string"), f"{folder}/raw_things.csv")
    (tmp_path / "plain.csv").write_text("k,when\n5,2024-01-02 03:04:05\n")
    (tmp_path / "notes.txt").write_text("no")
    assert files.discover_sources(spark, folder) == {"plain": "plain.csv", "things": "raw_things.csv"}
    assert files.discover_sources(spark, folder + "/nowhere") == {}
    inferred = files.load_csv(spark, f"{folder}/plain.csv")
    assert inferred.dtypes == [("k", "int"), ("when", "timestamp")]
    typed = files.load_csv(spark, f"{folder}/raw_things.csv", "b string, a int")
    assert rows(typed) == [(1, "é, x", None, None)]  # bound by the header's names


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([("B", 2), ("C", 3), ("N", None)], "v string, k int")
    assert rows(upsert(target, source, ["k"])) == [(1, "a"), (2, "B"), (3, "C"), (None, "N"), (None, "n")]
    assert upsert(None, source, ["k"]).count() == 3
    with pytest.raises(ValueError):
        upsert(target, source.union(source), ["k"])


def test_delete(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "k int, v string")
    assert rows(delete_where_equal(df, v="a")) == [(2, "b")]
    assert rows(delete_where_equal(df, v="a", k=1)) == [(2, "b"), (None, "a")]
    assert delete_where_equal(df).count() == 0


def test_stored_tables_can_be_upserted_and_emptied(spark, lake):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    upsert_table(lake, first, "gold", "cache", ["k"])
    upsert_table(lake, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), "gold", "cache", ["k"])
    assert rows(lake.read("gold", "cache")) == [(1, "a"), (2, "B"), (3, "c")]
    delete_from_table(lake, "gold", "cache", k=2)
    assert rows(lake.read("gold", "cache")) == [(1, "a"), (3, "c")]
    delete_from_table(lake, "gold", "cache")
    assert lake.read("gold", "cache").count() == 0 and lake.exists("gold", "cache")


# ------------------------------------------------------------------ logs

LOG = [("r1", "f1", "ok", 1), ("r2", "f1", "bad", 3), ("r3", "f2", "ok", 2), ("r4", "f1", "ok", 3)]


def log(spark):
    rows_ = [(r, f, s, datetime(2024, 1, d)) for r, f, s, d in LOG]
    return spark.createDataFrame(rows_, "run string, fp string, status string, ts timestamp")


def test_log_reads(spark):
    df = log(spark)
    assert [r["run"] for r in L.newest(df, "ts", 2, ["run"]).collect()] == ["r2", "r4"]
    assert [r["run"] for r in L.newest(df, "ts", 9, ["run"], fp="f1", status="ok").collect()] == ["r4", "r1"]
    assert rows(L.latest_per_key(df, ["fp"], "ts", ["run"]), "run") == [("r2",), ("r3",)]
    assert rows(L.latest_set(df, "fp", "ts"), "run") == [("r1",), ("r2",), ("r4",)]
    assert L.latest_set(df.where("false"), "fp", "ts").count() == 0
    assert L.exists_any(df, fp="f2", status="ok") and not L.exists_any(df, fp="f2", status="bad")
    keys = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "fp string")
    assert rows(L.exists_for(keys, df, ["fp"], status="bad")) == [("f1", True), ("f2", False), ("f3", False)]


def test_log_search_and_decisions(spark):
    df = log(spark)
    hits = L.search(df, "ts", "2024-01-02", "2024-01-03", {"status": ["ok"]}, "F1", ["fp"])
    assert rows(hits, "run") == [("r4",)]
    assert L.search(df, "ts", "2024-01-01", "2024-01-03").count() == 4
    text = spark.createDataFrame([("REJECTED: no",), ("fine",), (None,)], "t string")
    assert rows(text.select(L.decision_from_text("t"))) == [("approved",), ("approved",), ("rejected",)]
    assert rows(L.run_status(df, ["fp"], F.col("status") == "bad"), "fp", "run_status") == [
        ("f1", "failed"), ("f2", "succeeded")]


# ------------------------------------------------------------------ products


def test_products(spark, lake):
    lake.overwrite(spark.range(6).selectExpr("id", "id % 2 AS g"), "gold", "facts_x")
    products = Products(lake)
    built = products.build({"id": "by_g", "sql": "SELECT g, count(*) AS n FROM facts_x GROUP BY g;"})
    assert (built["status"], built["object_kind"], built["row_count"]) == ("built", "VIEW", 2)
    stored = products.build({"id": "copy", "sql": "SELECT * FROM facts_x", "product_type": " Table "})
    assert (stored["object_kind"], stored["row_count"], stored["target"]) == ("TABLE", 6, "products.copy")
    assert products.build({"id": "x"})["status"] == "failed"
    for sql in ("SELECT nope FROM facts_x", "SELEC 1", "SELECT 1/(id - id) AS x FROM facts_x"):
        failed = products.build({"id": "bad", "sql": sql, "product_type": "table"})
        assert failed["status"] == "failed" and failed["error"]
    assert rows(products.listing()) == [("by_g", 2), ("copy", 6)]
    assert rows(Products(lake).listing()) == [("by_g", 2), ("copy", 6)]  # views are stored
    assert products.build({"id": "bad", "sql": "DROP VIEW facts_x"})["status"] == "failed"
    lake.overwrite(spark.range(3).selectExpr("id", "id AS g"), "gold", "facts_x")
    assert rows(Products(lake).frame("by_g")) == [(0, 1), (1, 1), (2, 1)]  # today's gold


def test_csv_keeps_what_does_not_convert(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name,id,price\nbob,1,2.5\nann,two,abc\nshort,3\n")
    df = files.load_csv(spark, str(tmp_path / "x.csv"), "id int, name string, price double, gone int")
    assert df.columns == ["name", "id", "price", files.MALFORMED, files.UNCONVERTED]
    assert rows(df) == [
        ("ann", None, None, None, {"id": "two", "price": "abc"}),
        ("bob", 1, 2.5, None, None),
        ("short", 3, None, "short,3", None),
    ]


def test_partitioned_tables_keep_layout_and_types(spark, lake):
    df = spark.createDataFrame([("01", 1), ("02", 2)], "kind string, v int")
    lake.overwrite(df, "gold", "parted", ["kind"])
    lake.append(spark.createDataFrame([("03", 3, "n")], "kind string, v long, note string"), "gold", "parted")
    assert rows(lake.read("gold", "parted")) == [("01", 1, None), ("02", 2, None), ("03", 3, "n")]
    assert dict(lake.read("gold", "parted").dtypes) == {"kind": "string", "v": "bigint", "note": "string"}
    upsert_table(lake, spark.createDataFrame([("02", 9, "u")], "kind string, v long, note string"),
                       "gold", "parted", ["kind"])
    assert lake.partition_columns("gold", "parted") == ["kind"]
    assert rows(lake.read("gold", "parted"))[1] == ("02", 9, "u")
    with pytest.raises(TypeError):
        lake.append(spark.createDataFrame([("x", "y")], "kind string, v string"), "gold", "parted")


def test_load_numbers_and_retention(spark, lake):
    for n in range(4):
        lake.overwrite(spark.range(n), "gold", "t")
    gone = lake.keep_last("gold", "t", 2)
    assert [p[-1] for p in gone] == ["1", "2"] and lake.read("gold", "t").count() == 3
    assert lake.overwrite(spark.range(7), "gold", "t").endswith("v=000005")


def test_typed_logs(spark, lake):
    L.write_log(lake, "decisions", [])
    L.write_log(lake, "decisions", [{"dataset_name": "d", "anomalous_fields": ["a"]}])
    assert lake.read("gold", "decisions").first().anomalous_fields == ["a"]
    with pytest.raises(ValueError):
        L.write_log(lake, "compile_audit", [{"nothing": 1}])


# ------------------------------------------------------------------ commit log


def folders(tmp_path, table="gold/t"):
    return sorted(p.name for p in (tmp_path / "lake" / table).iterdir() if p.name.startswith("_load="))


def test_of_two_writers_one_fails_and_both_layouts_stay(spark, lake, tmp_path, monkeypatch):
    lake.overwrite(spark.range(3), "gold", "t")
    both, write = threading.Barrier(2), Lake._write

    def together(self, *args):
        part = write(self, *args)
        both.wait(60)  # both have read version 1 and written their files
        return part

    monkeypatch.setattr(Lake, "_write", together)
    frames = {
        "a": (spark.createDataFrame([(1, "x"), (2, "y")], "a int, kind string"), ["kind"]),
        "b": (spark.createDataFrame([(5.5,)], "other double"), []),
    }
    outcome = {}

    def run(name):
        df, by = frames[name]
        try:
            outcome[name] = lake.overwrite(df, "gold", "t", by)
        except ConcurrentLoad as error:
            outcome[name] = error

    threads = [threading.Thread(target=run, args=(n,)) for n in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, o in outcome.items() if isinstance(o, str)]
    assert len(won) == 1 and outcome[won[0]].endswith("v=000002")
    df, by = frames[won[0]]
    assert rows(lake.read("gold", "t")) == rows(df) and lake.partition_columns("gold", "t") == by
    assert lake.read("gold", "t").dtypes == df.dtypes
    assert rows(lake.read("gold", "t", version=1)) == [(0,), (1,), (2,)]
    assert len(folders(tmp_path)) == 2  # the loser's files are gone


def test_appends_of_two_writers_both_count(spark, lake, monkeypatch):
    lake.append(spark.createDataFrame([(1,)], "a int"), "gold", "t")
    commit, raced = Lake._commit, []

    def late(self, layer, table, snapshot):
        if not raced:
            raced.append(True)
            lake.append(spark.createDataFrame([(2.5, "n")], "a double, b string"), layer, table)
        return commit(self, layer, table, snapshot)

    monkeypatch.setattr(Lake, "_commit", late)
    lake.append(spark.createDataFrame([(3,)], "a long"), "gold", "t")
    assert rows(lake.read("gold", "t")) == [(1.0, None), (2.5, "n"), (3.0, None)]
    assert lake.rows("gold", "t") == 3 and lake.snapshot("gold", "t").version == 3


def test_a_failed_write_leaves_nothing(spark, lake, tmp_path):
    lake.overwrite(spark.range(3), "gold", "t")
    bad = spark.range(5).selectExpr("IF(id = 3, raise_error('no'), id) AS id")
    for write in (lake.overwrite, lake.append):
        with pytest.raises(Exception, match="no"):
            write(bad.withColumn("id", F.col("id").cast("long")), "gold", "t")
    assert lake.rows("gold", "t") == 3 and len(folders(tmp_path)) == 1


NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double", "decimal(10,2)", "decimal(20,6)"]


@pytest.mark.parametrize("kinds", [NUMBERS, ["date", "timestamp_ntz", "timestamp"]])
def test_every_widening_can_be_read(spark, lake, kinds):
    value = "7" if kinds is NUMBERS else "DATE'2024-01-07'"
    for first in kinds:
        for second in kinds:
            name = "t_" + "".join(c if c.isalnum() else "_" for c in f"{first}_{second}")
            for k, kind in enumerate((first, second)):
                lake.append(spark.sql(f"SELECT {k} AS k, CAST({value} AS {kind}) AS v"), "gold", name)
            df = lake.read("gold", name)
            wanted = common_type(*[spark.sql(f"SELECT CAST(NULL AS {x}) AS v").schema["v"].dataType
                                   for x in (first, second)])
            assert df.schema["v"].dataType == wanted
            text = df.select("k", F.expr("CAST(v AS DATE) = DATE'2024-01-07'") if kinds is not NUMBERS
                             else F.expr("v = 7"))
            assert rows(text) == [(0, True), (1, True)]
    with pytest.raises(TypeError):
        lake.append(spark.sql("SELECT 1 AS k, TRUE AS v"), "gold", name)


def files_of(df):
    return set(df.inputFiles())


def test_an_upsert_rewrites_the_touched_files_only(spark, lake):
    many = spark.range(1000).selectExpr("id", "id AS v", "CAST(id AS STRING) AS s").repartitionByRange(100, "id")
    lake.overwrite(many, "gold", "t")
    before = files_of(lake.read("gold", "t"))
    change = spark.createDataFrame([(417, -1, "new"), (None, -2, "null")], "id long, v long, s string")
    upsert_table(lake, change, "gold", "t", ["id"])
    after = files_of(lake.read("gold", "t"))
    assert len(before) == 100 and len(before - after) == 1 and len(after - before) <= 2
    assert lake.rows("gold", "t") == 1001 == lake.read("gold", "t").count()
    assert rows(lake.read("gold", "t").where("v < 0")) == [(417, -1, "new"), (None, -2, "null")]
    delete_from_table(lake, "gold", "t", id=3)
    last = files_of(lake.read("gold", "t"))
    assert len(after - last) == 1 and lake.rows("gold", "t") == 1000
    delete_from_table(lake, "gold", "t", id=-5)
    assert files_of(lake.read("gold", "t")) == last
    plan_text = plan(lake.read("gold", "t").where("id = 1"))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in plan_text


def test_an_upsert_against_an_old_version_fails_whole(spark, lake):
    lake.overwrite(spark.range(3), "gold", "t")
    base = lake.snapshot("gold", "t")
    lake.append(spark.range(3, 5), "gold", "t")
    with pytest.raises(ConcurrentLoad):
        lake.replace_files("gold", "t", base, [], spark.range(9))
    assert rows(lake.read("gold", "t")) == [(i,) for i in range(5)]


def test_partitioned_copy_on_write_with_odd_values(spark, lake):
    kinds = ["a/b", "x=y", "100%", "ü [1]", "plain", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "id int, kind string")
    lake.overwrite(df, "gold", "t", ["kind"])
    upsert_table(lake, spark.createDataFrame([(10 + i, k) for i, k in enumerate(kinds[:4])] + [(2, "100%")],
                                             "id int, kind string"), "gold", "t", ["id"])
    delete_from_table(lake, "gold", "t", kind="x=y")
    expected = [(0, "a/b"), (2, "100%"), (3, "ü [1]"), (4, "plain"), (5, None), (10, "a/b"), (12, "100%"), (13, "ü [1]")]
    assert rows(lake.read("gold", "t")) == sorted(expected, key=repr) and lake.rows("gold", "t") == 8


def test_counts_run_no_job(spark, lake):
    lake.overwrite(spark.range(3), "bronze", "a")
    lake.append(spark.range(4), "bronze", "a")
    spark.sparkContext.setJobGroup("counting", "")
    try:
        counted = lake.layer_counts(("bronze",)), lake.row_counts("bronze")
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("counting")) == []
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert rows(counted[0]) == [("bronze", 1, 7)] and rows(counted[1]) == [("a", 7)]


def test_folders_of_other_origin_are_read_and_taken_over(spark, lake, tmp_path):
    folder = f"{lake.root}/gold/t"
    spark.range(2).write.parquet(f"{folder}/v=000001")
    spark.range(3).write.parquet(f"{folder}/v=000002")
    (tmp_path / "lake/gold/t/v=000003").mkdir()
    assert lake.read("gold", "t").count() == 3 == lake.rows("gold", "t")
    lake.append(spark.createDataFrame([(7, "x")], "id long, s string"), "gold", "t")
    assert rows(lake.read("gold", "t")) == [(0, None), (1, None), (2, None), (7, "x")]
    upsert_table(lake, spark.createDataFrame([(1, "y")], "id long, s string"), "gold", "t", ["id"])
    assert rows(lake.read("gold", "t")) == [(0, None), (1, "y"), (2, None), (7, "x")]
