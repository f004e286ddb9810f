import functools

from conftest import plan, rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.operators import profile as P
from starmill.operators import reconcile as R
from starmill.operators import relations as rel
from starmill.plans.profiling import incremental_profile, profile_load


def frame(spark):
    return spark.createDataFrame(
        [(1, "a", 2.0, None), (2, "", 4.0, None), (3, None, None, None), (4, "a", 6.0, None)],
        "row_id int, t string, x double, n int",
    )


def test_statistics(spark):
    got = {r["column"]: r for r in P.profile_table(frame(spark), "f").collect()}
    assert [got[c]["null_count"] for c in ("row_id", "t", "x", "n")] == [0, 2, 1, 4]
    assert got["t"]["null_pct"] == 50.0 and got["t"]["distinct_count"] == 2  # "a" and ""
    assert (got["x"]["min_value"], got["x"]["max_value"], got["x"]["avg"], got["x"]["stddev"]) == (
        "2.0", "6.0", 4.0, 2.0)
    assert got["n"]["distinct_count"] == 0 and got["n"]["min_value"] is None
    assert got["t"]["min_value"] is None and got["t"]["column_count"] == 4


def test_empty_table(spark):
    got = P.profile_table(frame(spark).where("false"), "f").collect()
    assert {(r["row_count"], r["null_pct"], r["distinct_count"]) for r in got} == {(0, 0.0, 0)}


def test_approximate_distinct_is_one_pass(spark):
    df = spark.range(1000).selectExpr("id AS a_id", "id % 10 AS b")
    exact = dict(rows(P.distinct_counts(df)))
    rough = P.distinct_counts(df, exact=False)
    assert exact == {"a_id": 1000, "b": 10}
    assert all(abs(n - exact[c]) <= 0.1 * exact[c] for c, n in rows(rough))
    assert "Expand" not in plan(P.distinct_counts(df))


def test_value_counts_order_ties_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("c",)], "t string")
    got = P.value_counts(df, ["t"], 3).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in got] == [("a", 2), ("None", 1), ("b", 1)]


def test_categorical_columns(spark):
    df = frame(spark)
    assert P.categorical_columns(df, P.distinct_counts(df).collect()) == ["t"]


def test_candidate_keys_both_ways(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, None, 1)], "a_id int, b_id int, c_id int")
    assert rows(P.candidate_keys(P.profile_table(df, "t"))) == [("t", "a_id")]
    assert rows(P.identifier_keys(df, "t")) == [("t", "a_id")]


def test_duplicate_keys_count_nulls_as_values(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, 1), (2, 1)], "a int, b int")
    assert rows(P.duplicate_key_count(df, ["a", "b"])) == [(5, 3, 2)]


# ------------------------------------------------------------------ relations


def related(spark):
    buyers = spark.createDataFrame([(i,) for i in range(1, 11)], "buyer_id long")
    yards = spark.createDataFrame([(i,) for i in range(1, 21)], "yard_id int")
    orders = spark.createDataFrame(
        [(100 + i, b) for i, b in enumerate([1, 1, 1, 2, 3, 99, None])], "order_id int, buyer_id int"
    )
    tables = {"buyers": buyers, "yards": yards, "orders": orders}
    keys = {"buyers": ["buyer_id"], "yards": ["yard_id"], "orders": ["order_id"]}
    return tables, keys


def test_foreign_key_prefers_the_named_parent_and_counts_orphan_rows(spark):
    tables, keys = related(spark)
    (found,) = rel.discover_foreign_keys(tables, keys)
    assert (found["table"], found["column"], found["parent_table"]) == ("orders", "buyer_id", "buyers")
    assert found["overlap_pct"] == 75.0 and found["orphan_count"] == 1
    assert found["score"] == 1.55 and found["runner_up_score"] == 0.75
    assert rows(rel.foreign_keys(tables, keys), "orphan_count") == [(1,)]
    assert rel.foreign_keys({"yards": tables["yards"]}, {"yards": ["yard_id"]}).count() == 0


def test_numbers_match_across_types_but_not_text(spark):
    a = spark.createDataFrame([(1.0,), (2.5,)], "x_id double")
    b = spark.createDataFrame([(1,)], "x_id long")
    c = spark.createDataFrame([("1",)], "x_id string")
    values = {t: set(rows(rel.value_set(df, t, "x_id"), "kind", "value")) for t, df in zip("abc", (a, b, c))}
    assert values["a"] & values["b"] == {("number", "1")}
    assert not values["b"] & values["c"]


def test_more_columns_than_bits_in_a_word(spark, monkeypatch):
    monkeypatch.setattr(rel, "_WORD", 3)
    names = [f"c{i}_id" for i in range(8)]
    wide = spark.createDataFrame([tuple(range(8))] * 2, ", ".join(f"{n} int" for n in names))
    parent = spark.createDataFrame([(7,)], "c7_id int")
    found = rel.discover_foreign_keys({"wide": wide, "parent": parent}, {"parent": ["c7_id"]})
    assert [(f["column"], f["orphan_count"]) for f in found] == [("c7_id", 0)]


def test_name_bonus():
    assert rel.name_bonus("external_buyer_id", "buyers", "external_buyer_id") == 0.8
    assert rel.name_bonus("raw_vessel_id", "vessels", "vessel_id") == 0.3
    assert rel.name_bonus("order_id", "buyers", "buyer_id") == 0.0
    # contained, not only the same words
    assert rel.name_bonus("cust_id", "customers", "id") == 0.3
    assert rel.name_bonus("build_id", "buildslots", "slot") == 0.3
    assert rel.name_bonus("main_customers_id", "raw_customers", "id") == 0.3
    assert rel.name_bonus("id", "customers", "id") == 0.5 + 0.3 * ("id" in "customers")
    assert rel.name_bonus("_id", "customers", "key") == 0.0


def test_discovery_prefers_a_table_whose_name_holds_the_stem(spark):
    ids = spark.range(10)
    tables = {
        "customers": ids.selectExpr("id AS key"), "aardvarks": ids.selectExpr("id AS key"),
        "sales": ids.selectExpr("id AS cust_id"),
    }
    (found,) = rel.discover_foreign_keys(tables, {"customers": ["key"], "aardvarks": ["key"]})
    assert (found["parent_table"], found["score"], found["runner_up_score"]) == ("customers", 1.3, 1.0)


def test_orphan_count_of_a_hot_value(spark):
    child = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 THEN id + 1000 END AS k")
    parent = spark.createDataFrame([(5,), (5,)], "p int")
    assert rows(rel.orphan_count(child, "k", parent, "p")) == [(100,)]


# ------------------------------------------------------------------ reconcile

PROFILE = {
    "a": {"dtype": "int", "null_count": 0, "row_count": 100, "values": []},
    "b": {"dtype": "string", "null_count": 3, "row_count": 100, "values": ["Y", "N", "None", ""]},
    "d": {"dtype": "decimal(10,2)", "null_count": 0, "row_count": 100, "values": []},
    "t": {"dtype": "timestamp", "null_count": 0, "row_count": 100, "values": []},
}


def test_reconcile_drops_and_widens_without_touching_the_draft():
    draft = {
        "table": "x",
        "rules": {
            "not_null": {"columns": ["a", "b", "gone"], "max_fail_rate": 0.02},
            "unique": {"columns": ["gone"]},
            "range": {"checks": {"d": {"min": 0, "max": 1}, "t": {"min": 0, "max": 1}}},
            "allowed_values": {"checks": {"b": ["Yes", "No"], "a": [1]}},
        },
    }
    fitted, changes = R.reconcile(draft, PROFILE)
    assert fitted["rules"]["not_null"]["columns"] == ["a"]
    assert "unique" not in fitted["rules"] and list(fitted["rules"]["range"]["checks"]) == ["d"]
    assert fitted["rules"]["allowed_values"]["checks"] == {"b": ["N", "No", "Y", "Yes"], "a": [1]}
    assert ("unique", "", "remove", "no valid columns left") in changes and len(changes) == 6
    assert draft["rules"]["unique"]["columns"] == ["gone"]


def test_reconcile_tolerates_a_null_rate_within_the_limit_and_needs_a_profile():
    draft = {"rules": {"not_null": {"columns": ["b"], "max_fail_rate": 0.03}}}
    assert R.reconcile(draft, PROFILE) == (draft, [])
    assert R.reconcile({"rules": {"unique": {"columns": ["zz"]}}}, {})[1] == []


def test_states_of_loads_merge_to_the_profile_of_all(spark):
    df = spark.range(6000).selectExpr(
        "CAST(id AS INT) AS i", "id * 1000000007 AS big", "CAST(id % 700 AS STRING) AS s",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE id / 7D END AS x", "CAST(id AS DECIMAL(30, 4)) AS d",
        "DATE'2024-01-01' + CAST(id % 90 AS INT) AS day", "'' AS empty")
    states = functools.reduce(
        DataFrame.unionByName,
        [P.profile_state(df.where(f"i % 4 = {k}"), "t").withColumn("load", F.lit(k)) for k in range(4)])
    states = states.unionByName(P.profile_state(df.limit(0), "t").withColumn("load", F.lit(9)))
    merged = {r["column"]: r for r in P.merged_profile(states).collect()}
    whole = {r["column"]: r for r in P.profile_table(df, "t").collect()}
    assert set(merged) == set(whole)
    for c, r in whole.items():
        m = merged[c]
        for name in ("position", "dtype", "row_count", "column_count", "null_count", "null_pct",
                     "min_value", "max_value", "avg"):
            assert m[name] == r[name], (c, name)
        assert m["stddev"] == r["stddev"] or abs(m["stddev"] / r["stddev"] - 1) < 1e-6
        assert abs(m["distinct_count"] - r["distinct_count"]) <= 0.03 * r["distinct_count"]


def test_a_new_load_reads_no_old_rows(spark, lake, tmp_path):
    profile_load(lake, spark.range(10), "t", "a")
    profile_load(lake, spark.range(10, 30), "t", "b")
    profile_load(lake, spark.range(10, 40).withColumn("new", F.lit("x")), "t", "b")  # b once more
    found = {r["column"]: r for r in incremental_profile(lake, "t").collect()}
    assert (found["id"]["row_count"], found["id"]["max_value"], found["id"]["distinct_count"]) == (40, "39", 40)
    assert (found["new"]["row_count"], found["new"]["null_count"], found["new"]["distinct_count"]) == (40, 10, 1)
    assert lake.layer_counts(("gold",)).first().tables == 0


def _related(spark):
    """A parent with three children of full, half and too little overlap, and unrelated columns."""
    rows_ = spark.range(20_000)
    parent = rows_.selectExpr("id AS key_id", "id * 3 AS other_id")
    noise = [f"id * 7919 + {10**9 + k * 10**8} AS n{k}_id" for k in range(50)]
    child = rows_.selectExpr(
        "id % 900 AS full_id", "IF(id % 2 = 0, id, -id - 1) AS half_id",
        "IF(id % 5 = 0, id, -id - 1) AS fifth_id", "CAST(NULL AS LONG) AS none_id", *noise)
    return {"parent": parent, "child": child}, {"parent": ["key_id"]}


def test_sketches_leave_unrelated_columns_out(spark, monkeypatch):
    tables, keys = _related(spark)
    counted, pair_counts = [], rel._pair_counts

    def counting(tables, columns, *rest):
        counted.append(columns)
        return pair_counts(tables, columns, *rest)

    monkeypatch.setattr(rel, "_pair_counts", counting)
    quick = rel.discover_foreign_keys(tables, keys)
    monkeypatch.setattr(rel, "SKETCH_FROM", 10_000)
    plain = rel.discover_foreign_keys(tables, keys)
    assert quick == plain and {f["column"] for f in quick} == {"full_id", "half_id"}
    assert len(counted[1]) > 50 and set(counted[0]) == {
        ("child", "full_id"), ("child", "half_id"), ("parent", "key_id")}


def test_columns_of_unlike_sizes_are_never_left_out(spark):
    small = spark.range(40).selectExpr("id * 100000 AS a_id")
    large = spark.range(500_000).selectExpr("id * 10 AS key_id")
    pair = (("small", "a_id"), ("large", "key_id"))
    tables = {"small": small, "large": large}
    assert rel.possible_pairs(tables, list(pair), [pair], 0.5) == [pair]
    nothing = {"small": small.limit(0), "large": large}
    assert rel.possible_pairs(nothing, list(pair), [pair], 0.5) == []
