import random
from datetime import datetime, timedelta

import pytest
from conftest import plan, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from starmill.operators import asof
from starmill.operators.asof import asof_join
from starmill.operators.keys import surrogate_key
from starmill.operators.lookup import lookup_join, measure_skew, spread


@pytest.fixture
def skewed(spark):
    """A third of the rows carry key 7."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500 + 10).alias("k"),
        F.col("id").alias("v"),
    )


def test_hot_keys_are_found_and_few(skewed):
    skew = measure_skew(skewed, ["k"])
    (seven,) = skewed.where("k = 7").select(F.xxhash64("k")).distinct().collect()
    assert skew.splits == {seven[0]: 6} and skew.null_splits == 1  # a third of 8 tasks, doubled
    assert not measure_skew(skewed.where("k <> 7"), ["k"])
    assert not measure_skew(skewed.where("false"), ["k"])
    nulls = skewed.withColumn("k", F.expr("nullif(k, 7)"))
    assert measure_skew(nulls, ["k"]).null_splits == 6


def partitions_of(salted, where):
    """Join partitions that hold the rows of ``where``."""
    spread_out = salted.where(where).select("k", "_salt").repartition(64, "k", "_salt")
    return spread_out.select(F.spark_partition_id()).distinct().count()


@pytest.mark.parametrize("hot", ["7", "NULL"])
@pytest.mark.parametrize("copies", [False, True])
def test_salted_lookup_equals_plain_join(spark, skewed, hot, copies):
    left = skewed.withColumn("k", F.expr(f"CASE WHEN k = 7 THEN {hot} ELSE k END").cast("long"))
    if copies:  # the hot rows are identical
        left = left.withColumn("v", F.expr("CASE WHEN v % 3 = 0 THEN 0 ELSE v END"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    expected = rows(left.join(right, "k", "left").select("k", "v", "w"))
    salted = lookup_join(left, right, ["k"], 400, salt_from=1)
    assert "_salt" in plan(salted)
    assert rows(salted) == expected
    assert rows(lookup_join(left, right, ["k"], 400)) == expected
    split, _ = spread(left, right, ["k"], measure_skew(left, ["k"]))
    assert partitions_of(split, F.col("k").eqNullSafe(F.expr(hot).cast("long"))) > 2


def test_lookup_keeps_null_keys_and_column_order(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "v int, k int")
    right = spark.createDataFrame([(5, "x")], "k int, w string")
    joined = lookup_join(left, right, ["k"], 1)
    assert joined.columns == ["v", "k", "w"] and rows(joined) == [(1, None, None), (2, 5, "x")]


def test_surrogate_keys_equal_row_number_without_one_partition(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").cast("string").alias("s"))
    numbered = surrogate_key(df, ["k", "s"], "sk", after=100)
    expected = df.withColumn("sk", F.row_number().over(Window.orderBy("k", "s")) + 100)
    assert rows(numbered) == rows(expected)
    assert "SinglePartition" not in plan(numbered)
    assert rows(surrogate_key(df, ["k"], "sk", partitions=16), "k", "sk") == rows(
        df.withColumn("sk", F.row_number().over(Window.orderBy("k"))), "k", "sk"
    )


def test_surrogate_keys_part_abundant_ties(spark):
    df = spark.range(3000).select(F.expr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END").alias("k"))
    numbered = surrogate_key(df, ["k"], "sk", partitions=8)
    ranked = df.withColumn("sk", F.row_number().over(Window.orderBy("k")))
    assert rows(numbered) == rows(ranked)
    files = numbered.where("k = 5").select(F.input_file_name()).distinct().count()
    assert files > 2
    assert "_tie" not in numbered.columns


def test_surrogate_keys_nulls_first_and_empty(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert rows(surrogate_key(df, ["k"], "sk")) == [("a", 2), ("b", 3), (None, 1)]
    assert surrogate_key(df.where("false"), ["k"], "sk").count() == 0


# ------------------------------------------------------------------ as-of

T0 = datetime(2020, 1, 1)


def versions_of(spark, table):
    """{key: [start days]} -> versions with consecutive validity."""
    out, sk = [], 0
    for key, starts in table.items():
        for start, end in zip(starts, [*starts[1:], None]):
            sk += 1
            out.append((key, sk, T0 + timedelta(days=start), None if end is None else T0 + timedelta(days=end)))
    return spark.createDataFrame(out, "key int, sk long, eff_start_ts timestamp, eff_end_ts timestamp"), out


def brute(events, versions):
    def valid(key, ts):
        hits = [sk for k, sk, s, e in versions
                if key is not None and ts is not None and k == key and s <= ts and (e is None or ts < e)]
        return hits[0] if hits else None

    return sorted([(i, key, ts, valid(key, ts)) for i, key, ts in events], key=repr)


@pytest.mark.parametrize("strategy", ["range", "merge"])
def test_asof_boundaries_and_nulls(spark, strategy):
    versions, listed = versions_of(spark, {1: [0, 10], 2: [5]})
    days = [(1, -1), (1, 0), (1, 9), (1, 10), (1, 99), (2, 4), (2, 5), (3, 5), (None, 5)]
    events = [(i, k, T0 + timedelta(days=d)) for i, (k, d) in enumerate(days)] + [(99, 1, None)]
    df = spark.createDataFrame(events, "id int, key int, ts timestamp")
    got = asof_join(df, versions, "key", "ts", "key", "sk", strategy)
    assert got.columns == ["id", "key", "ts", "sk"]
    assert rows(got) == brute(events, listed)


@pytest.mark.parametrize("strategy", ["range", "merge"])
@pytest.mark.parametrize("hot_versions", [3, 300])
def test_asof_with_a_hot_key_against_brute_force(spark, strategy, hot_versions):
    rng = random.Random(5)
    table = {7: sorted(rng.sample(range(2000), hot_versions))}
    table.update({k: sorted(rng.sample(range(2000), 2)) for k in range(20, 120)})
    versions, listed = versions_of(spark, table)
    events = [
        (i, 7 if i % 3 == 0 else rng.randrange(15, 125), T0 + timedelta(days=rng.randrange(2100)))
        for i in range(1500)
    ]
    df = spark.createDataFrame(events, "id int, key int, ts timestamp")
    got = asof_join(df, versions, "key", "ts", "key", "sk", strategy, salt_from=1)
    assert rows(got) == brute(events, listed)
    text = plan(got)
    assert ("_salt" if strategy == "range" else "_slice") in text


@pytest.mark.parametrize("strategy", ["range", "merge"])
def test_asof_with_identical_events_and_null_keys(spark, strategy):
    versions, listed = versions_of(spark, {7: list(range(0, 2000, 7)), 8: [3]})
    day = T0 + timedelta(days=500)
    events = [(0, 7, day)] * 300 + [(1, None, day)] * 300 + [
        (2 + i, 7 + i % 3, T0 + timedelta(days=i)) for i in range(300)
    ]
    df = spark.createDataFrame(events, "id int, key int, ts timestamp")
    got = asof_join(df, versions, "key", "ts", "key", "sk", strategy, salt_from=1)
    assert rows(got) == brute(events, listed)


def test_deep_history_chooses_merge(spark, monkeypatch):
    monkeypatch.setattr(asof, "DEEP", 5)
    versions, listed = versions_of(spark, {1: list(range(10)), 2: [0]})
    events = [(i, 1 + i % 2, T0 + timedelta(days=i % 12, hours=3)) for i in range(50)]
    df = spark.createDataFrame(events, "id int, key int, ts timestamp")
    got = asof_join(df, versions, "key", "ts", "key", "sk")
    assert "Window" in plan(got) and rows(got) == brute(events, listed)


def test_asof_on_an_empty_dimension(spark):
    versions, _ = versions_of(spark, {1: [0]})
    df = spark.createDataFrame([(0, 1, T0)], "id int, key int, ts timestamp")
    assert rows(asof_join(df, versions.where("false"), "key", "ts", "key", "sk")) == [(0, 1, T0, None)]


def test_asof_keys_of_different_types(spark):
    versions, listed = versions_of(spark, {1: [0]})
    wide = versions.withColumn("key", F.col("key").cast("long") + 2**40).unionByName(
        versions.withColumn("key", F.col("key").cast("long"))
    )
    df = spark.createDataFrame([(0, 1, T0)], "id int, key int, ts timestamp")
    for strategy in ("range", "merge"):
        assert rows(asof_join(df, wide, "key", "ts", "key", "sk", strategy)) == [(0, 1, T0, 1)]
    for strategy in ("range", "merge"):  # text that is no number matches nothing
        text = versions.withColumn("key", F.lit("a"))
        assert rows(asof_join(df, text, "key", "ts", "key", "sk", strategy)) == [(0, 1, T0, None)]


def test_disjoint_histories_need_no_window(spark):
    kinds = "key int, sk long, eff_start_ts timestamp, eff_end_ts timestamp"
    mid, end = T0 + timedelta(days=5), T0 + timedelta(days=9)
    versions = spark.createDataFrame([(1, 1, T0, mid), (1, 2, mid, None), (2, 3, T0, end)], kinds)
    df = spark.createDataFrame([(i, k, T0 + timedelta(days=d)) for i, (k, d) in enumerate(
        [(1, 0), (1, 5), (1, 4), (2, 8), (2, 9), (3, 1)])], "id int, key int, ts timestamp")
    plain = asof_join(df, versions, "key", "ts", "key", "sk", "range")
    quick = asof_join(df, versions, "key", "ts", "key", "sk", "range", disjoint=True)
    assert rows(quick) == rows(plain) and "Window" in plan(plain) and "Window" not in plan(quick)
    assert asof.overlapping(versions, "key").count() == 0
    open_twice = versions.unionAll(spark.createDataFrame([(2, 4, mid, None)], kinds))
    assert rows(asof.overlapping(open_twice, "key"), "sk") == [(3,)]
