"""Numbers of facts: the same as over one partition, without a stored copy of the rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starmill.operators import keys
from starmill.operators.asof import asof_join
from starmill.operators.keys import ranged_key
from starmill.sources.lake import Lake
from starmill.sources.workdir import work_dir
from starmill.suite import star


def _stored(spark) -> set[str]:
    folder = work_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _rows(spark, kind: str):
    ids = spark.range(0, 5000, 1, 7)
    key = {
        "number": F.col("id") * 7919 % 5003,
        "text": F.concat(F.lit("\u00e4-"), F.col("id") * 7919 % 5003),
        "nulls": F.when(F.col("id") % 5 != 0, F.col("id") % 700),
        "negative": 2500 - F.col("id"),
    }[kind]
    return ids.select(key.alias("k"), (F.col("id") % 11).alias("line"), F.col("id").alias("value"))


@pytest.mark.parametrize("kind", ["number", "text", "nulls", "negative"])
def test_numbers_are_those_of_one_window(spark, kind):
    df = _rows(spark, kind)
    before = _stored(spark)
    found = ranged_key(df, ["k", "line"], "sk")
    wanted = df.withColumn("sk", F.row_number().over(Window.orderBy("k", "line", "value")).cast("long"))
    assert found.schema["sk"].dataType == wanted.schema["sk"].dataType
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert _stored(spark) == before


def test_empty_frame_and_other_types(spark):
    assert ranged_key(_rows(spark, "number").where("k < 0"), ["k"], "sk").count() == 0
    half = _rows(spark, "number").withColumn("k", F.col("k") / 2)
    numbers = [r["sk"] for r in ranged_key(half, ["k"], "sk").orderBy("k").collect()]
    assert numbers == list(range(1, 5001))


def test_a_key_that_abounds_is_not_one_window(spark, monkeypatch):
    monkeypatch.setattr(keys, "SMALL_RANGE", 100)
    df = _rows(spark, "number").withColumn("k", F.when(F.col("k") % 2 == 0, F.col("k")))
    before = _stored(spark)
    found = ranged_key(df, ["k"], "sk")
    assert _stored(spark) != before
    assert sorted(r["sk"] for r in found.collect()) == list(range(1, 5001))


def test_facts_leave_no_copy_of_the_lines(spark):
    lines = spark.range(300).select(
        F.col("id").alias("order_id"), F.lit(1).alias("line_number"), (F.col("id") % 4).alias("part_id"),
        F.lit("1997-01-01").cast("timestamp_ntz").alias("created_ts"), F.lit(2.0).alias("quantity"),
        F.lit(10.0).alias("price"), F.lit(5.0).alias("cost"), F.lit("EUR").alias("price_currency"),
        F.lit(1.0).alias("price_fx_rate"), (F.col("id") % 3).alias("supplier_id"),
        F.lit("Cancelled").alias("status"), F.lit("O").alias("line_type"),
    )
    suppliers = spark.range(3).select(F.col("id").alias("supplier_id"), (F.col("id") + 1).alias("supplier_sk"))
    parts = spark.range(4).select(
        F.col("id").alias("part_id"), (F.col("id") + 1).alias("part_sk"),
        F.lit("1900-01-01").cast("timestamp_ntz").alias("eff_start_ts"),
        F.lit(None).cast("timestamp_ntz").alias("eff_end_ts"),
    )
    before = _stored(spark)
    rows = star.fact_lines(lines, suppliers, parts).orderBy("line_sk").collect()
    assert [r["line_sk"] for r in rows] == list(range(1, 301))
    assert all(r["supplier_sk"] == r["order_id"] % 3 + 1 and r["part_sk"] == r["order_id"] % 4 + 1 for r in rows)
    assert _stored(spark) == before


def test_hot_keys_are_measured_on_the_cheaper_frame(spark):
    """The sketch reads ``measured``, so what made the events is not run for it."""
    events = spark.range(2000).select(
        F.col("id").alias("sk"), F.lit(1).cast("long").alias("key"), F.lit("2000-01-01").cast("timestamp").alias("ts")
    )
    broken = events.withColumn("key", F.when(F.col("sk") >= 0, F.raise_error(F.lit("run"))).cast("long"))
    versions = spark.range(5).select(
        F.col("id").alias("key"), F.col("id").alias("v"),
        F.lit("1900-01-01").cast("timestamp").alias("eff_start_ts"),
        F.lit(None).cast("timestamp").alias("eff_end_ts"),
    )
    asof_join(broken, versions, "key", "ts", "key", "v", salt_from=1, disjoint=True, measured=events, distinct=True)
    found = asof_join(events, versions, "key", "ts", "key", "v", salt_from=1, disjoint=True, measured=events, distinct=True)
    assert found.where("v = 1").count() == 2000


def test_few_partition_values_are_written_where_they_are(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    df = spark.range(0, 100, 1, 4).withColumn("kind", F.col("id") % 2)
    lake.overwrite(df, "gold", "few", ["kind"], few=True)
    lake.overwrite(df, "gold", "many", ["kind"])
    assert lake.read("gold", "few").inputFiles().__len__() == 8  # four tasks, two values: no shuffle
    assert lake.rows("gold", "few") == 100
    assert sorted(lake.read("gold", "few").collect()) == sorted(lake.read("gold", "many").collect())
