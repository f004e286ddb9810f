"""Lines of a fact move once: for lookups in large tables only their keys move."""

from __future__ import annotations

import time

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from starmill.operators import keys, lookup
from starmill.operators.asof import asof_join
from starmill.operators.keys import ranged_key
from starmill.operators.lookup import lookup_join
from starmill.plans import shipyard
from starmill.sources import workdir
from starmill.sources.workdir import materialize


def nodes(df, kind):
    """Column names of the children of every node of this kind in the optimized plan."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == kind:
            found.append([[b.output().apply(i).name() for i in range(b.output().size())] for b in below])
        todo += below
    return found


@pytest.fixture
def sources(spark, lake):
    ids = spark.range(0, 2000, 1, 5)
    at = F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, CAST(id % 900 AS INT))")
    lines = ids.select(
        F.when(F.col("id") % 10 != 0, F.concat(F.lit("r"), F.col("id") * 7919 % 1500)).alias("line_reference"),
        F.col("id").cast("string").alias("external_order_id"),
        # a third on one vessel, some on none, some on an unknown one
        F.expr("CASE WHEN id % 3 = 0 THEN 'V7' WHEN id % 7 = 0 THEN NULL ELSE concat('V', id % 60) END").alias("external_vessel_id"),
        F.expr("CASE WHEN id % 17 = 0 THEN NULL WHEN id % 2 = 0 THEN 'S1' ELSE concat('S', id % 40) END").alias("external_subcontractor_id"),
        F.lit("O").alias("line_type"), F.lit("part").alias("line_name"), F.lit("Cancelled").alias("status"),
        F.expr("CASE WHEN id % 19 = 0 THEN NULL ELSE 0 END").cast("int").alias("_no_time"), at.alias("_at"),
        F.lit(3).alias("duration_days"), (F.col("id") % 5).cast("int").alias("sequence"),
        (F.col("id") / 7).alias("price"), F.lit("EUR").alias("price_currency"), F.lit(1.0).alias("price_fx_rate"),
        (F.col("id") / 9).alias("cost"), F.lit("EUR").alias("cost_currency"), F.lit(1.0).alias("cost_fx_rate"),
        F.lit(1).alias("crew_officers"), F.lit(2).alias("crew_ratings"), F.lit(3).alias("crew_cadets"),
    )
    lines = lines.withColumn("created_ts", F.when(F.col("_no_time").isNotNull(), F.col("_at"))).withColumns(
        {"start_date": F.col("_at"), "end_date": F.lit(None).cast("timestamp_ntz"),
         "cancelled_ts": F.when(F.col("sequence") == 1, F.col("_at"))}).drop("_at", "_no_time")
    suppliers = spark.range(30).select(
        F.concat(F.lit("S"), "id").alias("subcontractor_id"), (F.col("id") + 1).alias("subcontractor_sk"))
    starts = spark.range(50).selectExpr("concat('V', id) AS vessel_id", "id * 2 AS vessel_sk", "id")
    change = F.lit("2001-01-01").cast("timestamp_ntz")
    first = starts.withColumns({"eff_start_ts": F.lit("2000-02-01").cast("timestamp_ntz"), "eff_end_ts": change})
    second = starts.where("id % 3 = 1").withColumns(
        {"vessel_sk": F.col("vessel_sk") + 1, "eff_start_ts": change, "eff_end_ts": F.lit(None).cast("timestamp_ntz")})
    lake.overwrite(lines, "silver", "order_lines")
    lake.overwrite(suppliers, "gold", "dim_subcontractor")
    lake.overwrite(first.union(second).drop("id"), "gold", "dim_vessel")
    return lake


def small(monkeypatch, limit):
    """Sides of more rows than this are large."""
    monkeypatch.setattr(lookup, "HELD_ROWS", limit)


@pytest.mark.parametrize("limit", [0, 40])
def test_lines_do_not_move_for_large_tables(sources, monkeypatch, limit):
    """40: the suppliers are few, the vessels' versions many."""
    at = F.lit("2002-01-01").cast("timestamp")
    wanted = rows(shipyard.fact_order_lines(sources, at))
    small(monkeypatch, limit)
    fact = shipyard.fact_order_lines(sources, at)
    assert rows(fact) == wanted and len(wanted) == 2000
    assert sorted(r[0] for r in wanted) == list(range(1, 2001))
    joins = nodes(fact, "Join")
    moved = [left for left, right in joins if not {"_v_sk", "subcontractor_sk"}.isdisjoint(right) and "line_name" in left]
    assert len(joins) == 2 and len(moved) == (limit > 0)  # the one with few suppliers moves nothing


def test_lines_equal_the_plain_joins(sources, monkeypatch):
    small(monkeypatch, 0)
    fact = shipyard.fact_order_lines(sources, F.lit("2002-01-01").cast("timestamp"))
    lines, vessels = sources.read("silver", "order_lines"), sources.read("gold", "dim_vessel")
    suppliers = sources.read("gold", "dim_subcontractor")
    plain = lines.join(suppliers, lines.external_subcontractor_id == suppliers.subcontractor_id, "left").join(
        vessels, F.expr("external_vessel_id = vessel_id AND created_ts >= eff_start_ts"
                        " AND (eff_end_ts IS NULL OR created_ts < eff_end_ts)"), "left")
    columns = ["order_id", "subcontractor_sk", "vessel_sk", "start_date_sk", "date_cancelled_sk"]
    day = [F.date_format(c, "yyyyMMdd").cast("int") for c in ("start_date", "cancelled_ts")]
    plain = plain.select("external_order_id", "subcontractor_sk", "vessel_sk", *day).toDF(*columns)
    assert rows(fact, *columns) == rows(plain)
    by_reference = fact.orderBy("line_sk").select("line_reference").collect()
    assert [r[0] for r in by_reference] == [r[0] for r in lines.orderBy("line_reference").select("line_reference").collect()]


def test_hot_keys_of_a_lookup_are_split(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 4).select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN 5 ELSE id % 900 END").alias("k"), F.col("id").cast("string").alias("wide"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    seen = []

    def look(asked):
        seen.append(asked.columns)
        return lookup_join(asked, right, ["k"], 500, salt_from=1, measured=df, distinct=True)

    monkeypatch.setattr(keys, "TASK_ROWS", 100)  # more tasks than the session has
    found = ranged_key(df, ["id"], "sk", [(["k"], look)])
    assert seen == [["_range", "_place", "k"]] and "_salt" in plan(found)
    assert found.columns == ["id", "k", "wide", "sk", "w"]
    assert rows(found) == rows(df.withColumn("sk", F.col("id") + 1).join(right, "k", "left").select(*found.columns))


def test_a_key_that_abounds_is_stored_and_looked_up(spark, monkeypatch):
    monkeypatch.setattr(keys, "SMALL_RANGE", 100)
    df = spark.range(2000).select(F.expr("CASE WHEN id % 2 = 0 THEN id END").alias("a"), (F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    found = ranged_key(df, ["a"], "sk", [(["k"], lambda asked: lookup_join(asked, right, ["k"], 5))])
    assert rows(found, "k", "w") == rows(df.join(right, "k", "left").select("k", "w"))
    assert sorted(r["sk"] for r in found.collect()) == list(range(1, 2001))


def test_a_key_moves_once_for_its_version(spark):
    events = spark.range(100).selectExpr("concat('k', id % 7) AS key", "timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, id) AS ts", "id")
    versions = spark.range(5).selectExpr(
        "concat('k', id) AS key", "id AS v", "timestamp_ntz'1900-01-01' AS eff_start_ts",
        "CAST(NULL AS TIMESTAMP_NTZ) AS eff_end_ts")
    found = asof_join(events, versions, "key", "ts", "key", "v", disjoint=True)
    assert sorted(nodes(found, "Join")[0][0]) == ["_k", "_t", "id"]
    assert found.columns == ["key", "ts", "id", "v"]
    assert rows(found) == rows(events.join(versions.select("key", "v"), "key", "left").select(*found.columns))


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


@pytest.mark.parametrize("write", ["work table", "lake"])
def test_writes_leave_no_shuffle_files(spark, lake, write):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffled(spark), spark.conf.get(workdir._DROP)
    if write == "lake":
        lake.overwrite(counted, "silver", "t")
        stored = lake.read("silver", "t")
    else:
        stored = materialize(counted)
    until = time.time() + 20  # they are deleted in the background
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert stored.count() == 7 and spark.conf.get(workdir._DROP) == setting


def test_a_failed_write_gives_the_setting_back(spark):
    setting = spark.conf.get(workdir._DROP)
    with pytest.raises(Exception, match="no luck"):
        materialize(spark.range(3).select(F.raise_error(F.lit("no luck")).cast("int").alias("x")))
    assert spark.conf.get(workdir._DROP) == setting and not workdir._writing
