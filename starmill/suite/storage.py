"""Sources, sinks, upserts, deletes, observability."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.operators.merge import delete_from_table, upsert, upsert_table
from starmill.sources.files import (
    MALFORMED,
    UNCONVERTED,
    discover_sources,
    load_csv,
    write_csv,
)
from starmill.sources.lake import ConcurrentLoad, Lake
from starmill.sources.workdir import fresh_path
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query

CUSTOMER_CSV = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _csv_folder(spark, sf) -> str:
    folder = fresh_path(spark, "csv")
    for table in ("customer", "supplier", "orders"):
        write_csv(load(spark, sf, table), f"{folder}/raw_{table}.csv")
    return folder


@query("csv_round_trip", "SELECT * FROM customer")
def csv_round_trip(spark, sf):
    path = write_csv(load(spark, sf, "customer"), fresh_path(spark, "csv") + "/raw_customer.csv")
    return load_csv(spark, path, CUSTOMER_CSV).drop(UNCONVERTED, MALFORMED)


@query("csv_inferred", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_inferred(spark, sf):
    path = write_csv(load(spark, sf, "supplier"), fresh_path(spark, "csv") + "/raw_supplier.csv")
    return load_csv(spark, path).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query(
    "source_discovery",
    """SELECT 'customer' AS "table", 'raw_customer.csv' AS file, count(*) AS rows FROM customer
       UNION ALL SELECT 'supplier', 'raw_supplier.csv', count(*) FROM supplier
       UNION ALL SELECT 'orders', 'raw_orders.csv', count(*) FROM orders""",
)
def source_discovery(spark, sf):
    folder = _csv_folder(spark, sf)
    counts = [
        load_csv(spark, f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table"), F.lit(name).alias("file"), "rows"
        )
        for table, name in discover_sources(spark, folder).items()
    ]
    return functools.reduce(DataFrame.unionByName, counts)


@query(
    "snapshot_overwrite",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000",
)
def snapshot_overwrite(spark, sf):
    """The second load reads the first while replacing it, with fewer columns and partitions."""
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.overwrite(load(spark, sf, "orders"), "silver", "orders")
    first = lake.read("silver", "orders").where("o_totalprice > 100000")
    second = first.select("o_orderkey", "o_orderstatus", "o_totalprice")
    lake.overwrite(second, "silver", "orders", ["o_orderstatus"])
    return lake.read("silver", "orders")


@query(
    "log_append_widened",
    sql("""SELECT run_id, status, run_ts, NULL AS seconds FROM {run_log} WHERE run_id % 2 = 0
           UNION ALL SELECT run_id, status, run_ts, seconds FROM {run_log} WHERE run_id % 2 = 1"""),
)
def log_append_widened(spark, sf):
    log = load(spark, sf, "run_log")
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.append(log.where("run_id % 2 = 0").select("run_id", "status", "run_ts"), "gold", "runs")
    lake.append(
        log.where("run_id % 2 = 1").select("run_id", "status", "run_ts", "seconds"), "gold", "runs"
    )
    return lake.read("gold", "runs", merge_schema=True)


_ROUNDED = "order_id, customer_id, status, CAST(price AS DOUBLE) AS price, _ingestion_ts"


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double"))


@query(
    "merge_upsert",
    sql(f"""SELECT {_ROUNDED} FROM {{orders_current}} t
            WHERE NOT EXISTS (SELECT 1 FROM {{orders_changes}} s WHERE s.order_id = t.order_id)
            UNION ALL SELECT {_ROUNDED} FROM {{orders_changes}}"""),
)
def merge_upsert(spark, sf):
    current, changes = load(spark, sf, "orders_current"), load(spark, sf, "orders_changes")
    return _plain(upsert(current, changes, ["order_id"]))


@query(
    "merge_upsert_composite",
    sql(f"""SELECT {_ROUNDED} FROM {{orders_current}} t
            WHERE NOT EXISTS (SELECT 1 FROM {{orders_changes}} s
                              WHERE s.order_id = t.order_id AND s.customer_id = t.customer_id)
            UNION ALL SELECT {_ROUNDED} FROM {{orders_changes}}"""),
)
def merge_upsert_composite(spark, sf):
    current, changes = load(spark, sf, "orders_current"), load(spark, sf, "orders_changes")
    return _plain(upsert(current, changes, ["order_id", "customer_id"]))


@query("delete_by_key", sql("SELECT run_id, fingerprint, status FROM {run_log} WHERE fingerprint <> '7'"))
def delete_by_key(spark, sf):
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.append(load(spark, sf, "run_log").select("run_id", "fingerprint", "status"), "gold", "runs")
    delete_from_table(lake, "gold", "runs", fingerprint="7")
    return lake.read("gold", "runs")


@query(
    "layer_counts",
    """SELECT 'raw' AS layer, CAST(0 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS rows
       UNION ALL SELECT 'bronze', 3, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
                                   + (SELECT count(*) FROM orders)
       UNION ALL SELECT 'silver', 1, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
       UNION ALL SELECT 'gold', 0, 0""",
)
def layer_counts(spark, sf):
    lake = Lake(spark, fresh_path(spark, "lake"))
    for table in ("customer", "supplier", "orders"):
        lake.overwrite(load(spark, sf, table), "bronze", table)
    lake.overwrite(lake.read("bronze", "orders").where("o_orderstatus = 'F'"), "silver", "orders")
    return lake.layer_counts(("raw", "bronze", "silver", "gold"))


@query("snapshot_two_writers", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def snapshot_two_writers(spark, sf):
    """Both writers start from the first version; the second to commit fails and changes nothing."""
    lake, orders = Lake(spark, fresh_path(spark, "lake")), load(spark, sf, "orders")
    lake.overwrite(orders, "silver", "orders")
    base = lake.snapshot("silver", "orders")
    first = orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")
    lake.overwrite(first, "silver", "orders", ["o_orderstatus"])
    try:
        lake.replace_files("silver", "orders", base, [], orders.select("o_custkey", "o_totalprice"))
    except ConcurrentLoad:
        return lake.read("silver", "orders")
    raise AssertionError("a version was committed twice")


@query(
    "append_widened_pairs",
    """SELECT o_orderkey, CAST(CAST(o_custkey AS INTEGER) AS DOUBLE) AS a,
              CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) AS b, CAST(o_orderdate AS TIMESTAMP) AS day
       FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT o_orderkey, CAST(o_custkey AS DOUBLE), CAST(o_totalprice AS DOUBLE),
              CAST(o_orderdate AS TIMESTAMP) FROM orders WHERE o_orderkey % 3 = 1
       UNION ALL SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 4, CAST(o_custkey AS DOUBLE), NULL
       FROM orders WHERE o_orderkey % 3 = 2""",
)
def append_widened_pairs(spark, sf):
    """Integers, decimals, doubles, dates and timestamps in one column, file by file."""
    lake, orders = Lake(spark, fresh_path(spark, "lake")), load(spark, sf, "orders")
    kinds = [
        ("CAST(o_custkey AS INT) AS a", "CAST(o_totalprice AS DECIMAL(14, 2)) AS b", "CAST(o_orderdate AS DATE) AS day"),
        ("CAST(o_custkey AS BIGINT) AS a", "CAST(o_totalprice AS DOUBLE) AS b", "CAST(o_orderdate AS TIMESTAMP) AS day"),
        ("o_custkey / 4D AS a", "CAST(o_custkey AS BIGINT) AS b"),
    ]
    for k, columns in enumerate(kinds):
        lake.append(orders.where(f"o_orderkey % 3 = {k}").selectExpr("o_orderkey", *columns), "gold", "log")
    return lake.read("gold", "log")


@query(
    "upsert_touched_files",
    """SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders
       WHERE o_orderkey % 50 <> 0 AND o_custkey % 7 <> 0
       UNION ALL SELECT o_orderkey, o_custkey, CAST(-1 AS DOUBLE) FROM orders
       WHERE o_orderkey % 50 = 0 AND o_custkey % 7 <> 0""",
)
def upsert_touched_files(spark, sf):
    """Copy on write: an upsert, then a delete per residue, each against the version before."""
    lake, orders = Lake(spark, fresh_path(spark, "lake")), load(spark, sf, "orders")
    stored = orders.selectExpr("o_orderkey", "o_custkey", "CAST(o_totalprice AS DOUBLE) AS price",
                               "o_custkey % 7 AS seventh")
    lake.overwrite(stored, "gold", "orders", ["seventh"])
    changes = stored.where("o_orderkey % 50 = 0").withColumn("price", F.lit(-1.0))
    upsert_table(lake, changes, "gold", "orders", ["o_orderkey"])
    delete_from_table(lake, "gold", "orders", seventh=0)
    return lake.read("gold", "orders").drop("seventh")
