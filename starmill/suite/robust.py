"""Inputs that are not clean: unlike types, dirty batches, text that does not convert, partitioned
and replaced tables, stale data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from starmill.operators.asof import asof_join
from starmill.operators.contracts import Validation
from starmill.operators.history import first_history, next_history
from starmill.operators.merge import upsert_table
from starmill.operators.products import Products
from starmill.plans.load import LoadPlan, SilverTable, run_load
from starmill.sources.files import UNCONVERTED, write_csv
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path, materialize
from starmill.suite import loads, star
from starmill.suite.fixtures import load, sql
from starmill.suite.history import CUSTOMER_HASH, versions_sql
from starmill.suite.registry import query


def _both(events, versions, key, ts):
    """The two strategies' answers, one below the other."""
    ranged, merged = (
        asof_join(events, versions, key, ts, "customer_id", "customer_sk", strategy).withColumn(
            "strategy", F.lit(strategy)
        )
        for strategy in ("range", "merge")
    )
    return ranged.unionByName(merged)


_STRATEGIES = "(SELECT unnest(['range', 'merge']) AS strategy)"


@query(
    "asof_date_event",
    sql(f"""SELECT o.o_orderkey AS order_id, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day,
                   v.customer_sk, strategy
            FROM {{orders}} o CROSS JOIN {_STRATEGIES} LEFT JOIN {{buyer_versions}} v
              ON v.customer_id = o.o_custkey
             AND v.eff_start_ts <= CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP)
             AND (v.eff_end_ts IS NULL OR CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) < v.eff_end_ts)"""),
)
def asof_date_event(spark, sf):
    """Events by day against versions that change within the day."""
    events = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), "o_custkey", F.to_date("o_orderdate").alias("day")
    )
    return _both(events, materialize(load(spark, sf, "buyer_versions")), "o_custkey", "day")


@query(
    "asof_mixed_key_types",
    sql(f"""SELECT e.order_id, e.buyer, e.at, v.customer_sk, strategy
            FROM (SELECT o_orderkey AS order_id, o_orderdate AS at, CASE WHEN o_orderkey % 7 = 0
                         THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS buyer FROM {{orders}}) e
            CROSS JOIN {_STRATEGIES} LEFT JOIN {{buyer_versions}} v
              ON v.customer_id = TRY_CAST(e.buyer AS BIGINT) AND v.eff_start_ts <= e.at
             AND (v.eff_end_ts IS NULL OR e.at < v.eff_end_ts)"""),
)
def asof_mixed_key_types(spark, sf):
    """Text keys, some of them no numbers, against numeric ones."""
    events = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string")).alias("buyer"),
        F.col("o_orderdate").alias("at"),
    )
    return _both(events, materialize(load(spark, sf, "buyer_versions")), "buyer", "at")


_CLEAN = ["{customers_1}", "(SELECT * FROM {customers_2} WHERE customer_id % 13 <> 0)", "{customers_3}"]


@query(
    "scd2_dirty_batches",
    versions_sql(_CLEAN, "customer_id", CUSTOMER_HASH,
                 "customer_name, segment, CAST(balance AS DOUBLE) AS balance", "customer_sk"),
)
def scd2_dirty_batches(spark, sf):
    """Three batches, two of them with NULL and repeated keys, which leave no trace."""
    how = ("customer_id", star.CUSTOMER_TRACKED, "customer_sk")
    history = first_history(load(spark, sf, "customers_1"), *how)
    for name in ("customers_2_dirty", "customers_3_dirty"):
        history = materialize(next_history(history, load(spark, sf, name), *how), "hist")
    return history.withColumn("balance", F.col("balance").cast("double"))


def _text_load(spark, sf) -> Lake:
    """A load of a CSV whose columns stand in another order than declared, with bad values."""
    orders = load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 11 == 0, "abc")
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("n"), "o_orderkey"))
        .otherwise(F.col("o_orderkey").cast("string")).alias("order_id"),
    )
    folder = fresh_path(spark, "raw")
    write_csv(orders, f"{folder}/raw_orders.csv")
    contract = {
        "table": "orders",
        "schema": {"required_columns": ["order_id"]},
        "rules": {"not_null": {"severity": "soft", "columns": ["order_id"]}},
    }
    plan = LoadPlan(
        [SilverTable("orders", ["order_id"])], lambda at: [], {"orders": contract},
        {"orders": "order_id bigint, status string, price decimal(18,2)"},
    )
    lake = Lake(spark, fresh_path(spark, "lake"))
    run_load(spark, folder, lake.root, plan, datetime(2002, 1, 1), "r1")
    return lake


@query(
    "load_type_quarantine",
    """SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 13 = 0 THEN 'n' || o_orderkey END AS bad_id,
              CASE WHEN o_orderkey % 11 = 0 THEN 'abc' END AS bad_price,
              concat_ws(';', CASE WHEN o_orderkey % 13 = 0 THEN 'not_null' END,
                        CASE WHEN o_orderkey % 11 = 0 THEN 'type_price' END,
                        CASE WHEN o_orderkey % 13 = 0 THEN 'type_order_id' END) AS _quarantine_reasons
       FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0""",
)
def load_type_quarantine(spark, sf):
    rejected = _text_load(spark, sf).read("quarantine", "orders")
    text = F.col(UNCONVERTED)
    return rejected.select(
        "status", text["order_id"].alias("bad_id"), text["price"].alias("bad_price"),
        "_quarantine_reasons",
    )


@query(
    "csv_reordered_header",
    """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price
       FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0""",
)
def csv_reordered_header(spark, sf):
    kept = _text_load(spark, sf).read("silver", "orders")
    return kept.select("order_id", "status", F.col("price").cast("double").alias("price"))


_PARTED = "SELECT o_orderkey, o_totalprice, lpad(CAST(o_orderkey % 3 AS VARCHAR), 2, '0') AS part FROM orders"


def _parted(spark, sf, where="true"):
    part = F.lpad((F.col("o_orderkey") % 3).cast("string"), 2, "0").alias("part")
    return load(spark, sf, "orders").where(where).select("o_orderkey", "o_totalprice", part)


@query("append_partitioned", f"SELECT * FROM ({_PARTED})")
def append_partitioned(spark, sf):
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.overwrite(_parted(spark, sf, "o_orderkey % 2 = 0"), "gold", "orders", ["part"])
    lake.append(_parted(spark, sf, "o_orderkey % 2 = 1"), "gold", "orders")
    return lake.read("gold", "orders")


@query("partition_text_values", f"SELECT part, count(*) AS rows FROM ({_PARTED}) GROUP BY part")
def partition_text_values(spark, sf):
    """A partition value such as '01' is still text after the round trip."""
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.overwrite(_parted(spark, sf), "gold", "orders", ["part"])
    return lake.read("gold", "orders").groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "upsert_partitioned",
    f"""SELECT o_orderkey, part, CASE WHEN o_orderkey % 5 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice
        FROM ({_PARTED})""",
)
def upsert_partitioned(spark, sf):
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.overwrite(_parted(spark, sf), "gold", "orders", ["part"])
    changes = _parted(spark, sf, "o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(-1.0))
    upsert_table(lake, changes, "gold", "orders", ["o_orderkey"])
    assert lake.partition_columns("gold", "orders") == ["part"]
    return lake.read("gold", "orders")


@query(
    "product_view_after_reload",
    "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY o_orderstatus",
)
def product_view_after_reload(spark, sf):
    """A view built over half of gold shows all of it after the next load, to another reader."""
    lake = Lake(spark, fresh_path(spark, "lake"))
    lake.overwrite(load(spark, sf, "orders").where("o_orderkey % 2 = 0"), "gold", "sold")
    text = "SELECT o_orderstatus AS status, count(*) AS orders FROM sold GROUP BY o_orderstatus"
    assert Products(lake).build({"id": "by_status", "sql": text})["status"] == "built"
    lake.overwrite(load(spark, sf, "orders"), "gold", "sold")
    return Products(Lake(spark, lake.root)).frame("by_status")


_AGES = """(SELECT datediff('day', max(ts), DATE '2025-06-01') AS age, count(*) AS n FROM events)"""


@query(
    "dq_freshness_gate",
    f"""SELECT 'events' AS "table", n AS row_count, days AS max_age_days, age > days AS promotion_blocked,
               CASE WHEN age > days THEN 'freshness failed 100.00% (> allowed 0.00%)' ELSE '' END AS blocking_reason
        FROM {_AGES}, (SELECT unnest([30, 400, 500]) AS days)""",
)
def dq_freshness_gate(spark, sf):
    def gate(days):
        rule = {"severity": "hard", "column": "ts", "max_age_days": days}
        contract = {"table": "events", "rules": {"freshness": rule}}
        judged = Validation(load(spark, sf, "events"), contract, as_of="2025-06-01").gate()
        return judged.select(
            "table", "row_count", F.lit(days).alias("max_age_days"), "promotion_blocked", "blocking_reason"
        )

    return gate(30).unionByName(gate(400)).unionByName(gate(500))


@query(
    "load_run_history",
    sql(f"""SELECT 'r1' AS run_id, CASE WHEN count(*) > 0 THEN 'blocked' ELSE 'succeeded' END AS pipeline_status,
                   CAST(count(*) AS VARCHAR) AS quarantined
            FROM ({loads.SILVER_FLAGGED}) WHERE {loads._ANY}"""),
)
def load_run_history(spark, sf):
    lake, _ = loads._run(spark, sf)
    runs = lake.read("gold", "run_history").where(
        F.get_json_object("execution_logs", "$.blocking_reasons.orders").isNotNull()
    )
    number = F.get_json_object("silver_summary", "$.orders.row_count_quarantined")
    return runs.select("run_id", "pipeline_status", number.alias("quarantined"))

