"""The batch load itself, from CSV sources to gold, on the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from starmill.functions.columns import date_key, money
from starmill.operators.asof import asof_join
from starmill.operators.history import first_history
from starmill.operators.keys import surrogate_key
from starmill.plans.load import GoldTable, LoadPlan, SilverTable, run_load
from starmill.sources.files import write_csv
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path
from starmill.suite.contracts import CONTRACT, _ANY
from starmill.suite.cleansing import SILVER_FLAGGED
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query

_TRACKED = ["customer_name", "segment", "balance"]


def _dim_customer(lake: Lake):
    incoming = lake.read("silver", "customers").withColumn("_load_ts", F.col("_silver_load_ts"))
    return first_history(incoming, "customer_id", _TRACKED, "customer_sk")


def _fact_orders(lake: Lake):
    orders = surrogate_key(lake.read("silver", "orders"), ["order_id"], "order_sk", unique=True)
    customers = lake.read("gold", "dim_customer")
    resolved = asof_join(
        orders, customers, "customer_id", "order_ts", "customer_id", "customer_sk", disjoint=True
    )
    return resolved.select(
        "order_sk", "order_id", "customer_sk", "status",
        date_key("order_ts").alias("date_sk"), money("price").alias("price"),
    )


def _run(spark, sf) -> tuple[Lake, dict]:
    folder = fresh_path(spark, "raw")
    sources = {"customers": load(spark, sf, "customers"), "orders": load(spark, sf, "orders_dirty")}
    for name, df in sources.items():
        write_csv(df, f"{folder}/raw_{name}.csv")
    plan = LoadPlan(
        silver=[SilverTable("customers", ["customer_id"]), SilverTable("orders", ["order_id"])],
        gold=lambda at: [
            GoldTable("dim_customer", _dim_customer),
            GoldTable("fact_orders", _fact_orders, ["status"]),
        ],
        contracts={"orders": CONTRACT},
        schemas={
            # text times are read as plain timestamps, as the silver load stamp is
            name: ", ".join(f"{c} {t.replace('_ntz', '')}" for c, t in df.dtypes)
            for name, df in sources.items()
        },
    )
    lake = Lake(spark, fresh_path(spark, "lake"))
    return lake, run_load(spark, folder, lake.root, plan, datetime(2002, 1, 1), "r1")


_ORDERS = sql(f"SELECT * FROM ({SILVER_FLAGGED}) WHERE NOT {_ANY}")


@query(
    "load_layers",
    sql(f"""
        SELECT 'bronze' AS layer, 'customers' AS "table", count(*) AS rows FROM customer
        UNION ALL SELECT 'bronze', 'orders', count(*) FROM {{orders_dirty}}
        UNION ALL SELECT 'silver', 'customers', count(*) FROM customer
        UNION ALL SELECT 'silver', 'orders', count(*) FROM ({_ORDERS})
        UNION ALL SELECT 'quarantine', 'customers', 0
        UNION ALL SELECT 'quarantine', 'orders', count(*) FROM ({SILVER_FLAGGED}) WHERE {_ANY}
        UNION ALL SELECT 'gold', 'dim_customer', count(*) FROM customer
        UNION ALL SELECT 'gold', 'fact_orders', count(*) FROM ({_ORDERS})
        UNION ALL SELECT 'gold', 'run_history', 1"""),
)
def load_layers(spark, sf):
    """Rows of every stored table after a load."""
    lake, _ = _run(spark, sf)
    layers = [
        lake.row_counts(layer).withColumn("layer", F.lit(layer))
        for layer in ("bronze", "silver", "quarantine", "gold")
    ]
    return layers[0].unionByName(layers[1]).unionByName(layers[2]).unionByName(layers[3])


@query(
    "load_end_to_end",
    sql(f"""
        SELECT c.segment, o.status, count(*) AS orders,
               CAST(sum(CAST(o.price AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM ({_ORDERS}) o JOIN {{customers}} c ON c.customer_id = o.customer_id
        GROUP BY c.segment, o.status"""),
)
def load_end_to_end(spark, sf):
    """CSV to gold, then revenue by segment and status from the stored star."""
    lake, _ = _run(spark, sf)
    per_customer = lake.read("gold", "fact_orders").groupBy("customer_sk", "status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("price").alias("revenue")
    )
    segments = lake.read("gold", "dim_customer").select("customer_sk", "segment")
    return per_customer.join(segments, "customer_sk").groupBy("segment", "status").agg(
        F.sum("orders").alias("orders"), F.sum("revenue").cast("double").alias("revenue")
    )
