"""Fingerprints of structure and rules, contracts from files, halted loads."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.fingerprints import governance_fingerprint, schema_fingerprint
from starmill.operators.contracts import Validation, load_contracts
from starmill.plans.load import LoadPlan, SilverTable, run_load
from starmill.sources.files import write_csv, write_text
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path
from starmill.suite.fixtures import load
from starmill.suite.registry import query

TABLES = ("nation", "customer", "orders")

_COLUMNS = """(SELECT table_name AS "table", '[' || string_agg('["' || column_name || '"]', ','
                      ORDER BY ordinal_position) || ']' AS columns
               FROM information_schema.columns WHERE table_name IN ('nation', 'customer', 'orders')
               GROUP BY table_name)"""
_ROWS = """(SELECT 'nation' AS "table", count(*) AS rows FROM nation UNION ALL
            SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)"""


def _counted(spark, sf, fingerprints: dict[str, str]) -> DataFrame:
    """Structure and size side by side: what a repeated profile compares."""
    return functools.reduce(
        DataFrame.unionByName,
        [
            load(spark, sf, t).agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(t).alias("table"), F.lit(f).alias("fingerprint"), "rows"
            )
            for t, f in fingerprints.items()
        ],
    )


@query(
    "schema_fingerprints",
    f"""SELECT "table", sha256('{{"tables":{{"' || "table" || '":' || columns || '}}}}') AS fingerprint, rows
        FROM {_COLUMNS} JOIN {_ROWS} USING ("table")""",
)
def schema_fingerprints(spark, sf):
    return _counted(spark, sf, {t: schema_fingerprint({t: load(spark, sf, t).columns}) for t in TABLES})


CONTRACT = {"table": "orders", "rules": {"not_null": {"severity": "hard", "columns": ["o_orderkey"]}}}
DDL = "CREATE TABLE orders ( o_orderkey BIGINT ) -- key\n;\n;"


@query(
    "governance_fingerprints",
    f"""SELECT "table", sha256('{{"contracts":{{"orders":{{"rules":{{"not_null":{{"columns":["o_orderkey"],'
               || '"severity":"hard"}}}},"table":"orders"}}}},"ddl":["CREATE TABLE orders ( o_orderkey BIGINT )"],'
               || '"tables":{{"' || "table" || '":' || columns || '}}}}') AS fingerprint, rows
        FROM {_COLUMNS} JOIN {_ROWS} USING ("table")""",
)
def governance_fingerprints(spark, sf):
    rules = {"orders": CONTRACT}
    found = {t: governance_fingerprint({t: load(spark, sf, t).columns}, rules, DDL) for t in TABLES}
    return _counted(spark, sf, found)


ORDERS_YAML = """
table: orders
rules:
  allowed_values:
    severity: soft
    checks: {o_orderstatus: [F, O]}
  range:
    severity: hard
    max_fail_rate: 0.9
    checks: {o_totalprice: {min: 0, max: 100000}}
"""
CUSTOMER_YAML = """
table: customer
rules:
  not_null: {severity: hard, columns: [c_custkey, c_name]}
"""


@query(
    "contracts_from_files",
    """SELECT 'orders' AS "table", 'allowed_values[o_orderstatus]' AS rule, 'soft' AS severity,
              count(*) AS row_count, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS bad_count FROM orders
       UNION ALL SELECT 'orders', 'range[o_totalprice]', 'hard', count(*),
              count(*) FILTER (o_totalprice < 0 OR o_totalprice > 100000) FROM orders
       UNION ALL SELECT 'customer', 'not_null', 'hard', count(*),
              count(*) FILTER (c_custkey IS NULL OR c_name IS NULL) FROM customer""",
)
def contracts_from_files(spark, sf):
    """Contracts are YAML files of a folder; those that name no table are passed over."""
    folder = fresh_path(spark, "contracts")
    for name, text in {"orders.yaml": ORDERS_YAML, "customer.yaml": CUSTOMER_YAML,
                       "notes.yaml": "about: nothing", "readme.txt": "table: x"}.items():
        write_text(spark, f"{folder}/{name}", text)
    reports = [
        Validation(load(spark, sf, table), contract).rule_report()
        for table, contract in load_contracts(spark, folder).items()
    ]
    columns = ("table", "rule", "severity", "row_count", "bad_count")
    return functools.reduce(DataFrame.unionByName, reports).select(*columns)


@query(
    "load_halted",
    """SELECT 'halted' AS pipeline_status, 'orders' AS halted_at, b.n AS bronze_customers,
              o.good AS silver_orders, o.bad AS quarantined_orders, CAST(0 AS BIGINT) AS later_tables
       FROM (SELECT count(*) AS n FROM customer) b,
            (SELECT count(*) FILTER (o_orderstatus = 'F') AS good,
                    count(*) FILTER (o_orderstatus <> 'F') AS bad FROM orders) o""",
)
def load_halted(spark, sf):
    """A blocked table ends a load that fails fast: its halves are stored, later tables are not."""
    folder = fresh_path(spark, "raw")
    for table in ("orders", "customer"):
        write_csv(load(spark, sf, table), f"{folder}/raw_{table}.csv")
    contract = {"table": "orders", "rules": {
        "allowed_values": {"severity": "hard", "checks": {"o_orderstatus": ["F"]}}}}
    plan = LoadPlan(
        [SilverTable("orders", ["o_orderkey"]), SilverTable("customer", ["c_custkey"])],
        lambda at: [], {"orders": contract},
        {"orders": "o_orderkey bigint, o_orderstatus string", "customer": "c_custkey bigint"},
        fail_fast=True,
    )
    lake = Lake(spark, fresh_path(spark, "lake"))
    run_load(spark, folder, lake.root, plan, datetime(2002, 1, 1), "r1")
    later = sum(lake.exists(layer, "customer") for layer in ("silver", "quarantine"))
    runs = lake.read("gold", "run_history")
    return runs.select(
        "pipeline_status",
        F.get_json_object("execution_logs", "$.halted_at").alias("halted_at"),
        F.lit(lake.rows("bronze", "customer")).cast("long").alias("bronze_customers"),
        F.lit(lake.rows("silver", "orders")).cast("long").alias("silver_orders"),
        F.lit(lake.rows("quarantine", "orders")).cast("long").alias("quarantined_orders"),
        F.lit(later).cast("long").alias("later_tables"),
    )
