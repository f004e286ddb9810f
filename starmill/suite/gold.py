"""Dimension, key and fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.functions.columns import date_key
from starmill.operators.dims import calendar_of
from starmill.operators.keys import surrogate_key
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path
from starmill.suite import star
from starmill.suite.fixtures import load, sql
from starmill.suite.history import customer_versions, part_versions
from starmill.suite.registry import query

_KEY = "CAST(strftime({c}, '%Y%m%d') AS INTEGER)"


def _key(column: str) -> str:
    return _KEY.replace("{c}", column)


@query(
    "dim_date",
    f"""SELECT {_key('d')} AS date_sk, CAST(d AS DATE) AS full_date, CAST(day(d) AS INTEGER) AS day_of_month,
               CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name,
               CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(month(d) AS INTEGER) AS month_num,
               monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
               CAST(year(d) AS INTEGER) AS year, dayofweek(d) IN (0, 6) AS is_weekend
        FROM (SELECT unnest(generate_series(
                date_trunc('day', (SELECT min(o_orderdate) FROM orders)),
                date_trunc('day', (SELECT max(o_orderdate) FROM orders)), INTERVAL 1 DAY)) AS d)""",
)
def dim_date(spark, sf):
    return calendar_of(load(spark, sf, "orders"), "o_orderdate")


@query("date_key", f"SELECT order_id, {_key('confirmed_ts')} AS date_confirmed_sk FROM {sql('{sales}')}")
def date_key_query(spark, sf):
    sales = load(spark, sf, "sales")
    return sales.select("order_id", date_key("confirmed_ts").alias("date_confirmed_sk"))


@query(
    "surrogate_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey,
              l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS line_sk FROM lineitem""",
)
def surrogate_key_query(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = load(spark, sf, "lineitem").select(*order)
    return surrogate_key(lines, order, "line_sk").drop("l_shipdate", "l_extendedprice")


CHANNELS = f"""SELECT row_number() OVER (ORDER BY channel, channel_group) AS channel_sk, channel, channel_group
    FROM (SELECT DISTINCT channel, channel_group FROM {sql('{sales}')})"""
SUPPLIERS = f"""SELECT row_number() OVER (ORDER BY supplier_id) AS supplier_sk, supplier_id, supplier_name,
    nation_id, CAST(balance AS DOUBLE) AS balance FROM {sql('{suppliers}')}"""


@query("dim_combo", CHANNELS)
def dim_combo(spark, sf):
    return star.dim_channel(spark, sf)


@query("dim_scd1", SUPPLIERS)
def dim_scd1(spark, sf):
    return star.dim_supplier(spark, sf)


_MONEY = "CAST({c} AS DECIMAL(18,2))"


def _money(column: str) -> str:
    return _MONEY.replace("{c}", column)


FACT_ORDERS = f"""
    SELECT row_number() OVER (ORDER BY s.order_id) AS order_sk, s.order_id, v.customer_sk, c.channel_sk,
           {_key('created_ts')} AS date_created_sk, {_key('confirmed_ts')} AS date_confirmed_sk,
           {_key('cancelled_ts')} AS date_cancelled_sk, {_key('build_start')} AS build_start_date_sk,
           {_key('build_end')} AS build_end_date_sk, cancelled_ts IS NOT NULL AS is_cancelled,
           CAST(date_diff('day', CAST(build_start AS DATE), CAST(build_end AS DATE)) AS INTEGER) AS build_days,
           CAST({_money('total_price')} AS DOUBLE) AS total_price_eur,
           CAST({_money('total_cost')} AS DOUBLE) AS total_cost_eur,
           CAST({_money('total_price')} - {_money('total_cost')} AS DOUBLE) AS margin_eur,
           CAST(strftime(created_ts, '%Y%m') AS INTEGER) AS month_created
    FROM {sql('{sales}')} s
    LEFT JOIN ({customer_versions(2)}) v ON v.customer_id = s.customer_id AND v.eff_start_ts <= s.created_ts
         AND (v.eff_end_ts IS NULL OR s.created_ts < v.eff_end_ts)
    LEFT JOIN ({CHANNELS}) c USING (channel, channel_group)"""

_RATE = "CAST(price_fx_rate AS DECIMAL(18,4))"
_EUR = f"round({_money('price')} * {_RATE}, 2)"
FACT_LINES = f"""
    SELECT row_number() OVER (ORDER BY order_id, line_number, l.part_id, created_ts, quantity, price,
               price_currency, l.supplier_id NULLS FIRST, status NULLS FIRST, line_type) AS line_sk,
           order_id, line_number, s.supplier_sk, v.part_sk, line_type, status, status = 'Cancelled' AS is_cancelled,
           {_key('created_ts')} AS date_created_sk, CAST({_money('price')} AS DOUBLE) AS price_original,
           price_currency, CAST({_RATE} AS DOUBLE) AS price_fx_rate, CAST({_EUR} AS DOUBLE) AS price_eur,
           CAST({_money('cost')} AS DOUBLE) AS cost_eur, CAST({_EUR} - {_money('cost')} AS DOUBLE) AS margin_eur
    FROM {sql('{sale_lines}')} l
    LEFT JOIN ({SUPPLIERS}) s ON s.supplier_id = l.supplier_id
    LEFT JOIN ({part_versions()}) v ON v.part_id = l.part_id AND v.eff_start_ts <= l.created_ts
         AND (v.eff_end_ts IS NULL OR l.created_ts < v.eff_end_ts)"""

FACT_SLOTS = f"""
    SELECT v.part_sk, {_key('slot_date')} AS date_sk, allocation, actual_available,
           CASE WHEN allocation > 0 THEN round((allocation - actual_available) / CAST(allocation AS DOUBLE), 4)
           END AS utilization_rate
    FROM {sql('{slots}')} s
    LEFT JOIN ({part_versions()}) v ON v.part_id = s.part_id AND v.eff_start_ts <= s.slot_date
         AND (v.eff_end_ts IS NULL OR s.slot_date < v.eff_end_ts)"""


def orders_fact(spark, sf):
    return star.fact_orders(
        load(spark, sf, "sales"), star.dim_customer(spark, sf, 2), star.dim_channel(spark, sf)
    )


def lines_fact(spark, sf):
    return star.fact_lines(
        load(spark, sf, "sale_lines"), star.dim_supplier(spark, sf), star.dim_part(spark, sf)
    )


def slots_fact(spark, sf):
    # slots are sums over lines: hot parts are looked for in the lines, not by a second aggregation
    return star.fact_slots(load(spark, sf, "slots"), star.dim_part(spark, sf), load(spark, sf, "sale_lines"))


@query("fact_orders", FACT_ORDERS)
def fact_orders(spark, sf):
    return orders_fact(spark, sf)


@query("fact_lines", FACT_LINES)
def fact_lines(spark, sf):
    return lines_fact(spark, sf)


@query("fact_snapshot", FACT_SLOTS)
def fact_snapshot(spark, sf):
    return slots_fact(spark, sf)


_BUILDERS = {
    "dim_date": lambda spark, sf, gold: calendar_of(load(spark, sf, "orders"), "o_orderdate"),
    "dim_channel": lambda spark, sf, gold: star.dim_channel(spark, sf),
    "dim_supplier": lambda spark, sf, gold: star.dim_supplier(spark, sf),
    "dim_customer": lambda spark, sf, gold: star.dim_customer(spark, sf, 2),
    "dim_part": lambda spark, sf, gold: star.dim_part(spark, sf),
    "fact_orders": lambda spark, sf, gold: star.fact_orders(
        load(spark, sf, "sales"), gold("dim_customer"), gold("dim_channel")
    ),
    "fact_lines": lambda spark, sf, gold: star.fact_lines(
        load(spark, sf, "sale_lines"), gold("dim_supplier"), gold("dim_part")
    ),
    "fact_slots": lambda spark, sf, gold: star.fact_slots(
        load(spark, sf, "slots"), gold("dim_part"), load(spark, sf, "sale_lines")
    ),
}
_PARTITIONS = {"fact_orders": ["month_created"], "fact_lines": ["line_type"]}
_FEW = {"fact_lines"}  # two line types


def star_lake(spark, sf, tables=tuple(_BUILDERS)) -> Lake:
    """The named gold tables (dimensions before facts) stored in a fresh lake."""
    lake = Lake(spark, fresh_path(spark, "lake"))
    for name in tables:
        df = _BUILDERS[name](spark, sf, lambda t: lake.read("gold", t))
        lake.overwrite(df, "gold", name, _PARTITIONS.get(name, ()), name in _FEW)
    return lake


@query(
    "gold_row_counts",
    sql(f"""
        SELECT 'dim_date' AS "table", date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS rows FROM orders
        UNION ALL SELECT 'dim_channel', count(*) FROM ({CHANNELS})
        UNION ALL SELECT 'dim_supplier', count(*) FROM supplier
        UNION ALL SELECT 'dim_customer', count(*) FROM ({customer_versions(2)})
        UNION ALL SELECT 'dim_part', count(*) FROM ({part_versions()})
        UNION ALL SELECT 'fact_orders', count(*) FROM orders
        UNION ALL SELECT 'fact_lines', count(*) FROM lineitem
        UNION ALL SELECT 'fact_slots', count(*) FROM {{slots}}"""),
)
def gold_row_counts(spark, sf):
    return star_lake(spark, sf).row_counts("gold")


@query(
    "star_end_to_end",
    f"""WITH f AS ({FACT_ORDERS}), v AS ({customer_versions(2)}), c AS ({CHANNELS})
        SELECT CAST(f.month_created // 100 AS INTEGER) AS year, v.segment, c.channel_group, count(*) AS orders,
               CAST(sum(CAST(f.margin_eur AS DECIMAL(18,2))) AS DOUBLE) AS margin_eur
        FROM f LEFT JOIN v USING (customer_sk) LEFT JOIN c USING (channel_sk)
        GROUP BY ALL""",
)
def star_end_to_end(spark, sf):
    """Dimensions and facts stored, then read back and joined as a report would."""
    lake = star_lake(spark, sf, ("dim_channel", "dim_customer", "fact_orders"))
    per_key = lake.read("gold", "fact_orders").groupBy(
        F.floor(F.col("month_created") / 100).cast("int").alias("year"), "customer_sk", "channel_sk"
    ).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("margin_eur").cast("decimal(18,2)")).alias("margin"),
    )
    customers = lake.read("gold", "dim_customer").select("customer_sk", "segment")
    channels = lake.read("gold", "dim_channel").select("channel_sk", "channel_group")
    return (
        per_key.join(customers, "customer_sk", "left")
        .join(channels, "channel_sk", "left")
        .groupBy("year", "segment", "channel_group")
        .agg(
            F.sum("orders").alias("orders"), F.sum("margin").cast("double").alias("margin_eur")
        )
    )
