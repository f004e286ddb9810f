"""The shipyard builders themselves, on the test tables dressed as the six silver sources.

Two batches of buyers and vessels are loaded one after the other; the facts then resolve their
keys as of the event. The oracles derive everything from the fixtures in one statement.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.plans import shipyard
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path
from starmill.suite.fixtures import load, sql
from starmill.suite.history import versions_sql
from starmill.suite.registry import query

LOAD_TS = "2002-01-01 00:00:00"


def _lake(spark, sf, *tables) -> Lake:
    """Silver tables, and the gold dimensions after two batches."""
    lake = Lake(spark, fresh_path(spark, "lake"))
    for batch in (1, 2):
        for table, build in (("buyers", shipyard.dim_buyer), ("vessels", shipyard.dim_vessel)):
            lake.overwrite(load(spark, sf, f"sy_{table}_{batch}"), "silver", table)
            lake.overwrite(build(lake), "gold", build.__name__)
    for table in tables:
        lake.overwrite(load(spark, sf, f"sy_{table}"), "silver", table)
    return lake


def _hash(columns: list[str]) -> str:
    return "sha256(concat_ws('||', " + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in columns) + "))"


def _buyers(n: int) -> str:
    return f"""(SELECT external_buyer_id AS buyer_id, forename || ' ' || surname AS full_name,
        _silver_load_ts AS _load_ts, * FROM {{sy_buyers_{n}}})"""


def _vessels(n: int) -> str:
    return f"""(SELECT external_vessel_id AS vessel_id, name AS vessel_name, _silver_load_ts AS _load_ts,
        withdrawn_date IS NOT NULL AS is_withdrawn, CAST(value_tier_start AS DATE) AS value_tier_start_date,
        * REPLACE (CAST(withdrawn_date AS DATE) AS withdrawn_date) FROM {{sy_vessels_{n}}})"""


BUYERS = versions_sql([_buyers(1), _buyers(2)], "buyer_id", _hash(shipyard.BUYER_TRACKED),
                      "email, full_name, marketing_optin", "buyer_sk")
VESSELS = versions_sql([_vessels(1), _vessels(2)], "vessel_id", _hash(shipyard.VESSEL_TRACKED),
                       "vessel_name, value_tier, withdrawn_date, is_withdrawn", "vessel_sk")


@query("shipyard_dim_buyer", BUYERS)
def dim_buyer(spark, sf):
    dim = _lake(spark, sf).read("gold", "dim_buyer")
    return dim.select("buyer_sk", "buyer_id", "email", "full_name", "marketing_optin", "row_hash",
                      "eff_start_ts", "eff_end_ts", "is_current")


@query("shipyard_dim_vessel", VESSELS)
def dim_vessel(spark, sf):
    dim = _lake(spark, sf).read("gold", "dim_vessel")
    return dim.select("vessel_sk", "vessel_id", "vessel_name", "value_tier", "withdrawn_date",
                      "is_withdrawn", "row_hash", "eff_start_ts", "eff_end_ts", "is_current")


def _valid(side: str, key: str, event: str, ts: str) -> str:
    return f"""{side}.{key} = {event} AND {side}.eff_start_ts <= {ts}
        AND ({side}.eff_end_ts IS NULL OR {ts} < {side}.eff_end_ts)"""


def _day(ts: str) -> str:
    return f"CAST(strftime({ts}, '%Y%m%d') AS INTEGER)"


def _cents(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(20,4)), 2) AS DOUBLE)"


@query(
    "shipyard_fact_orders",
    sql(f"""
        SELECT row_number() OVER (ORDER BY external_order_id) AS order_sk, external_order_id AS order_id,
               order_reference, b.buyer_sk, v.vessel_sk, c.channel_sk,
               {_day('created_ts')} AS date_created_sk, {_day('confirmed_ts')} AS date_confirmed_sk,
               {_day('cancelled_ts')} AS date_cancelled_sk, {_day('build_start')} AS build_start_date_sk,
               {_day('build_end')} AS build_end_date_sk, source_system, o.brand, spec_package,
               is_owner_order, cancelled_ts IS NOT NULL AS is_cancelled, cancellation_reason,
               CAST(datediff('day', CAST(build_start AS DATE), CAST(build_end AS DATE)) AS INTEGER) AS build_days,
               crew_officers, crew_ratings, crew_cadets,
               {_cents('total_price')} AS total_price_eur, {_cents('total_cost')} AS total_cost_eur,
               {_cents('CAST(total_price AS DECIMAL(20,4)) - CAST(total_cost AS DECIMAL(20,4))')} AS margin_eur,
               {_cents('finance_fee')} AS finance_fee_eur, {_cents('order_fee')} AS order_fee_eur,
               {_cents('cancellation_fee')} AS cancellation_fee_eur,
               CAST(strftime(created_ts, '%Y%m') AS INTEGER) AS month_created
        FROM {{sy_orders}} o
        LEFT JOIN ({BUYERS}) b ON {_valid('b', 'buyer_id', 'o.external_buyer_id', 'o.created_ts')}
        LEFT JOIN ({VESSELS}) v ON {_valid('v', 'vessel_id', 'o.external_vessel_id', 'o.created_ts')}
        LEFT JOIN (SELECT *, row_number() OVER (ORDER BY sales_channel, channel_group) AS channel_sk
                   FROM (SELECT DISTINCT sales_channel, channel_group FROM {{sy_orders}})) c
          USING (sales_channel, channel_group)"""),
)
def fact_orders(spark, sf):
    lake = _lake(spark, sf, "orders")
    lake.overwrite(shipyard.dim_channel(lake), "gold", "dim_channel")
    return shipyard.fact_orders(lake, F.lit(LOAD_TS)).drop("load_ts")


_EURO = "CAST(round(CAST({0} AS DECIMAL(20,4)) * CAST({0}_fx_rate AS DECIMAL(17,12)), 2) AS DECIMAL(20,2))"
_PRICE, _COST = _EURO.format("price"), _EURO.format("cost")


@query(
    "shipyard_fact_order_lines",
    sql(f"""
        SELECT row_number() OVER (ORDER BY line_reference) AS line_sk, line_reference,
               external_order_id AS order_id, s.subcontractor_sk, v.vessel_sk, line_type, line_name, status,
               status = 'Cancelled' AS is_cancelled, {_day('start_date')} AS start_date_sk,
               {_day('end_date')} AS end_date_sk, {_day('created_ts')} AS date_created_sk,
               {_day('cancelled_ts')} AS date_cancelled_sk, duration_days, sequence AS sequence_no,
               {_cents('price')} AS price_original, price_currency,
               CAST(price_fx_rate AS DOUBLE) AS price_fx_rate, CAST({_PRICE} AS DOUBLE) AS price_eur,
               {_cents('cost')} AS cost_original, cost_currency,
               CAST(cost_fx_rate AS DOUBLE) AS cost_fx_rate, CAST({_COST} AS DOUBLE) AS cost_eur,
               CAST({_PRICE} - {_COST} AS DOUBLE) AS margin_eur
        FROM {{sy_order_lines}} l
        LEFT JOIN (SELECT external_subcontractor_id, row_number() OVER (ORDER BY external_subcontractor_id)
                          AS subcontractor_sk FROM {{sy_subcontractors}}) s USING (external_subcontractor_id)
        LEFT JOIN ({VESSELS}) v ON {_valid('v', 'vessel_id', 'l.external_vessel_id', 'l.created_ts')}"""),
)
def fact_order_lines(spark, sf):
    lake = _lake(spark, sf, "order_lines", "subcontractors")
    lake.overwrite(shipyard.dim_subcontractor(lake), "gold", "dim_subcontractor")
    fact = shipyard.fact_order_lines(lake, F.lit(LOAD_TS)).drop("load_ts", *_CREW)
    return fact.withColumns({c: F.col(c).cast("double") for c in ("price_fx_rate", "cost_fx_rate")})


_CREW = ("crew_officers", "crew_ratings", "crew_cadets")


@query(
    "shipyard_fact_build_slots",
    sql(f"""
        SELECT v.vessel_sk, {_day('slot_date')} AS date_sk, allocation, actual_available,
               CASE WHEN allocation > 0 THEN round((allocation - actual_available) / CAST(allocation AS DOUBLE), 4)
               END AS utilization_rate, CAST(strftime(slot_date, '%Y%m') AS INTEGER) AS month
        FROM {{sy_build_slots}} s
        LEFT JOIN ({VESSELS}) v ON {_valid('v', 'vessel_id', 's.external_vessel_id', 'CAST(s.slot_date AS TIMESTAMP)')}"""),
)
def fact_build_slots(spark, sf):
    """The slots' day is a DATE here: versions that start within a day count from the next."""
    fact = shipyard.fact_build_slots(_lake(spark, sf, "build_slots"), F.lit(LOAD_TS))
    return fact.select("vessel_sk", "date_sk", "allocation", "actual_available", "utilization_rate", "month")
