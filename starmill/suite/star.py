"""The test tables' star schema: type 1 and 2 dimensions and three facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.columns import date_key, money, month_key
from starmill.operators.asof import asof_join
from starmill.operators.dims import combination_dim, type1_dim
from starmill.operators.history import first_history, next_history
from starmill.operators.keys import ranged_key
from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize
from starmill.suite.fixtures import load

CUSTOMER_TRACKED = ["customer_name", "segment", "balance"]
PART_TRACKED = ["part_name", "brand", "size", "retail_price", "withdrawn_date"]


def dim_customer(spark, sf, batches: int = 2) -> DataFrame:
    extracts = [load(spark, sf, f"customers_{i}") for i in range(1, batches + 1)]
    history = first_history(extracts[0], "customer_id", CUSTOMER_TRACKED, "customer_sk")
    for extract in extracts[1:]:
        history = materialize(
            next_history(history, extract, "customer_id", CUSTOMER_TRACKED, "customer_sk"), "hist"
        )
    return history


def part_extract(spark, sf, number: int) -> DataFrame:
    raw = load(spark, sf, f"parts_{number}")
    return raw.withColumns(
        {
            "is_withdrawn": F.col("withdrawn_text").isNotNull(),
            "withdrawn_date": F.try_to_timestamp("withdrawn_text").cast("date"),
        }
    ).drop("withdrawn_text")


def dim_part(spark, sf) -> DataFrame:
    history = first_history(part_extract(spark, sf, 1), "part_id", PART_TRACKED, "part_sk")
    second = part_extract(spark, sf, 2)
    return materialize(next_history(history, second, "part_id", PART_TRACKED, "part_sk"), "hist")


def dim_supplier(spark, sf) -> DataFrame:
    columns = {"supplier_id": "supplier_id", "supplier_name": "supplier_name",
               "nation_id": "nation_id", "balance": F.col("balance").cast("double")}
    return type1_dim(load(spark, sf, "suppliers"), "supplier_id", "supplier_sk", columns)


def dim_channel(spark, sf) -> DataFrame:
    return combination_dim(load(spark, sf, "sales"), ["channel", "channel_group"], "channel_sk")


def fact_orders(sales: DataFrame, customers: DataFrame, channels: DataFrame) -> DataFrame:
    # numbered before the joins: they keep every row, and the ranges are then found on the scan
    numbered = ranged_key(sales, ["order_id"], "order_sk")
    resolved = asof_join(
        numbered, customers, "customer_id", "created_ts", "customer_id", "customer_sk", disjoint=True,
        measured=sales, distinct=True,
    )
    resolved = lookup_join(resolved, channels, ["channel", "channel_group"], channels.count(), measured=sales)
    price, cost = money("total_price"), money("total_cost")
    return resolved.select(
        "order_sk", "order_id", "customer_sk", "channel_sk",
        date_key("created_ts").alias("date_created_sk"),
        date_key("confirmed_ts").alias("date_confirmed_sk"),
        date_key("cancelled_ts").alias("date_cancelled_sk"),
        date_key("build_start").alias("build_start_date_sk"),
        date_key("build_end").alias("build_end_date_sk"),
        F.col("cancelled_ts").isNotNull().alias("is_cancelled"),
        F.datediff(F.to_date("build_end"), F.to_date("build_start")).alias("build_days"),
        price.cast("double").alias("total_price_eur"),
        cost.cast("double").alias("total_cost_eur"),
        (price - cost).cast("double").alias("margin_eur"),
        month_key("created_ts").alias("month_created"),
    )


LINE_ORDER = ["order_id", "line_number", "part_id", "created_ts", "quantity", "price",
              "price_currency", "supplier_id", "status", "line_type"]


def fact_lines(lines: DataFrame, suppliers: DataFrame, parts: DataFrame) -> DataFrame:
    numbered = ranged_key(lines, LINE_ORDER, "line_sk")
    supplier_keys = suppliers.select("supplier_id", "supplier_sk")
    known = supplier_keys.count()
    resolved = lookup_join(numbered, supplier_keys, ["supplier_id"], known, measured=lines, distinct=True)
    # a supplier that comes twice leaves lines that differ in its key
    resolved = asof_join(resolved, parts, "part_id", "created_ts", "part_id", "part_sk", disjoint=True,
                         measured=lines, distinct=True)
    rate = money("price_fx_rate", 4)
    price_eur = F.round(money("price") * rate, 2)
    cost_eur = F.round(money("cost"), 2)
    return resolved.select(
        "line_sk", "order_id", "line_number", "supplier_sk", "part_sk", "line_type", "status",
        (F.col("status") == "Cancelled").alias("is_cancelled"),
        date_key("created_ts").alias("date_created_sk"),
        money("price").cast("double").alias("price_original"),
        "price_currency",
        rate.cast("double").alias("price_fx_rate"),
        price_eur.cast("double").alias("price_eur"),
        cost_eur.cast("double").alias("cost_eur"),
        (price_eur - cost_eur).cast("double").alias("margin_eur"),
    )


def fact_slots(slots: DataFrame, parts: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``measured``: a frame with the slots' keys that costs less than the slots to look for hot ones."""
    slots = slots.withColumn("slot_ts", F.col("slot_date").cast("timestamp_ntz"))
    resolved = asof_join(slots, parts, "part_id", "slot_ts", "part_id", "part_sk", disjoint=True, measured=measured)
    used = F.col("allocation") - F.col("actual_available")
    return resolved.select(
        "part_sk",
        date_key("slot_date").alias("date_sk"),
        "allocation",
        "actual_available",
        F.when(F.col("allocation") > 0, F.round(used / F.col("allocation"), 4))
        .alias("utilization_rate"),
    )
