"""Bronze and silver queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.operators import cleanse as K
from starmill.plans.load import promote
from starmill.suite.contracts import _ANY, _REASONS, CONTRACT, FLAGGED
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query


@query(
    "bronze_ingest",
    """SELECT *, TIMESTAMP '2002-01-01' AS _ingestion_ts, '20020101T000000Z' AS _batch_id,
              'raw' AS _source_layer FROM customer""",
)
def bronze_ingest(spark, sf):
    ts = F.lit("2002-01-01").cast("timestamp_ntz")
    return K.with_load_columns(load(spark, sf, "customer"), ts, "20020101T000000Z")


@query(
    "clean_trim",
    sql("""SELECT order_id, trim(status) AS status, trim(priority) AS priority, trim(is_rush) AS is_rush,
                  trim(customer_text) AS customer_text FROM {orders_text}"""),
)
def clean_trim(spark, sf):
    return K.trim_text(load(spark, sf, "orders_text")).select(
        "order_id", "status", "priority", "is_rush", "customer_text"
    )


@query(
    "clean_drop_empty",
    sql("SELECT order_id, status, priority, is_rush, customer_text, due_text FROM {orders_text}"),
)
def clean_drop_empty(spark, sf):
    df = load(spark, sf, "orders_text")
    return K.drop_columns(df, K.empty_columns(df))


@query(
    "clean_yn_bool",
    sql("""SELECT order_id, CASE is_rush WHEN 'Y' THEN true WHEN 'N' THEN false END AS is_rush
           FROM {orders_text}"""),
)
def clean_yn_bool(spark, sf):
    df = load(spark, sf, "orders_text").select("order_id", "is_rush")
    return K.text_flags_to_boolean(df, ["is_rush", "absent"])


@query(
    "dedupe_latest",
    sql("""SELECT order_id, customer_id, status, price, _ingestion_ts FROM
             (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY _ingestion_ts DESC) AS r
              FROM {orders_dup}) WHERE r = 1 OR order_id IS NULL"""),
)
def dedupe_latest(spark, sf):
    return K.newest_per_key(load(spark, sf, "orders_dup"), ["order_id"])


@query(
    "dedupe_latest_composite",
    """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                    l_returnflag, l_linestatus) AS r FROM lineitem) WHERE r = 1""",
)
def dedupe_latest_composite(spark, sf):
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    lines = load(spark, sf, "lineitem")
    return K.newest_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"], ties)


# orders: deduplicated first, so its unique rule cannot fail any more
SILVER_FLAGGED = FLAGGED.replace("{orders_dirty}", """(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER
    (PARTITION BY order_id) AS r FROM {orders_dirty}) WHERE r = 1)""")


def _promotion(spark, sf):
    stamp = F.lit("2002-01-01").cast("timestamp_ntz")
    bronze = K.with_load_columns(load(spark, sf, "orders_dirty"), stamp, "b1")
    return promote(
        bronze, CONTRACT, ["order_id"], {"customers": load(spark, sf, "customers")}, load_ts=stamp
    )


@query(
    "silver_promote",
    sql(f"""SELECT order_id, customer_id, trim(status) AS status, price, priority, order_ts, cancelled_ts, note,
                   TIMESTAMP '2002-01-01' AS _ingestion_ts, 'b1' AS _batch_id, 'raw' AS _source_layer,
                   TIMESTAMP '2002-01-01' AS _silver_load_ts
            FROM ({SILVER_FLAGGED}) WHERE NOT {_ANY}"""),
)
def silver_promote(spark, sf):
    return _promotion(spark, sf).clean


@query(
    "silver_quarantine",
    sql(f"SELECT order_id, customer_id, {_REASONS} AS _quarantine_reasons FROM ({SILVER_FLAGGED}) WHERE {_ANY}"),
)
def silver_quarantine(spark, sf):
    return _promotion(spark, sf).quarantined.select("order_id", "customer_id", "_quarantine_reasons")


@query(
    "layer_audit",
    sql(f"""SELECT 'orders' AS "table", (SELECT count(*) FROM {{orders_dirty}}) AS row_count_raw,
                   (SELECT count(*) FROM {{orders_dirty}}) - count(*) AS row_count_removed,
                   count(*) AS row_count_in, count(*) FILTER (NOT {_ANY}) AS row_count_promoted,
                   count(*) FILTER ({_ANY}) AS row_count_quarantined,
                   count(*) FILTER (b_null) > 0 OR count(*) FILTER (b_parent) > 0.01 * count(*) AS promotion_blocked
            FROM ({SILVER_FLAGGED})"""),
)
def layer_audit(spark, sf):
    return _promotion(spark, sf).audit()


@query("no_contract_passthrough", "SELECT c_custkey, c_name, TIMESTAMP '2002-01-01' AS _silver_load_ts FROM customer")
def no_contract_passthrough(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_name")
    stamp = F.lit("2002-01-01").cast("timestamp_ntz")
    return promote(df, None, ["c_custkey"], newest_first=["c_custkey"], load_ts=stamp).clean
