"""Type 2 history and as-of queries.

The oracle derives every version at once: all extracts together, a version starts where the
change hash differs from the key's previous one, and ends where the next one starts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.functions.columns import change_hash
from starmill.operators.asof import asof_join
from starmill.operators.history import first_history, split_business_keys, store_history
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path
from starmill.suite import star
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query


def versions_sql(extracts: list[str], key: str, hashed: str, columns: str, sk: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {e}" for e in extracts)
    return sql(f"""
        SELECT {sk}, {key}, {columns}, row_hash,
               CASE WHEN _load_ts = (SELECT min(_load_ts) FROM ({union})) THEN TIMESTAMP '1900-01-01'
                    ELSE _load_ts END AS eff_start_ts, eff_end_ts, eff_end_ts IS NULL AS is_current
        FROM (SELECT *, lead(_load_ts) OVER (PARTITION BY {key} ORDER BY _load_ts) AS eff_end_ts,
                     row_number() OVER (ORDER BY _load_ts, {key}) AS {sk}
              FROM (SELECT *, lag(row_hash) OVER (PARTITION BY {key} ORDER BY _load_ts) AS previous
                    FROM (SELECT *, {hashed} AS row_hash FROM ({union})))
              WHERE previous IS NULL OR previous <> row_hash)""")


CUSTOMER_HASH = """sha256(concat_ws('||', coalesce(customer_name, 'NULL'), coalesce(segment, 'NULL'),
    coalesce(CAST(balance AS VARCHAR), 'NULL')))"""
PART_HASH = """sha256(concat_ws('||', coalesce(part_name, 'NULL'), coalesce(brand, 'NULL'),
    coalesce(CAST(size AS VARCHAR), 'NULL'), coalesce(CAST(retail_price AS VARCHAR), 'NULL'),
    coalesce(CAST(CAST(withdrawn_text AS DATE) AS VARCHAR), 'NULL')))"""


def customer_versions(batches: int) -> str:
    extracts = [f"{{customers_{i}}}" for i in range(1, batches + 1)]
    return versions_sql(extracts, "customer_id", CUSTOMER_HASH,
                        "customer_name, segment, CAST(balance AS DOUBLE) AS balance", "customer_sk")


def part_versions() -> str:
    return versions_sql(
        ["{parts_1}", "{parts_2}"], "part_id", PART_HASH,
        """part_name, brand, size, CAST(retail_price AS DOUBLE) AS retail_price,
           CAST(withdrawn_text AS DATE) AS withdrawn_date, withdrawn_text IS NOT NULL AS is_withdrawn""",
        "part_sk")


@query(
    "scd2_row_hash",
    sql(f"SELECT customer_id, {CUSTOMER_HASH} AS row_hash FROM {{customers_1}}"),
)
def scd2_row_hash(spark, sf):
    df = load(spark, sf, "customers_1")
    return df.select("customer_id", change_hash(star.CUSTOMER_TRACKED).alias("row_hash"))


def _plain(df):
    return df.withColumn("balance", F.col("balance").cast("double"))


@query("scd2_initial", customer_versions(1))
def scd2_initial(spark, sf):
    return _plain(star.dim_customer(spark, sf, 1))


@query("scd2_incremental", customer_versions(2))
def scd2_incremental(spark, sf):
    return _plain(star.dim_customer(spark, sf, 2))


@query("scd2_third_batch", customer_versions(3))
def scd2_third_batch(spark, sf):
    return _plain(star.dim_customer(spark, sf, 3))


@query(
    "scd2_late_batch",
    f"""SELECT customer_id, customer_name, segment, balance, row_hash, eff_start_ts, eff_end_ts, is_current
        FROM ({customer_versions(3)})""",
)
def scd2_late_batch(spark, sf):
    """The second extract arrives last; the stored history is as if it had come in order."""
    lake = Lake(spark, fresh_path(spark, "lake"))
    for number in (1, 3, 2):
        extract = load(spark, sf, f"customers_{number}")
        store_history(lake, "gold", "dim_customer", extract, "customer_id", star.CUSTOMER_TRACKED,
                      "customer_sk", keep_seen=True)
    return _plain(lake.read("gold", "dim_customer")).drop("customer_sk")


@query("dim_scd2_customer", customer_versions(3).replace("SELECT customer_sk,", "SELECT customer_sk, segment || ' ' || customer_name AS full_name,", 1))
def dim_scd2_customer(spark, sf):
    dim = _plain(star.dim_customer(spark, sf, 3))
    return dim.withColumn("full_name", F.concat_ws(" ", "segment", "customer_name"))


@query("dim_scd2_part", part_versions())
def dim_scd2_part(spark, sf):
    return star.dim_part(spark, sf).withColumn("retail_price", F.col("retail_price").cast("double"))


@query(
    "scd2_rejected_keys",
    sql("""SELECT order_id, status, CASE WHEN order_id IS NULL THEN 'not_null' ELSE 'unique_order_id' END
                  AS _quarantine_reasons
           FROM (SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM {orders_dup})
           WHERE order_id IS NULL OR n > 1"""),
)
def scd2_rejected_keys(spark, sf):
    _, rejected = split_business_keys(load(spark, sf, "orders_dup"), "order_id")
    return rejected.select("order_id", "status", "_quarantine_reasons")


_ASOF = f"""
    SELECT o.order_id, o.customer_id, o.created_ts, v.customer_sk
    FROM {sql('{sales}')} o LEFT JOIN ({customer_versions(3)}) v
      ON v.customer_id = o.customer_id AND v.eff_start_ts <= o.created_ts
     AND (v.eff_end_ts IS NULL OR o.created_ts < v.eff_end_ts)"""


def _asof(spark, sf, strategy):
    sales = load(spark, sf, "sales").select("order_id", "customer_id", "created_ts")
    versions = star.dim_customer(spark, sf, 3)
    return asof_join(sales, versions, "customer_id", "created_ts", "customer_id", "customer_sk", strategy,
                     disjoint=True)


@query("asof_join", _ASOF)
def asof_range(spark, sf):
    return _asof(spark, sf, None)


@query("asof_join_merge", _ASOF)
def asof_merge(spark, sf):
    return _asof(spark, sf, "merge")


SEGMENT_REVENUE = f"""
    SELECT v.segment, count(*) AS orders, CAST(sum(CAST(o.total_price AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM {sql('{sales}')} o JOIN ({customer_versions(2)}) v
      ON v.customer_id = o.customer_id AND v.eff_start_ts <= o.created_ts
     AND (v.eff_end_ts IS NULL OR o.created_ts < v.eff_end_ts)
    WHERE o.total_price >= 0 GROUP BY v.segment"""


@query("segment_revenue_as_of", SEGMENT_REVENUE)
def segment_revenue_as_of(spark, sf):
    """Contract on orders, two customer extracts as history, revenue by the segment of the day."""
    from starmill.functions.columns import money
    from starmill.operators.contracts import Validation

    contract = {"table": "sales", "rules": {
        "not_null": {"severity": "hard", "columns": ["order_id", "customer_id"]},
        "range": {"severity": "soft", "checks": {"total_price": {"min": 0, "max": 1e12}}},
        "referential_integrity": {"severity": "hard", "checks": [
            {"column": "customer_id", "parent_table": "customers", "parent_column": "customer_id"}]}}}
    parents = {"customers": load(spark, sf, "customers")}
    sales = Validation(load(spark, sf, "sales"), contract, parents).clean
    versions = star.dim_customer(spark, sf, 2)
    resolved = asof_join(sales, versions, "customer_id", "created_ts", "customer_id", "customer_sk",
                         disjoint=True)
    # the revenue per version is summed first: one row per version meets the dimension
    per_version = resolved.groupBy("customer_sk").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(money("total_price")).alias("revenue")
    )
    return (
        per_version.join(versions.select("customer_sk", "segment"), "customer_sk")
        .groupBy("segment")
        .agg(F.sum("orders").alias("orders"), F.sum("revenue").cast("double").alias("revenue"))
    )
