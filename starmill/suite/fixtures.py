"""Inputs derived from the test tables: renamed columns, deliberate damage, later extracts.

Each fixture is one SELECT that Spark and DuckDB both run, so query and oracle start from the
same rows. ``{name}`` is a test table or another fixture; ``$TS`` the zone-less timestamp type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    # ---------------------------------------------------------------- renamed tables
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id,
               CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_mktsegment AS segment
        FROM {customer}""",
    "order_headers": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
               o_totalprice AS price, o_orderdate AS order_ts, o_orderpriority AS priority
        FROM {orders}""",
    "order_lines": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS part_id,
               l_suppkey AS supplier_id, l_quantity AS quantity, l_extendedprice AS price,
               l_discount AS discount, l_tax AS tax, l_returnflag AS return_flag,
               l_linestatus AS line_status, l_shipdate AS ship_ts
        FROM {lineitem}""",
    "parts": """
        SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, p_type AS part_type,
               p_size AS size, CAST(p_retailprice AS DECIMAL(18,2)) AS retail_price
        FROM {part}""",
    "suppliers": """
        SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey AS nation_id,
               CAST(s_acctbal AS DECIMAL(18,2)) AS balance
        FROM {supplier}""",
    "nations": "SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region_id FROM {nation}",
    "regions": "SELECT r_regionkey AS region_id, r_name AS region_name FROM {region}",
    # ---------------------------------------------------------------- damaged rows
    "orders_dirty": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                    WHEN o_orderkey % 89 = 0 THEN o_custkey + 100000000
                    ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 79 = 0 THEN 'X' ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 83 = 0 THEN -o_totalprice ELSE o_totalprice END AS price,
               CASE WHEN o_orderkey % 61 = 0 THEN 'none' ELSE o_orderpriority END AS priority,
               o_orderdate AS order_ts,
               CASE WHEN o_orderstatus <> 'F' THEN NULL
                    WHEN o_orderkey % 71 = 0 THEN o_orderdate - INTERVAL '1' DAY
                    WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '5' DAY END AS cancelled_ts,
               CASE WHEN o_orderkey % 6 = 0 THEN 'price change' END AS note
        FROM (SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 101 = 0) o""",
    "orders_text": """
        SELECT o_orderkey AS order_id,
               concat('  ', o_orderstatus, ' ') AS status,
               CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(' ', o_orderpriority, '  ') END AS priority,
               CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Y'
                    WHEN o_orderkey % 3 = 1 THEN 'N' ELSE 'maybe' END AS is_rush,
               CASE WHEN o_orderkey % 53 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS customer_text,
               CASE WHEN o_orderkey % 59 = 0 THEN 'soon' WHEN o_orderkey % 5 = 0 THEN NULL
                    ELSE '1999-12-31 10:00:00' END AS due_text,
               CAST(NULL AS STRING) AS address2,
               '' AS address3
        FROM {orders}""",
    "orders_dup": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST('2002-01-01' AS $TS) AS _ingestion_ts
        FROM {orders}
        UNION ALL
        SELECT o_orderkey, o_custkey, 'R', CAST(o_totalprice AS DECIMAL(18,2)) + 1, CAST('2002-02-01' AS $TS)
        FROM {orders} WHERE o_orderkey % 50 = 0
        UNION ALL
        SELECT NULL, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)), CAST('2002-01-01' AS $TS)
        FROM {orders} WHERE o_orderkey % 40 = 0""",
    "orders_changes": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'U' AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) + 10 AS price, CAST('2002-03-01' AS $TS) AS _ingestion_ts
        FROM {orders} WHERE o_orderkey % 20 = 0
        UNION ALL
        SELECT o_orderkey + 100000000, o_custkey, 'N', CAST(o_totalprice AS DECIMAL(18,2)), CAST('2002-03-01' AS $TS)
        FROM {orders} WHERE o_orderkey % 30 = 0""",
    "orders_current": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST('2002-01-01' AS $TS) AS _ingestion_ts
        FROM {orders}""",
    # ---------------------------------------------------------------- successive extracts
    "customers_1": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
               CAST(c_acctbal AS DECIMAL(18,2)) AS balance, CAST('1995-01-01' AS $TS) AS _load_ts
        FROM {customer}""",
    "customers_2": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               CASE WHEN c_custkey % 10 = 0 THEN 'REVISED' ELSE c_mktsegment END AS segment,
               CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END
                    AS DECIMAL(18,2)) AS balance,
               CAST('1998-01-01' AS $TS) AS _load_ts
        FROM {customer}
        UNION ALL
        SELECT c_custkey + 1000000, c_name, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)),
               CAST('1998-01-01' AS $TS)
        FROM {customer} WHERE c_custkey % 25 = 0""",
    "customers_3": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               CASE WHEN c_custkey % 20 = 0 THEN 'FINAL' WHEN c_custkey % 10 = 0 THEN 'REVISED'
                    ELSE c_mktsegment END AS segment,
               CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END
                    AS DECIMAL(18,2)) AS balance,
               CAST('2000-01-01' AS $TS) AS _load_ts
        FROM {customer}
        UNION ALL
        SELECT c_custkey + 1000000, c_name, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)),
               CAST('2000-01-01' AS $TS)
        FROM {customer} WHERE c_custkey % 25 = 0""",
    "parts_1": """
        SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, p_size AS size,
               CAST(p_retailprice AS DECIMAL(18,2)) AS retail_price,
               CASE WHEN p_partkey % 33 = 0 THEN '1999-06-30 00:00:00' END AS withdrawn_text,
               CAST('1995-01-01' AS $TS) AS _load_ts
        FROM {part}""",
    "parts_2": """
        SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, p_size AS size,
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) + CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 0 END
                    AS DECIMAL(18,2)) AS retail_price,
               CASE WHEN p_partkey % 33 = 0 THEN '1999-06-30 00:00:00' END AS withdrawn_text,
               CAST('1999-01-01' AS $TS) AS _load_ts
        FROM {part}""",
    "customers_2_dirty": """
        SELECT * FROM {customers_2}
        UNION ALL SELECT * FROM {customers_2} WHERE customer_id % 13 = 0
        UNION ALL SELECT NULL, customer_name, segment, balance, _load_ts FROM {customers_2}
        WHERE customer_id % 7 = 0""",
    "customers_3_dirty": """
        SELECT * FROM {customers_3}
        UNION ALL SELECT NULL, customer_name, 'LOST', balance, _load_ts FROM {customers_3}
        WHERE customer_id % 11 = 0""",
    "buyer_versions": """
        SELECT o_custkey AS customer_id, 2 * o_custkey AS customer_sk,
               CAST('1900-01-01' AS $TS) AS eff_start_ts,
               min(o_orderdate) + INTERVAL '10' HOUR AS eff_end_ts
        FROM {orders} GROUP BY o_custkey
        UNION ALL
        SELECT o_custkey, 2 * o_custkey + 1, min(o_orderdate) + INTERVAL '10' HOUR, CAST(NULL AS $TS)
        FROM {orders} GROUP BY o_custkey""",
    # ---------------------------------------------------------------- fact inputs
    "sales": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderpriority AS channel,
               o_orderstatus AS channel_group, o_orderdate AS created_ts,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL '2' DAY END AS confirmed_ts,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '5' DAY END AS cancelled_ts,
               o_orderdate + INTERVAL '10' DAY AS build_start,
               CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL '45' DAY END AS build_end,
               o_totalprice AS total_price,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.75 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS total_cost
        FROM {orders}""",
    "sale_lines": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS part_id,
               CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_suppkey END AS supplier_id,
               l_shipdate AS created_ts, l_quantity AS quantity,
               CASE WHEN l_returnflag = 'R' THEN 'Cancelled' WHEN l_returnflag = 'A' THEN 'Delivered' END AS status,
               l_extendedprice AS price,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS cost,
               CASE l_suppkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS price_currency,
               CASE l_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.1725 ELSE 0.9231 END AS price_fx_rate,
               l_linestatus AS line_type
        FROM {lineitem}""",
    "slots": """
        SELECT l_partkey AS part_id, CAST(l_shipdate AS DATE) AS slot_date,
               CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE CAST(sum(l_quantity) AS BIGINT) END AS allocation,
               CASE WHEN l_partkey % 50 = 0 THEN 0
                    ELSE CAST(sum(l_quantity) - sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT)
               END AS actual_available
        FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)""",
    # ---------------------------------------------------------------- silver tables of the shipyard
    "sy_buyers_1": """
        SELECT CAST(customer_id AS STRING) AS external_buyer_id,
               concat('ref', CAST(customer_id AS STRING)) AS buyer_ref, 'ERP' AS source_system,
               CASE WHEN customer_id % 4 <> 0 THEN concat(CAST(customer_id AS STRING), '@a.b') END AS email,
               'Mx' AS title, customer_name AS forename, segment AS surname, '1' AS telephone, '2' AS mobile,
               CAST(balance AS STRING) AS address1, CAST(NULL AS STRING) AS address2, 'Oslo' AS city,
               '0150' AS postcode, 'Norway' AS country, customer_id % 2 = 0 AS marketing_optin,
               _load_ts AS _silver_load_ts
        FROM {customers_1}""",
    "sy_vessels_1": """
        SELECT CAST(part_id AS STRING) AS external_vessel_id, part_name AS name, 'VR' AS vessel_ref,
               'ERP' AS source_system, 'Tug' AS vessel_class, brand, 'Yard' AS address1, 'Oslo' AS city,
               '1' AS postcode, 'R' AS resort, 'A' AS area, 'N' AS region, 'Norway' AS country,
               0 AS miles_from_sea, 'x' AS margin_rate, CAST(retail_price AS STRING) AS value_tier,
               '2022-02-11 00:00:00' AS value_tier_start, part_id % 2 = 0 AS has_helideck,
               part_id % 3 = 0 AS ice_class, size AS deck_count, 3 AS complement, 'good' AS rating,
               'Lease' AS contract_type, withdrawn_text AS withdrawn_date, '2019-11-25' AS date_created,
               '2022-11-14' AS date_live, _load_ts AS _silver_load_ts
        FROM {parts_1}""",
    "sy_buyers_2": """
        SELECT CAST(customer_id AS STRING) AS external_buyer_id,
               concat('ref', CAST(customer_id AS STRING)) AS buyer_ref, 'ERP' AS source_system,
               CASE WHEN customer_id % 4 <> 0 THEN concat(CAST(customer_id AS STRING), '@a.b') END AS email,
               'Mx' AS title, customer_name AS forename, segment AS surname, '1' AS telephone, '2' AS mobile,
               CAST(balance AS STRING) AS address1, CAST(NULL AS STRING) AS address2, 'Oslo' AS city,
               '0150' AS postcode, 'Norway' AS country, customer_id % 2 = 0 AS marketing_optin,
               _load_ts AS _silver_load_ts
        FROM {customers_2}""",
    "sy_vessels_2": """
        SELECT CAST(part_id AS STRING) AS external_vessel_id, part_name AS name, 'VR' AS vessel_ref,
               'ERP' AS source_system, 'Tug' AS vessel_class, brand, 'Yard' AS address1, 'Oslo' AS city,
               '1' AS postcode, 'R' AS resort, 'A' AS area, 'N' AS region, 'Norway' AS country,
               0 AS miles_from_sea, 'x' AS margin_rate, CAST(retail_price AS STRING) AS value_tier,
               '2022-02-11 00:00:00' AS value_tier_start, part_id % 2 = 0 AS has_helideck,
               part_id % 3 = 0 AS ice_class, size AS deck_count, 3 AS complement, 'good' AS rating,
               'Lease' AS contract_type, withdrawn_text AS withdrawn_date, '2019-11-25' AS date_created,
               '2022-11-14' AS date_live, _load_ts AS _silver_load_ts
        FROM {parts_2}""",
    "sy_orders": """
        SELECT CAST(order_id AS STRING) AS external_order_id, concat('O', CAST(order_id AS STRING)) AS order_reference,
               CAST(customer_id AS STRING) AS external_buyer_id,
               CASE WHEN order_id % 10 <> 0 THEN CAST(customer_id AS STRING) END AS external_vessel_id,
               created_ts, confirmed_ts, cancelled_ts, build_start, build_end, channel AS sales_channel,
               channel_group, total_price, total_cost, CASE WHEN order_id % 3 <> 0 THEN 12.345 END AS finance_fee,
               0.005 AS order_fee, CAST(NULL AS DOUBLE) AS cancellation_fee,
               CASE WHEN cancelled_ts IS NOT NULL THEN 'late' END AS cancellation_reason,
               'ERP' AS source_system, 'B' AS brand, 'std' AS spec_package, order_id % 2 = 0 AS is_owner_order,
               1 AS crew_officers, 2 AS crew_ratings, 3 AS crew_cadets
        FROM {sales}""",
    "sy_order_lines": """
        SELECT concat(CAST(order_id AS STRING), '-', CAST(line_number AS STRING), '-', CAST(part_id AS STRING), '-',
                      CAST(coalesce(supplier_id, -1) AS STRING), '-', CAST(created_ts AS STRING)) AS line_reference,
               CAST(order_id AS STRING) AS external_order_id, CAST(part_id AS STRING) AS external_vessel_id,
               CAST(supplier_id AS STRING) AS external_subcontractor_id, max(line_type) AS line_type,
               'part' AS line_name, max(status) AS status, created_ts, created_ts AS start_date,
               CAST(NULL AS $TS) AS end_date, CAST(NULL AS $TS) AS cancelled_ts, 3 AS duration_days,
               line_number AS sequence, max(price) AS price, max(cost) AS cost,
               'GBP' AS price_currency, 1.17254321 AS price_fx_rate, 'IDR' AS cost_currency,
               0.000038456780 AS cost_fx_rate, 1 AS crew_officers, 2 AS crew_ratings, 3 AS crew_cadets
        FROM {sale_lines} GROUP BY order_id, line_number, part_id, supplier_id, created_ts""",
    "sy_subcontractors": """
        SELECT CAST(supplier_id AS STRING) AS external_subcontractor_id, 'SR' AS subcontractor_ref,
               'ERP' AS source_system, 'IACS-1' AS class_society_code, supplier_name AS name, 'a@b.c' AS email,
               '1' AS telephone, 'Mx' AS title, 'A' AS forename, 'B' AS surname, 'Dock' AS address1,
               'Riga' AS city, '1' AS postcode, 'Latvia' AS country, 'SEPA' AS payment_method,
               CAST('1995-01-01' AS $TS) AS _silver_load_ts
        FROM {suppliers}""",
    "sy_build_slots": """
        SELECT CAST(part_id AS STRING) AS external_vessel_id, slot_date, false AS is_closed, allocation,
               1 AS booked_by_buyer, 0 AS booked_by_yard, actual_available, allocation AS potential_available
        FROM {slots}""",
    # ---------------------------------------------------------------- log rows
    "run_log": """
        SELECT event_id AS run_id, CAST(user_id AS STRING) AS fingerprint, event_type AS status, ts AS run_ts,
               value AS seconds,
               CASE WHEN event_id % 9 = 0 THEN 'Rejected by reviewer' WHEN event_id % 4 = 0 THEN NULL
                    ELSE 'accepted' END AS resolution
        FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a fixture as a DataFrame."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name].replace("$TS", "TIMESTAMP_NTZ")
    inputs = {n: load(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    return spark.sql(text, **inputs)


def sql(text: str) -> str:
    """Oracle text: fixture names in braces become sub-selects, tables stay as they are."""

    def expand(match: re.Match) -> str:
        name = match.group(1)
        return f"({sql(FIXTURES[name])})" if name in FIXTURES else name

    return _NAME.sub(expand, text.replace("$TS", "TIMESTAMP"))
