"""Data products: SELECTs over the stored star."""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.operators.products import STATUS_SCHEMA, Products
from starmill.suite import gold
from starmill.suite.history import customer_versions
from starmill.suite.registry import query

SELECTS = {
    "customer_360": """
        SELECT c.customer_id, c.segment, coalesce(s.total_orders, 0) AS total_orders,
               coalesce(s.cancelled_orders, 0) AS cancelled_orders, s.last_order_sk,
               CAST(s.lifetime_value AS DOUBLE) AS lifetime_value_eur
        FROM (SELECT * FROM dim_customer WHERE is_current) c
        LEFT JOIN (
            SELECT customer_sk, count(*) AS total_orders, max(date_created_sk) AS last_order_sk,
                   count(CASE WHEN is_cancelled THEN 1 END) AS cancelled_orders,
                   sum(CAST(total_price_eur AS DECIMAL(18,2))) AS lifetime_value
            FROM fact_orders GROUP BY customer_sk) s USING (customer_sk)""",
    "profitability": """
        SELECT ch.channel, ch.channel_group, count(*) AS orders,
               CAST(sum(CAST(f.margin_eur AS DECIMAL(18,2))) AS DOUBLE) AS margin_eur,
               CAST(min(CAST(f.margin_eur AS DECIMAL(18,2))) AS DOUBLE) AS least_margin_eur
        FROM dim_channel ch JOIN fact_orders f USING (channel_sk)
        WHERE NOT f.is_cancelled GROUP BY ch.channel, ch.channel_group""",
    "supplier_scorecard": """
        SELECT s.supplier_id, s.supplier_name, count(l.line_sk) AS lines,
               count(CASE WHEN l.is_cancelled THEN 1 END) AS cancelled,
               CAST(sum(CAST(l.margin_eur AS DECIMAL(18,2))) AS DOUBLE) AS margin_eur
        FROM dim_supplier s LEFT JOIN fact_lines l ON l.supplier_sk = s.supplier_sk
        GROUP BY s.supplier_id, s.supplier_name""",
    "margin_by_month": """
        SELECT month_created, count(*) AS orders,
               CAST(sum(CAST(margin_eur AS DECIMAL(18,2))) AS DOUBLE) AS margin_eur
        FROM fact_orders GROUP BY month_created""",
    "cancellation_risk": """
        SELECT c.segment, ch.channel_group, count(*) AS orders,
               count(CASE WHEN f.is_cancelled THEN 1 END) AS cancelled,
               round(count(CASE WHEN f.is_cancelled THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS cancel_rate
        FROM fact_orders f JOIN dim_customer c ON c.customer_sk = f.customer_sk
        JOIN dim_channel ch ON ch.channel_sk = f.channel_sk GROUP BY c.segment, ch.channel_group""",
}
_SALES = ("dim_channel", "dim_customer", "fact_orders")
NEEDS = {"supplier_scorecard": ("dim_supplier", "dim_part", "fact_lines")}
KINDS = {"profitability": "table", "margin_by_month": "table"}

_STAR = f"""WITH dim_customer AS ({customer_versions(2)}), dim_channel AS ({gold.CHANNELS}),
    dim_supplier AS ({gold.SUPPLIERS}), fact_orders AS ({gold.FACT_ORDERS}), fact_lines AS ({gold.FACT_LINES})"""


def _register(name: str) -> None:
    @query(f"product_{name}", f"{_STAR} {SELECTS[name]}")
    def run(spark, sf):
        products = Products(gold.star_lake(spark, sf, NEEDS.get(name, _SALES)))
        status = products.build({"id": name, "sql": SELECTS[name] + ";", "product_type": KINDS.get(name)})
        assert status["status"] == "built", status
        return products.frame(name)


for _name in SELECTS:
    _register(_name)

_DEFINITIONS = [
    *({"id": n, "sql": SELECTS[n], "product_type": KINDS.get(n, "view")} for n in SELECTS),
    {"id": "", "sql": "SELECT 1"},
    {"id": "broken", "sql": "SELECT missing_column FROM fact_orders", "product_type": "table"},
]

_SIZES = f"""
    SELECT 'customer_360' AS id, 'VIEW' AS object_kind, (SELECT count(*) FROM dim_customer WHERE is_current) AS row_count
    UNION ALL SELECT 'profitability', 'TABLE', (SELECT count(*) FROM ({SELECTS['profitability']}))
    UNION ALL SELECT 'supplier_scorecard', 'VIEW', (SELECT count(*) FROM supplier)
    UNION ALL SELECT 'margin_by_month', 'TABLE', (SELECT count(DISTINCT strftime(o_orderdate, '%Y%m')) FROM orders)
    UNION ALL SELECT 'cancellation_risk', 'VIEW', (SELECT count(*) FROM ({SELECTS['cancellation_risk']}))"""


@query(
    "build_product",
    f"""{_STAR} SELECT id, 'built' AS status, 'products.' || id AS target, object_kind, row_count FROM ({_SIZES})
        UNION ALL SELECT '', 'failed', NULL, NULL, NULL
        UNION ALL SELECT 'broken', 'failed', NULL, 'TABLE', NULL""",
)
def build_product(spark, sf):
    products = Products(gold.star_lake(spark, sf, _SALES + NEEDS["supplier_scorecard"]))
    rows = [tuple(products.build(d).values()) for d in _DEFINITIONS]
    return spark.createDataFrame(rows, STATUS_SCHEMA).drop("error")


@query("list_products", f"""{_STAR} SELECT id AS "table", row_count AS rows FROM ({_SIZES})""")
def list_products(spark, sf):
    products = Products(gold.star_lake(spark, sf, _SALES + NEEDS["supplier_scorecard"]))
    for definition in _DEFINITIONS:
        products.build(definition)
    return products.listing()
