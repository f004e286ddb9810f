"""Contract queries: each rule kind over the damaged orders, then split, report, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.operators import contracts as C
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query

RULES = {
    "not_null": {"severity": "hard", "max_fail_rate": 0.0,
                 "columns": ["order_id", "customer_id", "price", "not_a_column"]},
    "unique": {"severity": "hard", "max_fail_rate": 0.05, "columns": ["order_id"]},
    "allowed_values": {"severity": "soft", "max_fail_rate": 0.02, "checks": {"status": ["F", "O", "P"]}},
    "range": {"severity": "soft", "max_fail_rate": 0.01, "checks": {"price": {"min": 0, "max": 400000}}},
    "regex": {"severity": "soft", "max_fail_rate": 0.0, "checks": {"priority": "^[1-5]-"}},
    "consistency": {"severity": "soft", "max_fail_rate": 0.02, "checks": [
        {"name": "cancelled_after_order", "expression": "cancelled_ts >= order_ts"},
        {"name": "cancelled_is_final", "expression": "cancelled_ts IS NULL OR status = 'F'"}]},
    "referential_integrity": {"severity": "hard", "max_fail_rate": 0.01, "checks": [
        {"column": "customer_id", "parent_table": "customers", "parent_column": "customer_id"},
        {"column": "order_id", "parent_table": "shipments", "parent_column": "order_id"}]},
    "not_null_conditional": {"severity": "soft", "max_fail_rate": 0.0, "checks": [
        {"column": "note", "when": "status = 'X'"}]},
}
CONTRACT = {"table": "orders", "rules": RULES}

# One row per order line of the damaged table, each rule written out by hand.
FLAGGED = """
    SELECT d.*,
      order_id IS NULL OR customer_id IS NULL OR price IS NULL AS b_null,
      count(*) OVER (PARTITION BY order_id) > 1 AS b_unique,
      coalesce(status NOT IN ('F', 'O', 'P'), false) AS b_status,
      coalesce(price < 0 OR price > 400000, false) AS b_price,
      coalesce(NOT regexp_matches(priority, '^[1-5]-'), false) AS b_priority,
      coalesce(cancelled_ts < order_ts, false) AS b_after,
      coalesce(cancelled_ts IS NOT NULL AND status <> 'F', false) AS b_final,
      customer_id IS NULL OR customer_id NOT IN (SELECT c_custkey FROM customer) AS b_parent,
      coalesce(status = 'X', false) AND note IS NULL AS b_note
    FROM {orders_dirty} d"""
_REASONS = """concat_ws(';', CASE WHEN b_null THEN 'not_null' END, CASE WHEN b_unique THEN 'unique_order_id' END,
    CASE WHEN b_status THEN 'allowed_status' END, CASE WHEN b_price THEN 'range_price' END,
    CASE WHEN b_priority THEN 'regex_priority' END,
    CASE WHEN b_after THEN 'consistency_cancelled_after_order' END,
    CASE WHEN b_final THEN 'consistency_cancelled_is_final' END,
    CASE WHEN b_parent THEN 'ri_customer_id' END, CASE WHEN b_note THEN 'not_null_when_note' END)"""
_ANY = "(b_null OR b_unique OR b_status OR b_price OR b_priority OR b_after OR b_final OR b_parent OR b_note)"


def _parents(spark, sf):
    return {"customers": load(spark, sf, "customers")}


def _validation(spark, sf, *kinds: str) -> C.Validation:
    rules = {k: RULES[k] for k in kinds} if kinds else RULES
    contract = {"table": "orders", "rules": rules}
    return C.Validation(load(spark, sf, "orders_dirty"), contract, _parents(spark, sf))


def _single(name: str, kind: str, reason: str, condition: str) -> None:
    """A query with one rule kind: the failing rows and their reason."""

    @query(name, sql(f"SELECT order_id, customer_id, {reason} AS _quarantine_reasons FROM ({FLAGGED}) WHERE {condition}"))
    def run(spark, sf):
        return _validation(spark, sf, kind).quarantined.select("order_id", "customer_id", C.REASONS)


_single("dq_not_null", "not_null", "'not_null'", "b_null")
_single("dq_unique", "unique", "'unique_order_id'", "b_unique")
_single("dq_allowed_values", "allowed_values", "'allowed_status'", "b_status")
_single("dq_range", "range", "'range_price'", "b_price")
_single("dq_regex", "regex", "'regex_priority'", "b_priority")
_single(
    "dq_consistency", "consistency",
    """concat_ws(';', CASE WHEN b_after THEN 'consistency_cancelled_after_order' END,
        CASE WHEN b_final THEN 'consistency_cancelled_is_final' END)""",
    "b_after OR b_final",
)
_single("dq_referential", "referential_integrity", "'ri_customer_id'", "b_parent")
_single("dq_not_null_conditional", "not_null_conditional", "'not_null_when_note'", "b_note")


@query(
    "dq_referential_nullable",
    sql("""SELECT order_id, customer_id FROM {orders_dirty}
           WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer)"""),
)
def dq_referential_nullable(spark, sf):
    rule = {"severity": "hard", "checks": [{"column": "customer_id", "parent_table": "customers",
                                            "parent_column": "customer_id", "nullable": True}]}
    contract = {"table": "orders", "rules": {"referential_integrity": rule}}
    checked = C.Validation(load(spark, sf, "orders_dirty"), contract, _parents(spark, sf))
    return checked.quarantined.select("order_id", "customer_id")


@query(
    "dq_unique_composite",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              'unique_composite_0' AS _quarantine_reasons
       FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""",
)
def dq_unique_composite(spark, sf):
    rule = {"severity": "hard", "column_sets": [["l_orderkey", "l_linenumber"], ["l_orderkey", "absent"]]}
    contract = {"table": "lineitem", "rules": {"unique_composite": rule}}
    checked = C.Validation(load(spark, sf, "lineitem"), contract)
    return checked.quarantined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", C.REASONS
    )


@query(
    "dq_type_conformance",
    sql("""SELECT order_id, customer_text, due_text,
                  concat_ws(';', CASE WHEN customer_text IS NOT NULL AND TRY_CAST(customer_text AS INTEGER) IS NULL
                                      THEN 'type_customer_text' END,
                                 CASE WHEN due_text IS NOT NULL AND TRY_CAST(due_text AS TIMESTAMP) IS NULL
                                      THEN 'type_due_text' END) AS _quarantine_reasons
           FROM {orders_text}
           WHERE (customer_text IS NOT NULL AND TRY_CAST(customer_text AS INTEGER) IS NULL)
              OR (due_text IS NOT NULL AND TRY_CAST(due_text AS TIMESTAMP) IS NULL)"""),
)
def dq_type_conformance(spark, sf):
    contract = {"table": "orders_text", "schema": {"types": {
        "order_id": "int", "customer_text": "int", "due_text": "timestamp", "status": "string"}}}
    checked = C.Validation(load(spark, sf, "orders_text"), contract)
    return checked.quarantined.select("order_id", "customer_text", "due_text", C.REASONS)


_COLUMNS = "order_id, customer_id, status, price, priority, order_ts, cancelled_ts, note"


@query("dq_clean", sql(f"SELECT {_COLUMNS} FROM ({FLAGGED}) WHERE NOT {_ANY}"))
def dq_clean(spark, sf):
    return _validation(spark, sf).clean


@query(
    "dq_quarantine",
    sql(f"SELECT {_COLUMNS}, {_REASONS} AS _quarantine_reasons FROM ({FLAGGED}) WHERE {_ANY}"),
)
def dq_quarantine(spark, sf):
    return _validation(spark, sf).quarantined


# rule label, severity, allowed rate, flag column ('' = not evaluated)
_LINES = [
    ("not_null", "hard", 0.0, "b_null"),
    ("unique[order_id]", "hard", 0.05, "b_unique"),
    ("allowed_values[status]", "soft", 0.02, "b_status"),
    ("range[price]", "soft", 0.01, "b_price"),
    ("regex[priority]", "soft", 0.0, "b_priority"),
    ("consistency[cancelled_after_order]", "soft", 0.02, "b_after"),
    ("consistency[cancelled_is_final]", "soft", 0.02, "b_final"),
    ("referential_integrity[customer_id->customers]", "hard", 0.01, "b_parent"),
    ("referential_integrity[order_id->shipments]", "hard", 0.01, "false"),
    ("not_null_conditional[note]", "soft", 0.0, "b_note"),
]


def _report_oracle() -> str:
    lines = " UNION ALL ".join(
        f"""SELECT 'orders' AS "table", '{label}' AS rule, '{severity}' AS severity,
            CAST({rate} AS DOUBLE) AS max_fail_rate, '{"skipped" if flag == "false" else "checked"}' AS status,
            count(*) AS row_count, count(*) FILTER ({flag}) AS bad_count,
            round(count(*) FILTER ({flag}) / CAST(count(*) AS DOUBLE), 4) AS fail_rate,
            '{severity}' = 'hard' AND count(*) FILTER ({flag}) / CAST(count(*) AS DOUBLE) > {rate} AS blocked
            FROM f"""
        for label, severity, rate, flag in _LINES
    )
    return sql(f"WITH f AS ({FLAGGED}) {lines}")


@query("dq_rule_report", _report_oracle())
def dq_rule_report(spark, sf):
    return _validation(spark, sf).rule_report()


def _gate_oracle() -> str:
    hard = [(label, rate, flag) for label, severity, rate, flag in _LINES if severity == "hard" and flag != "false"]
    reasons = ", ".join(
        f"""CASE WHEN count(*) FILTER ({flag}) / CAST(count(*) AS DOUBLE) > {rate} THEN
            format('{label} failed {{:.2f}}% (> allowed {rate * 100:.2f}%)',
                   round(count(*) FILTER ({flag}) / CAST(count(*) AS DOUBLE), 4) * 100) END"""
        for label, rate, flag in hard
    )
    text = sql(f"WITH f AS ({FLAGGED}) SELECT ").rstrip() + " "
    return text + f"""'orders' AS "table", count(*) AS row_count, count(*) FILTER (NOT {_ANY}) AS clean_count,
        count(*) FILTER ({_ANY}) AS quarantined_count, concat_ws('; ', {reasons}) <> '' AS promotion_blocked,
        concat_ws('; ', {reasons}) AS blocking_reason FROM f"""


@query("dq_gate", _gate_oracle())
def dq_gate(spark, sf):
    return _validation(spark, sf).gate()


def _lines_contract():
    rule = {"severity": "hard", "max_fail_rate": 0.5, "column_sets": [["l_orderkey", "l_linenumber"]]}
    return {"table": "lineitem", "rules": {"unique_composite": rule}}


@query(
    "dq_summary",
    sql(f"""
        WITH f AS ({FLAGGED}),
        l AS (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS bad FROM lineitem),
        gates AS (
            SELECT count(*) AS rows, count(*) FILTER ({_ANY}) AS bad,
                   count(*) FILTER (b_null) > 0 OR count(*) FILTER (b_unique) > 0.05 * count(*)
                   OR count(*) FILTER (b_parent) > 0.01 * count(*) AS blocked FROM f
            UNION ALL SELECT count(*), count(*) FILTER (bad), count(*) FILTER (bad) > 0.5 * count(*) FROM l)
        SELECT count(*) AS tables_validated, bool_or(blocked) AS any_promotion_blocked,
               CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(bad) AS BIGINT) AS total_quarantined FROM gates"""),
)
def dq_summary(spark, sf):
    lines = C.Validation(load(spark, sf, "lineitem"), _lines_contract())
    return C.summarize_gates([_validation(spark, sf).gate(), lines.gate()])


@query(
    "dq_freshness",
    """SELECT max(ts) AS newest, date_diff('day', CAST(max(ts) AS DATE), DATE '2025-06-01') AS age_days,
              date_diff('day', CAST(max(ts) AS DATE), DATE '2025-06-01') > 400 AS stale FROM events""",
)
def dq_freshness(spark, sf):
    return C.freshness(load(spark, sf, "events"), "ts", 400, "2025-06-01").withColumn(
        "age_days", F.col("age_days").cast("long")
    )
