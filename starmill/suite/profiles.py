"""Profiling queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.operators import profile as P
from starmill.operators import reconcile as R
from starmill.operators import relations as rel
from starmill.plans.profiling import incremental_profile, profile_load
from starmill.plans.profiling import profile_sources as profile_report
from starmill.sources.lake import Lake
from starmill.sources.workdir import fresh_path
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query

RELATED = ("customers", "order_headers", "order_lines", "parts", "suppliers", "nations", "regions")
KEYS = {
    "customers": ["customer_id"],
    "order_headers": ["order_id"],
    "parts": ["part_id"],
    "suppliers": ["supplier_id"],
    "nations": ["nation_id"],
    "regions": ["region_id"],
}
# column -> is numeric; the profiled columns of the oracle
COLUMNS = {
    "orders": {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 0, "o_totalprice": 1,
               "o_orderdate": 0, "o_orderpriority": 0},
    "orders_text": {"order_id": 1, "status": 0, "priority": 0, "is_rush": 0, "customer_text": 0,
                    "due_text": 0, "address2": 0, "address3": 0},
}


def _each(table: str, source: str, select: str) -> str:
    """One oracle SELECT per column, stacked. ``select`` may use {c} and {t}."""
    return " UNION ALL ".join(
        f"SELECT {select.replace('<c>', c).replace('<numeric>', str(n))} FROM {source}"
        for c, n in COLUMNS[table].items()
    )


_NULLS = "sum(CASE WHEN <c> IS NULL OR CAST(<c> AS VARCHAR) = '' THEN 1 ELSE 0 END)"


@query(
    "profile_nulls",
    sql(_each("orders_text", "{orders_text}", f"""
        '<c>' AS "column", CAST({_NULLS} AS BIGINT) AS null_count,
        round(100.0 * {_NULLS} / count(*), 2) AS null_pct, count(*) AS row_count""")),
)
def profile_nulls(spark, sf):
    stats = P.column_statistics(load(spark, sf, "orders_text"), "orders_text")
    return stats.select("column", "null_count", "null_pct", "row_count")


@query(
    "profile_distinct",
    _each("orders", "orders", """'<c>' AS "column", count(DISTINCT <c>) AS distinct_count"""),
)
def profile_distinct(spark, sf):
    return P.distinct_counts(load(spark, sf, "orders"))


def _numeric_oracle(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS VARCHAR) AS min_value,
            CAST(max({c}) AS VARCHAR) AS max_value, round(avg({c}), 4) AS avg,
            round(stddev_samp({c}), 4) AS stddev FROM {table}"""
        for c in columns
    )


@query(
    "profile_numeric",
    _numeric_oracle("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                 "l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
)
def profile_numeric(spark, sf):
    stats = P.column_statistics(load(spark, sf, "lineitem"), "lineitem")
    return stats.where("min_value IS NOT NULL").select(
        "column", "min_value", "max_value", "avg", "stddev"
    )


@query(
    "profile_table",
    _each("orders", "orders", f"""
        'orders' AS "table", '<c>' AS "column", count(*) AS row_count, 6 AS column_count,
        CAST({_NULLS} AS BIGINT) AS null_count, round(100.0 * {_NULLS} / count(*), 2) AS null_pct,
        count(DISTINCT <c>) AS distinct_count,
        CASE WHEN <numeric> = 1 THEN CAST(min(<c>) AS VARCHAR) END AS min_value,
        CASE WHEN <numeric> = 1 THEN CAST(max(<c>) AS VARCHAR) END AS max_value"""),
)
def profile_table(spark, sf):
    return P.profile_table(load(spark, sf, "orders"), "orders").select(
        "table", "column", "row_count", "column_count", "null_count", "null_pct",
        "distinct_count", "min_value", "max_value",
    )


def _value_counts_oracle(columns: dict[str, str], top: int) -> str:
    stacked = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), 'None') AS value, count(*) AS n
            FROM {source} GROUP BY ALL HAVING (SELECT count(DISTINCT {c}) FROM {source}) <= 25"""
        for c, source in columns.items()
    )
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)
               AS INTEGER) AS rank FROM ({stacked})) WHERE rank <= {top}"""


_TEXT_COLUMNS = {c: sql("{orders_text}") for c, n in COLUMNS["orders_text"].items() if not n}


def _value_counts(spark, sf, limit: int) -> DataFrame:
    df = load(spark, sf, "orders_text")
    stats = P.distinct_counts(df).collect()  # one row per column
    return P.value_counts(df, P.categorical_columns(df, stats), limit)


@query("profile_value_counts", _value_counts_oracle(_TEXT_COLUMNS, 25))
def profile_value_counts(spark, sf):
    return _value_counts(spark, sf, P.VALUE_COUNT_LIMIT)


@query("profile_top5", _value_counts_oracle(_TEXT_COLUMNS, 5))
def profile_top5(spark, sf):
    return _value_counts(spark, sf, 5)


def _keys_oracle() -> str:
    candidates = [("customers", "customer_id"), ("customers", "nation_id"),
                  ("order_headers", "order_id"), ("order_headers", "customer_id"),
                  ("order_lines", "order_id"), ("order_lines", "part_id"), ("order_lines", "supplier_id"),
                  ("parts", "part_id"), ("suppliers", "supplier_id"), ("suppliers", "nation_id"),
                  ("nations", "nation_id"), ("nations", "region_id"), ("regions", "region_id")]
    return sql(" UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column" FROM {{{t}}}
            HAVING count(*) = count({c}) AND count(*) = count(DISTINCT {c})"""
        for t, c in candidates
    ))


@query("profile_candidate_keys", _keys_oracle())
def profile_candidate_keys(spark, sf):
    frames = [P.identifier_keys(load(spark, sf, name), name) for name in RELATED]
    return functools.reduce(DataFrame.unionByName, frames)


@query(
    "profile_key_columns",
    """SELECT 'orders' AS "table", 'o_orderkey' AS "column" FROM orders
       HAVING count(*) = count(DISTINCT o_orderkey) AND count(*) = count(o_orderkey)
       UNION ALL SELECT 'orders', 'o_custkey' FROM orders
       HAVING count(*) = count(DISTINCT o_custkey) AND count(*) = count(o_custkey)""",
)
def profile_key_columns(spark, sf):
    """The same rule on a profile that is already there, with another name suffix."""
    return P.candidate_keys(P.profile_table(load(spark, sf, "orders"), "orders"), "key")


@query(
    "duplicate_key_count",
    """SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys,
              count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem""",
)
def duplicate_key_count(spark, sf):
    return P.duplicate_key_count(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "value_sets",
    sql(" UNION ALL ".join(
        f"""SELECT DISTINCT '{t}' AS "table", '{c}' AS "column", 'number' AS kind,
            CAST({c} AS VARCHAR) AS value FROM {{{t}}} WHERE {c} IS NOT NULL"""
        for t, c in (("order_headers", "customer_id"), ("orders_dirty", "customer_id"),
                     ("customers", "customer_id"))
    )),
)
def value_sets(spark, sf):
    sets = [
        rel.value_set(load(spark, sf, t), t, c)
        for t, c in (("order_headers", "customer_id"), ("orders_dirty", "customer_id"),
                     ("customers", "customer_id"))
    ]
    return functools.reduce(DataFrame.unionByName, sets)


_CHILDREN = [("customers", "nation_id"), ("order_headers", "customer_id"), ("order_lines", "order_id"),
             ("order_lines", "part_id"), ("order_lines", "supplier_id"), ("suppliers", "nation_id"),
             ("nations", "region_id")]


def _fk_oracle() -> str:
    """All child/parent pairs by sub-query, name preference in SQL, best pair per child."""
    pairs = []
    for child, column in _CHILDREN:
        for parent, (key,) in KEYS.items():
            if parent == child:
                continue
            pairs.append(f"""
                SELECT '{child}' AS "table", '{column}' AS "column", '{parent}' AS parent_table,
                       '{key}' AS parent_column,
                       (SELECT count(DISTINCT {column}) FROM {{{child}}} WHERE {column} IN
                           (SELECT {key} FROM {{{parent}}}))
                       / (SELECT CAST(count(DISTINCT {column}) AS DOUBLE) FROM {{{child}}}) AS share,
                       (SELECT count(*) FROM {{{child}}} WHERE {column} NOT IN
                           (SELECT {key} FROM {{{parent}}})) AS orphan_count""")
    return sql(f"""
        WITH pairs AS ({" UNION ALL ".join(pairs)}),
        scored AS (SELECT *, share + CASE WHEN "column" = parent_column THEN 0.5 ELSE 0 END
              + CASE WHEN contains(parent_table, replace("column", '_id', ''))
                       OR contains(replace("column", '_id', ''), parent_table) THEN 0.3 ELSE 0 END AS score
            FROM pairs WHERE share >= 0.5),
        ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS runner_up FROM scored
            WINDOW w AS (PARTITION BY "table", "column" ORDER BY score DESC, parent_table, parent_column))
        SELECT "table", "column", parent_table, parent_column,
               round(CAST(share * 100 AS DOUBLE), 2) AS overlap_pct, round(CAST(score AS DOUBLE), 4) AS score,
               round(CAST(runner_up AS DOUBLE), 4) AS runner_up_score, orphan_count
        FROM ranked WHERE r = 1""")


@query("fk_discovery", _fk_oracle())
def fk_discovery(spark, sf):
    tables = {name: load(spark, sf, name) for name in RELATED}
    return rel.foreign_keys(tables, KEYS)


@query(
    "fk_orphans",
    sql("""SELECT count(*) AS orphans FROM {orders_dirty} d WHERE customer_id IS NOT NULL
           AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = d.customer_id)"""),
)
def fk_orphans(spark, sf):
    dirty = load(spark, sf, "orders_dirty")
    return rel.orphan_count(dirty, "customer_id", load(spark, sf, "customers"), "customer_id")


def _sources_oracle() -> str:
    ids = {"customers": ["customer_id", "nation_id"], "order_headers": ["order_id", "customer_id"],
           "order_lines": ["order_id", "part_id", "supplier_id"], "parts": ["part_id"],
           "suppliers": ["supplier_id", "nation_id"], "nations": ["nation_id", "region_id"],
           "regions": ["region_id"]}

    def keys(columns: list[str]) -> str:
        return ", ".join(
            f"CASE WHEN count(*) = count({c}) AND count(*) = count(DISTINCT {c}) THEN '{c}' END" for c in columns
        )

    return sql(" UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS row_count,
                   (SELECT count(*) FROM (DESCRIBE SELECT * FROM {{{t}}})) AS column_count,
                   concat_ws(',', {keys(columns)}) AS keys FROM {{{t}}}"""
        for t, columns in ids.items()
    ))


@query("profile_sources", _sources_oracle())
def profile_sources(spark, sf):
    """The whole report over seven related tables, one line per table."""
    report = profile_report({name: load(spark, sf, name) for name in RELATED})
    lines = [
        (t, p["row_count"], p["column_count"], ",".join(report["candidate_unique_keys"][t]))
        for t, p in report["tables"].items()
    ]
    return spark.createDataFrame(
        lines, "table string, row_count long, column_count long, keys string"
    )


# ---------------------------------------------------------------- contract fitted to the profile

DRAFT = {
    "table": "orders_text",
    "rules": {
        "not_null": {"severity": "hard", "max_fail_rate": 0.0,
                     "columns": ["order_id", "status", "is_rush", "ghost"]},
        "unique": {"severity": "hard", "columns": ["order_id", "phantom"]},
        "range": {"severity": "soft",
                  "checks": {"order_id": {"min": 0, "max": 9}, "due_text": {"min": 0, "max": 1}}},
        "regex": {"severity": "soft", "checks": {"ghost": "x"}},
        "allowed_values": {"severity": "soft", "checks": {"is_rush": ["Y", "N"], "ghost": ["1"]}},
    },
}


@query(
    "contract_reconcile",
    sql("""
        WITH t AS (SELECT * FROM {orders_text}),
        filled AS (SELECT count(*) AS n, count(nullif(status, '')) AS status_n,
                          count(nullif(is_rush, '')) AS rush_n FROM t)
        SELECT 'not_null' AS rule, 'ghost' AS "column", 'drop' AS action, 'unknown column' AS reason
        UNION ALL SELECT 'not_null', 'status', 'drop', 'nullable in the source' FROM filled WHERE status_n < n
        UNION ALL SELECT 'not_null', 'is_rush', 'drop', 'nullable in the source' FROM filled WHERE rush_n < n
        UNION ALL SELECT 'unique', 'phantom', 'drop', 'unknown column'
        UNION ALL SELECT 'range', 'due_text', 'drop', 'not numeric'
        UNION ALL SELECT 'regex', 'ghost', 'drop', 'unknown column'
        UNION ALL SELECT 'regex', '', 'remove', 'no valid columns left'
        UNION ALL SELECT 'allowed_values', 'ghost', 'drop', 'unknown column'
        UNION ALL SELECT 'allowed_values', 'is_rush', 'widen', string_agg(v, ',' ORDER BY v)
            FROM (SELECT DISTINCT is_rush AS v FROM t WHERE is_rush NOT IN ('Y', 'N', '', 'null', 'NULL', 'None'))
            HAVING count(*) > 0"""),
)
def contract_reconcile(spark, sf):
    df = load(spark, sf, "orders_text")
    rows = P.profile_table(df, "orders_text").collect()  # one row per column
    counted = P.value_counts(df, P.categorical_columns(df, rows)).collect()  # at most 25 per column
    profile = {
        r["column"]: {**r.asDict(), "values": [v["value"] for v in counted if v["column"] == r["column"]]}
        for r in rows
    }
    _, changes = R.reconcile(DRAFT, profile)
    return spark.createDataFrame(changes, "rule string, column string, action string, reason string")


_INCREMENTAL = {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 0, "o_totalprice": 1, "late_note": 0}


@query(
    "profile_incremental",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, CAST(count(*) - count({v}) AS BIGINT) AS null_count,
                   {f"CAST(min({v}) AS DOUBLE)" if n else "NULL"} AS least,
                   {f"CAST(max({v}) AS DOUBLE)" if n else "NULL"} AS most,
                   {f"round(avg({v}), 2)" if n else "NULL"} AS mean, TRUE AS distinct_close FROM orders"""
        for c, n in _INCREMENTAL.items()
        for v in [c if c != "late_note" else "CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END"]
    ),
)
def profile_incremental(spark, sf):
    """Three loads, the last with a new column, and a repeated one; states only are merged."""
    lake, orders = Lake(spark, fresh_path(spark, "lake")), load(spark, sf, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    for k in (0, 1, 1, 2):
        rows = orders.where(F.col("o_orderkey") % 3 == k)
        own = rows.select(*columns, *([F.col("o_orderpriority").alias("late_note")] if k == 2 else []))
        profile_load(lake, own, "orders", f"load-{k}")
    note = F.when(F.col("o_orderkey") % 3 == 2, F.col("o_orderpriority")).alias("late_note")
    exact = P.distinct_counts(orders.select(*columns, note)).withColumnRenamed("distinct_count", "exact")
    merged = incremental_profile(lake, "orders").join(exact, "column")
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.03 + 0.5
    return merged.select(
        "column", "row_count", "null_count", F.col("min_value").cast("double").alias("least"),
        F.col("max_value").cast("double").alias("most"), F.round("avg", 2).alias("mean"),
        close.alias("distinct_close"),
    )
