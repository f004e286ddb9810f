"""The profile of a set of stored tables: statistics, keys, duplicates, relationships.

Per table one statistics job, one job for the value counts of its categorical columns; then one
job for the relationships of all tables. What reaches the driver is sized by the number of columns.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.fingerprints import governance_fingerprint, schema_fingerprint
from starmill.operators import profile as P
from starmill.operators.merge import upsert_table
from starmill.operators.relations import discover_foreign_keys
from starmill.sources.files import discover_sources, load_csv
from starmill.sources.files import write_text
from starmill.sources.lake import Lake
from starmill.sources.workdir import materialize

CACHE = "profile_cache"
STATES = "profile_states"  # a folder beside the layers
CACHE_SCHEMA = "fingerprint string, snapshot string, report string, updated_ts timestamp"


def load_sources(spark, folder: str, schemas: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Every CSV of ``folder``, stored as Parquet once: profiling reads column by column."""
    return {
        table: materialize(load_csv(spark, f"{folder}/{name}", (schemas or {}).get(table)), table)
        for table, name in discover_sources(spark, folder).items()
    }


def _table_profile(df: DataFrame, table: str, exact: bool) -> tuple[dict[str, Any], list[str]]:
    rows = P.profile_table(df, table, exact).collect()  # one row per column
    columns: dict[str, dict[str, Any]] = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        columns[r["column"]] = {
            k: r[k] for k in ("dtype", "null_count", "row_count", "null_pct", "distinct_count")
        }
        if r["min_value"] is not None:
            columns[r["column"]]["numeric_stats"] = {
                "min": r["min_value"], "max": r["max_value"], "avg": r["avg"], "stddev": r["stddev"],
            }
    few = P.categorical_columns(df, rows)
    if few:
        counted = P.value_counts(df, few).orderBy("column", "rank").collect()  # <= 25 per column
        for c in few:
            columns[c]["value_counts"] = {r["value"]: r["n"] for r in counted if r["column"] == c}
    keys = [
        c for c, s in columns.items()
        if c.lower().endswith(P.ID_SUFFIX) and not s["null_count"]
        and s["distinct_count"] == s["row_count"]
    ]
    if not exact:  # sketches only nominate keys; the identifier columns decide exactly
        keys = [r["column"] for r in P.identifier_keys(df, table).collect()]
    row_count = rows[0]["row_count"] if rows else df.count()
    return {"table": table, "row_count": row_count, "column_count": len(df.columns), "columns": columns}, keys


def profile_sources(
    tables: Mapping[str, DataFrame], exact: bool = True, output_path: str | None = None,
    contracts: Mapping[str, Any] | None = None,
) -> dict[str, Any]:
    """The whole report; with ``output_path`` also as a JSON file (any file system that Spark
    writes). With ``contracts`` it carries the fingerprint of structure and rules."""
    profiles, keys = {}, {}
    for table, df in tables.items():
        profiles[table], keys[table] = _table_profile(df, table, exact)
    structure = {t: dict(df.dtypes) for t, df in tables.items()}
    report = {
        "fingerprint": schema_fingerprint(structure),
        "candidate_unique_keys": keys,
        # candidate keys have just been found unique: no second count
        "duplicate_keys": dict.fromkeys(tables, 0),
        "referential_integrity": discover_foreign_keys(tables, keys),
        "tables": profiles,
    }
    if contracts is not None:
        report["governance_fingerprint"] = governance_fingerprint(structure, contracts)
    if output_path:
        spark = next(iter(tables.values())).sparkSession
        write_text(spark, output_path, json.dumps(report, indent=2, default=str))
    return report


def condensed(report: Mapping[str, Any], top: int = 5) -> dict[str, Any]:
    """The report with at most ``top`` values per column."""
    short = {**report, "tables": {}}
    for table, profile in report["tables"].items():
        columns = {
            c: {
                **{k: v for k, v in stats.items() if k != "value_counts"},
                **({"top_values": dict(list(stats["value_counts"].items())[:top])}
                   if stats.get("value_counts") else {}),
            }
            for c, stats in profile["columns"].items()
        }
        short["tables"][table] = {**profile, "columns": columns}
    return short


def profile_once(
    lake: Lake, tables: Mapping[str, DataFrame], snapshot: str, at: datetime, exact: bool = True
) -> dict[str, Any]:
    """``profile_sources``, or the stored report if neither the structure nor the ``snapshot``
    (a name for the data's state, such as a batch id) has changed."""
    fingerprint = schema_fingerprint({t: dict(df.dtypes) for t, df in tables.items()})
    stored = lake.read("gold", CACHE) if lake.exists("gold", CACHE) else None
    if stored is not None:
        same = stored.where((F.col("fingerprint") == fingerprint) & (F.col("snapshot") == snapshot))
        hit = same.select("report").first()
        if hit:
            return json.loads(hit["report"])
    report = profile_sources(tables, exact)
    text = json.dumps(report, default=str)
    row = lake.spark.createDataFrame([(fingerprint, snapshot, text, at)], CACHE_SCHEMA)
    upsert_table(lake, row, "gold", CACHE, ["fingerprint", "snapshot"])
    return json.loads(text)


def profile_load(lake: Lake, df: DataFrame, table: str, load: str) -> None:
    """Store what one load contributes to ``table``'s profile, beside the layers. A load that is
    repeated replaces its earlier contribution."""
    state = P.profile_state(df, table).withColumn("load", F.lit(load))
    upsert_table(lake, state, STATES, table, ["table", "load", "column"])


def incremental_profile(lake: Lake, table: str) -> DataFrame:
    """The profile of all stored loads, without reading their rows."""
    return P.merged_profile(lake.read(STATES, table))
