"""The batch load: raw sources -> bronze -> silver + quarantine -> gold, layer by layer.

Every layer is stored before the next one reads it, so a lost executor repeats one table's step at
most. Only counts and verdicts reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators import cleanse
from starmill.operators.contracts import Validation, summarize_reports
from starmill.operators.runlog import write_log
from starmill.sources.files import MALFORMED, UNCONVERTED, discover_sources, load_csv
from starmill.sources.lake import Lake
from starmill.sources.workdir import materialize, work_scope

GoldBuilder = Callable[[Lake], DataFrame]


@dataclass(frozen=True)
class SilverTable:
    """How one bronze table becomes silver."""

    name: str
    key: Sequence[str]
    yes_no: Sequence[str] = ()
    drop: Sequence[str] = ()


@dataclass(frozen=True)
class GoldTable:
    name: str
    build: GoldBuilder
    partition_by: Sequence[str] = ()


class Promotion:
    """One table's way through trimming, deduplication and its contract.

    The cleaned, deduplicated rows are stored once: the contract's rules, the clean and the
    quarantined half then read files instead of repeating that shuffle.
    """

    def __init__(self, bronze, contract, key, parents, yes_no, drop, newest_first, load_ts, as_of):
        trimmed = cleanse.trim_text(bronze)
        # columns expected to be empty go only if they are
        listed = [c for c in drop if c in trimmed.columns]
        self.dropped = cleanse.empty_columns(trimmed.select(*listed)) if listed else []
        self.not_empty = [c for c in listed if c not in self.dropped]
        trimmed = cleanse.drop_columns(trimmed, self.dropped)
        self.table = (contract or {}).get("table", "")
        self.rows_raw = bronze.count()
        self.staged = materialize(cleanse.newest_per_key(trimmed, key, newest_first), "staged")
        rules = contract or {"table": self.table, "rules": {}}
        self._validation = Validation(self.staged, rules, parents, as_of, stored=True)
        clean = self._validation.clean.drop(UNCONVERTED, MALFORMED)
        clean = cleanse.text_flags_to_boolean(clean, yes_no)
        self.clean = clean.withColumn("_silver_load_ts", load_ts)
        self.quarantined = self._validation.quarantined

    def report(self) -> dict[str, Any]:
        return self._validation.report()

    def audit(self) -> DataFrame:
        """One row: raw rows, rows removed as older copies, promoted, quarantined, blocked."""
        return self._validation.gate().select(
            "table",
            F.lit(self.rows_raw).cast("long").alias("row_count_raw"),
            (F.lit(self.rows_raw) - F.col("row_count")).cast("long").alias("row_count_removed"),
            F.col("row_count").alias("row_count_in"),
            F.col("clean_count").alias("row_count_promoted"),
            F.col("quarantined_count").alias("row_count_quarantined"),
            "promotion_blocked",
        )


def promote(
    bronze: DataFrame,
    contract: Mapping[str, Any] | None,
    key: Sequence[str],
    parents: Mapping[str, DataFrame] | None = None,
    yes_no: Sequence[str] = (),
    drop: Sequence[str] = (),
    newest_first: Sequence[str] = ("_ingestion_ts",),
    load_ts: Column | None = None,
    as_of: str | None = None,
) -> Promotion:
    """Without a contract every row is clean. Text flags turn boolean after the contract, whose
    rules speak about the source's text."""
    load_ts = F.current_timestamp() if load_ts is None else load_ts
    return Promotion(bronze, contract, key, parents, yes_no, drop, newest_first, load_ts, as_of)


def load_bronze(
    lake: Lake,
    folder: str,
    ingestion_ts: Column,
    batch_id: str,
    schemas: Mapping[str, Any] | None = None,
) -> dict[str, int]:
    """Store every CSV of ``folder`` as a bronze table; ``{table: rows}``."""
    rows = {}
    for table, name in discover_sources(lake.spark, folder).items():
        source = load_csv(lake.spark, f"{folder}/{name}", (schemas or {}).get(table))
        lake.overwrite(cleanse.with_load_columns(source, ingestion_ts, batch_id), "bronze", table)
        rows[table] = lake.rows("bronze", table)
    return rows


def load_silver(
    lake: Lake,
    tables: Sequence[SilverTable],
    contracts: Mapping[str, Mapping[str, Any]],
    load_ts: Column,
    as_of: str | None = None,
    fail_fast: bool = False,
) -> dict[str, Any]:
    """Promote in the given order (parents first); stored silver tables serve as parents. Silver
    and quarantine are written even when a table is blocked; ``fail_fast`` then stops."""
    parents: dict[str, DataFrame] = {}
    reports, summary = [], {"tables": {}, "blocked": [], "halted_at": None}
    for table in tables:
        step = promote(
            lake.read("bronze", table.name), contracts.get(table.name), table.key, parents,
            table.yes_no, table.drop, load_ts=load_ts, as_of=as_of,
        )
        report = step.report()
        reports.append({**report, "table": table.name})
        lake.overwrite(step.quarantined, "quarantine", table.name)
        lake.overwrite(step.clean, "silver", table.name)
        parents[table.name] = lake.read("silver", table.name)
        summary["tables"][table.name] = {
            "row_count_raw": step.rows_raw,
            "row_count_removed": step.rows_raw - report["row_count"],
            "row_count_in": report["row_count"],
            "row_count_promoted": report["clean_count"],
            "row_count_quarantined": report["quarantined_count"],
            "promotion_blocked": report["promotion_blocked"],
            "blocking_reason": report["blocking_reason"],
            "kept_columns": step.not_empty,
        }
        if report["promotion_blocked"]:
            summary["blocked"].append(table.name)
            if fail_fast:
                summary["halted_at"] = table.name
                break
    summary["contract_summary"] = summarize_reports(reports)
    return summary


def load_gold(lake: Lake, tables: Sequence[GoldTable]) -> dict[str, int]:
    """Build and store gold tables in order (dimensions before facts); ``{table: rows}``."""
    for table in tables:
        lake.overwrite(table.build(lake), "gold", table.name, table.partition_by)
    return {table.name: lake.rows("gold", table.name) for table in tables}


@dataclass
class LoadPlan:
    """Everything a load needs besides its data."""

    silver: Sequence[SilverTable]
    gold: Callable[[datetime], Sequence[GoldTable]]
    contracts: Mapping[str, Mapping[str, Any]]
    schemas: Mapping[str, Any] = field(default_factory=dict)
    fail_fast: bool = False
    gold_on_blocked: bool = True


def run_load(
    spark: SparkSession, folder: str, root: str, plan: LoadPlan, at: datetime, run_id: str
) -> dict[str, Any]:
    """The whole load at time ``at``; returns the summary and appends a run-history row, also
    when the load raises. Its intermediates are deleted at the end."""
    lake = Lake(spark, root)
    summary: dict[str, Any] = {"run_id": run_id, "bronze": {}, "silver": {}, "gold": {}}
    try:
        with work_scope(spark):
            _run_layers(lake, folder, plan, at, summary)
    except Exception as problem:
        summary["status"] = "failed"
        summary["error"] = f"{type(problem).__name__}: {problem}"
        log_run(lake, summary, at)
        raise
    log_run(lake, summary, at)
    return summary


def _run_layers(
    lake: Lake, folder: str, plan: LoadPlan, at: datetime, summary: dict[str, Any]
) -> None:
    stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp")
    batch = at.strftime("%Y%m%dT%H%M%SZ")
    summary["bronze"] = load_bronze(lake, folder, stamp, batch, plan.schemas)
    silver = load_silver(
        lake, plan.silver, plan.contracts, stamp, at.date().isoformat(), plan.fail_fast
    )
    summary["silver"] = silver
    halted = silver["halted_at"] or (silver["blocked"] and not plan.gold_on_blocked)
    if not halted:
        summary["gold"] = load_gold(lake, plan.gold(at))
    summary["status"] = "halted" if halted else "blocked" if silver["blocked"] else "succeeded"


def log_run(lake: Lake, summary: Mapping[str, Any], at: datetime) -> None:
    """One row of the run history; ``execution_logs`` says where and why a load halted, was
    blocked or failed."""
    silver = summary["silver"]
    tables = silver.get("tables", {})
    why = {
        "halted_at": silver.get("halted_at"),
        "blocking_reasons": {t: v["blocking_reason"] for t, v in tables.items() if v["blocking_reason"]},
        "error": summary.get("error"),
    }
    row = {
        "run_id": summary["run_id"],
        "run_date": at.date(),
        "run_timestamp": at,
        "pipeline_status": summary["status"],
        "failed_scripts": list(silver.get("blocked", [])),
        "execution_logs": json.dumps(why),
        "silver_summary": json.dumps(tables),
        "gold_summary": json.dumps(summary["gold"]),
    }
    write_log(lake, "run_history", [row])
