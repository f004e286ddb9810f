"""Append-only run logs and keyed caches: schemas and the reads made on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmill.operators.lookup import lookup_join
from starmill.sources.lake import Lake
from starmill.sources.workdir import materialize

# The log tables' columns.
RUN_HISTORY = (
    "run_id string, run_date date, run_timestamp timestamp, pipeline_status string, "
    "active_agent string, dataset_fingerprint string, failed_scripts array<string>, "
    "execution_logs string, silver_summary string, gold_summary string, final_report string, "
    "approved_steps string, review_comments string"
)
STAGE_REVIEWS = (
    "review_id string, pipeline_run_id string, review_date date, review_timestamp timestamp, "
    "stage_key string, agent_name string, decision string, reviewer_comments string, "
    "dataset_fingerprint string, output_json string"
)
COMPILE_AUDIT = (
    "run_id string, dataset_fingerprint string, script_name string, attempt_number int, "
    "code_source string, code_sha256 string, code_snapshot string, exit_code int, "
    "stdout string, stderr string, timestamp timestamp"
)
DECISIONS = (
    "dataset_name string, issue_type string, anomalous_fields array<string>, "
    "resolution_applied string, human_comments string, decision string, timestamp timestamp"
)


LOGS = {
    "run_history": RUN_HISTORY,
    "stage_reviews": STAGE_REVIEWS,
    "compile_audit": COMPILE_AUDIT,
    "decisions": DECISIONS,
}


def write_log(
    lake: Lake, name: str, rows: Sequence[Mapping[str, Any]], layer: str = "gold"
) -> None:
    """Append rows to one of the typed logs (which this creates); fields that a row lacks are
    NULL, fields that the log lacks are an error. No rows: the log exists afterwards, empty."""
    names = [part.split()[0] for part in LOGS[name].split(", ")]
    unknown = {field for row in rows for field in row} - set(names)
    if unknown:
        raise ValueError(f"{name} has no field {sorted(unknown)}")
    values = [tuple(row.get(n) for n in names) for row in rows]
    lake.append(lake.spark.createDataFrame(values, LOGS[name]), layer, name)


def _equals(equals: dict[str, Any]) -> Column:
    condition = F.lit(True)
    for column, value in equals.items():
        condition = condition & (F.col(column) == F.lit(value))
    return condition


def newest(
    log: DataFrame, ts: str, limit: int, ties: Sequence[str] = (), **equals: Any
) -> DataFrame:
    """The ``limit`` newest rows matching the given values (a per-task top-k, then one merge)."""
    return log.where(_equals(equals)).orderBy(F.col(ts).desc(), *ties).limit(limit)


def newest_matching(
    log: DataFrame, condition: Column, ts: str, limit: int, ties: Sequence[str] = ()
) -> DataFrame:
    return newest(log.where(condition), ts, limit, ties)


def latest_per_key(
    log: DataFrame, key: Sequence[str], ts: str, ties: Sequence[str] = ()
) -> DataFrame:
    """The newest row of each key; the limit is applied in the map tasks too."""
    order = Window.partitionBy(*key).orderBy(F.col(ts).desc(), *ties)
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_set(log: DataFrame, fingerprint: str, ts: str) -> DataFrame:
    """All rows of the fingerprint that was written last. One row decides, so broadcasting it is
    safe; a tie in time goes to the smaller fingerprint."""
    last = log.where(F.col(ts).isNotNull()).orderBy(F.col(ts).desc(), fingerprint).limit(1)
    return log.join(F.broadcast(last.select(fingerprint)), fingerprint, "left_semi")


def exists_for(keys: DataFrame, log: DataFrame, on: Sequence[str], **equals: Any) -> DataFrame:
    """``keys`` plus ``found``: whether the log holds a matching row. The log is reduced to
    distinct keys before the join, so a chatty key is one row."""
    hits = materialize(log.where(_equals(equals)).select(*on).distinct(), "hits")
    joined = lookup_join(keys, hits.withColumn("found", F.lit(True)), on, hits.count())
    return joined.select(*keys.columns, F.coalesce("found", F.lit(False)).alias("found"))


def exists_any(log: DataFrame, **equals: Any) -> bool:
    return not log.where(_equals(equals)).isEmpty()


def search(
    log: DataFrame,
    ts: str,
    first_day: str,
    last_day: str,
    statuses: dict[str, Sequence[str]] | None = None,
    text: str = "",
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """Days (both included), allowed values per column, and a case-insensitive substring found
    in any of ``text_columns``; newest first is left to the caller's ORDER BY."""
    day = F.col(ts).cast("date")
    hits = log.where(day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    for column, values in (statuses or {}).items():
        hits = hits.where(F.col(column).isin(list(values)))
    if text:
        found = F.lit(False)
        for column in text_columns:
            contains = F.lower(F.col(column).cast("string")).contains(text.lower())
            found = found | F.coalesce(contains, F.lit(False))
        hits = hits.where(found)
    return hits


def decision_from_text(column: str) -> Column:
    """Older rows carry the decision only in words."""
    said_no = F.coalesce(F.lower(F.col(column)).contains("rejected"), F.lit(False))
    return F.when(said_no, F.lit("rejected")).otherwise(F.lit("approved"))


def run_status(steps: DataFrame, run: Sequence[str], step_failed: Column) -> DataFrame:
    """Status of each run from its steps: one failed step fails the run."""
    bad = F.coalesce(F.sum(F.when(step_failed, 1).otherwise(0)), F.lit(0)).alias("failed")
    counted = steps.groupBy(*run).agg(F.count(F.lit(1)).alias("scripts"), bad)
    status = F.when(F.col("failed") > 0, F.lit("failed")).otherwise(F.lit("succeeded"))
    return counted.withColumn("run_status", status)
