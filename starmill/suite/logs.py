"""Reads over append-only logs, on the events table as a run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from starmill.operators import runlog as L
from starmill.suite.fixtures import load, sql
from starmill.suite.registry import query

_LOG = sql("{run_log}")


@query(
    "log_newest",
    f"""SELECT run_id, fingerprint, status, run_ts FROM {_LOG} WHERE status = 'error'
        ORDER BY run_ts DESC, run_id LIMIT 200""",
)
def log_newest(spark, sf):
    return L.newest(load(spark, sf, "run_log"), "run_ts", 200, ["run_id"], status="error").select(
        "run_id", "fingerprint", "status", "run_ts"
    )


@query(
    "log_latest_one",
    f"SELECT run_id, fingerprint, run_ts FROM {_LOG} WHERE fingerprint = '7' ORDER BY run_ts DESC, run_id LIMIT 1",
)
def log_latest_one(spark, sf):
    return L.newest(load(spark, sf, "run_log"), "run_ts", 1, ["run_id"], fingerprint="7").select(
        "run_id", "fingerprint", "run_ts"
    )


@query(
    "log_or_filter",
    f"""SELECT run_id, fingerprint, status, run_ts FROM {_LOG} WHERE status = 'purchase' OR fingerprint = '7'
        ORDER BY run_ts DESC, run_id LIMIT 5""",
)
def log_or_filter(spark, sf):
    log = load(spark, sf, "run_log")
    either = (F.col("status") == "purchase") | (F.col("fingerprint") == "7")
    return L.newest_matching(log, either, "run_ts", 5, ["run_id"]).select(
        "run_id", "fingerprint", "status", "run_ts"
    )


@query(
    "log_latest_per_key",
    f"""SELECT run_id, fingerprint, status, run_ts, seconds FROM (SELECT *, row_number() OVER
        (PARTITION BY fingerprint, status ORDER BY run_ts DESC, run_id) AS r FROM {_LOG}) WHERE r = 1""",
)
def log_latest_per_key(spark, sf):
    latest = L.latest_per_key(
        load(spark, sf, "run_log"), ["fingerprint", "status"], "run_ts", ["run_id"]
    )
    return latest.select("run_id", "fingerprint", "status", "run_ts", "seconds")


@query(
    "log_latest_set",
    f"""SELECT run_id, fingerprint, status, run_ts FROM {_LOG} WHERE fingerprint =
        (SELECT fingerprint FROM {_LOG} ORDER BY run_ts DESC, fingerprint LIMIT 1)""",
)
def log_latest_set(spark, sf):
    return L.latest_set(load(spark, sf, "run_log"), "fingerprint", "run_ts").select(
        "run_id", "fingerprint", "status", "run_ts"
    )


@query(
    "log_exists",
    f"""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS fingerprint,
               CAST(c_custkey AS VARCHAR) IN (SELECT fingerprint FROM {_LOG} WHERE status = 'purchase') AS found
        FROM customer""",
)
def log_exists(spark, sf):
    customers = load(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("fingerprint")
    )
    return L.exists_for(customers, load(spark, sf, "run_log"), ["fingerprint"], status="purchase")


@query(
    "log_filter",
    f"""SELECT run_id, fingerprint, status, run_ts FROM {_LOG}
        WHERE CAST(run_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
          AND status IN ('error', 'click') AND (contains(lower(CAST(run_id AS VARCHAR)), '12')
               OR contains(lower(fingerprint), '12'))""",
)
def log_filter(spark, sf):
    hits = L.search(
        load(spark, sf, "run_log"), "run_ts", "2024-01-05", "2024-01-12",
        {"status": ["error", "click"]}, "12", ["run_id", "fingerprint"],
    )
    return hits.select("run_id", "fingerprint", "status", "run_ts")


@query(
    "log_decision",
    f"""SELECT run_id, resolution, CASE WHEN coalesce(contains(lower(resolution), 'rejected'), false)
               THEN 'rejected' ELSE 'approved' END AS decision FROM {_LOG}""",
)
def log_decision(spark, sf):
    log = load(spark, sf, "run_log").select("run_id", "resolution")
    return log.withColumn("decision", L.decision_from_text("resolution"))


@query(
    "log_run_status",
    f"""SELECT fingerprint, count(*) AS scripts, count(*) FILTER (status = 'error') AS failed,
               CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'failed' ELSE 'succeeded' END AS run_status
        FROM {_LOG} GROUP BY fingerprint""",
)
def log_run_status(spark, sf):
    return L.run_status(
        load(spark, sf, "run_log"), ["fingerprint"], F.col("status") == "error"
    )
