"""Both as-of strategies give one answer, whatever the types, ties and overlaps."""

import pytest
from conftest import rows

from starmill.operators.asof import asof_join

VERSIONS = [
    ("1", 10, "2020-01-01 00:00:00", "2020-05-01 10:00:00"),
    ("1", 11, "2020-05-01 10:00:00", None),
    ("2", 20, "2020-01-01 00:00:00", "2020-09-01 00:00:00"),  # overlaps the next one
    ("2", 21, "2020-03-01 00:00:00", "2020-04-01 00:00:00"),
    ("3", 30, "2020-01-01 00:00:00", "2020-02-01 00:00:00"),
    ("3", 31, "2020-01-01 00:00:00", None),  # same start: the greater key
    ("4", 40, None, None), (None, 50, "2020-01-01 00:00:00", None),
]
EVENTS = [
    (1, "1", "2020-05-01"), (2, "1", "2020-05-02"), (3, "2", "2020-02-01"), (4, "2", "2020-03-05"),
    (5, "2", "2020-06-01"), (6, "3", "2020-01-15"), (7, "4", "2020-01-15"), (8, None, "2020-01-15"),
    (9, "1", None), (10, "9", "2020-01-15"), (11, "1", "2019-01-01"),
]
EXPECTED = [(1, 10), (2, 11), (3, 20), (4, 21), (5, None), (6, 31), (7, None), (8, None), (9, None),
            (10, None), (11, None)]


@pytest.mark.parametrize("strategy", ["range", "merge"])
@pytest.mark.parametrize("event_time", ["date", "timestamp", "timestamp_ntz", "string"])
@pytest.mark.parametrize("keys", [("string", "int"), ("bigint", "int"), ("int", "decimal(9,2)"),
                                  ("string", "string"), ("double", "bigint")])
def test_type_pairs(spark, strategy, event_time, keys):
    events = spark.createDataFrame(EVENTS, "id int, k string, t string").selectExpr(
        "id", f"CAST(k AS {keys[0]}) AS k", f"CAST(t AS {event_time}) AS t")
    versions = spark.createDataFrame(VERSIONS, "v string, sk int, s string, e string").selectExpr(
        f"CAST(v AS {keys[1]}) AS v", "sk", "CAST(s AS timestamp) AS eff_start_ts",
        "CAST(e AS timestamp) AS eff_end_ts")
    found = asof_join(events, versions, "k", "t", "v", "sk", strategy, salt_from=0)
    assert found.schema["k"] == events.schema["k"] and found.schema["t"] == events.schema["t"]
    assert sorted(rows(found, "id", "sk")) == EXPECTED


def test_text_that_is_no_key_matches_nothing(spark):
    events = spark.createDataFrame([(1, "x7", "2020-06-01"), (2, "1", "no day")], "id int, k string, t string")
    versions = spark.sql("SELECT 1 AS v, 5 AS sk, DATE'2020-01-01' AS eff_start_ts, CAST(NULL AS DATE) AS eff_end_ts")
    for strategy in ("range", "merge"):
        found = asof_join(events, versions, "k", "t", "v", "sk", strategy)
        assert rows(found, "id", "sk") == [(1, None), (2, None)]
