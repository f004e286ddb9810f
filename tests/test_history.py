from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from starmill.operators import history as H
from starmill.operators.history import (
    first_history,
    next_history,
    seen_rows,
    split_business_keys,
    store_history,
)
from starmill.sources.workdir import materialize

SCHEMA = "k int, a string, _load_ts timestamp"
D = [datetime(2020, 1, d) for d in range(1, 6)]


def batch(spark, day, **values):
    return spark.createDataFrame([(int(k[1:]), a, D[day]) for k, a in values.items()], SCHEMA)


def step(history, incoming, **more):
    return materialize(next_history(history, incoming, "k", ["a"], "sk", **more))


def test_three_batches_keep_every_version(spark):
    h = first_history(batch(spark, 0, k1="x", k2="y"), "k", ["a"], "sk")
    h = step(h, batch(spark, 1, k1="x2", k2="y", k3="z"))
    h = step(h, batch(spark, 2, k1="x3", k3="z"))
    start = datetime(1900, 1, 1)
    assert rows(h, "k", "a", "sk", "eff_start_ts", "eff_end_ts", "is_current") == sorted(
        [
            (1, "x", 1, start, D[1], False),
            (1, "x2", 3, D[1], D[2], False),
            (1, "x3", 5, D[2], None, True),
            (2, "y", 2, start, None, True),
            (3, "z", 4, D[1], None, True),
        ],
        key=repr,
    )


def test_unchanged_batch_changes_nothing(spark):
    h = first_history(batch(spark, 0, k1="x", k2=None), "k", ["a"], "sk")
    again = step(h, batch(spark, 1, k1="x", k2=None))
    assert rows(again) == rows(h) and again.columns == h.columns


def test_null_to_value_is_a_change(spark):
    h = first_history(batch(spark, 0, k1=None), "k", ["a"], "sk")
    assert rows(step(h, batch(spark, 1, k1="v")), "a", "is_current") == [("v", True), (None, False)]


def test_missing_keys_stay_current_unless_asked(spark):
    h = first_history(batch(spark, 0, k1="x", k2="y"), "k", ["a"], "sk")
    incoming = batch(spark, 1, k1="x")
    assert step(h, incoming).where("is_current").count() == 2
    closed = step(h, incoming, close_missing_at="2020-01-02 00:00:00")
    assert rows(closed.where("NOT is_current"), "k", "eff_end_ts") == [(2, D[1])]


def test_new_attribute_is_null_in_older_versions(spark):
    h = first_history(batch(spark, 0, k1="x"), "k", ["a"], "sk")
    wider = batch(spark, 1, k1="x2").withColumn("b", F.lit("new"))
    assert rows(step(h, wider), "a", "b") == [("x", None), ("x2", "new")]


def test_intervals_do_not_overlap_or_gap(spark):
    h = first_history(batch(spark, 0, k1="a", k2="a", k3="a"), "k", ["a"], "sk")
    for day, values in ((1, {"k1": "b", "k2": "a"}), (2, {"k1": "b", "k2": "c"}), (3, {"k1": "d", "k9": "e"})):
        h = step(h, batch(spark, day, **values))
    by_key = {}
    for k, s, e, current in rows(h, "k", "eff_start_ts", "eff_end_ts", "is_current"):
        by_key.setdefault(k, []).append((s, e, current))
    for versions in by_key.values():
        versions.sort()
        assert [c for _, _, c in versions] == [False] * (len(versions) - 1) + [True]
        assert all(a[1] == b[0] for a, b in zip(versions, versions[1:]))


def test_rejected_business_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, a string")
    good, bad = split_business_keys(df, "k")
    assert rows(good) == [(1, "a")]
    assert rows(bad) == [(2, "b", "unique_k"), (2, "c", "unique_k"), (None, "d", "not_null")]


# ------------------------------------------------------------------ late batches

KEYS = ["k", "a", "eff_start_ts", "eff_end_ts", "is_current"]


def in_order(spark, batches, days):
    h, log = None, None
    for day in days:
        incoming = batch(spark, day, **batches[day])
        if h is None:
            h = first_history(incoming, "k", ["a"], "sk")
        else:
            h = step(h, incoming, seen=log)
        new = seen_rows(incoming, "k", ["a"])
        log = new if log is None else log.unionByName(new)
        h, log = materialize(h, "h"), materialize(log, "log")
    return h


BATCHES = [
    {"k1": "x", "k2": "y", "k4": None},
    {"k1": "x", "k2": "z", "k3": "n"},  # k1 confirmed
    {"k1": "w", "k2": "z", "k4": "v"},
    {"k1": "x", "k3": "m", "k4": None},  # k1 and k4 come back
    {"k1": "x", "k2": "y", "k3": "n"},
]


@pytest.mark.parametrize("days", [(0, 2, 1, 3, 4), (0, 4, 3, 2, 1), (0, 4, 1, 3, 2), (0, 3, 2, 4, 1)])
def test_batches_in_any_order_give_the_same_history(spark, days):
    expected, found = in_order(spark, BATCHES, range(5)), in_order(spark, BATCHES, days)
    assert rows(found, *KEYS) == rows(expected, *KEYS)
    numbers = [r.sk for r in found.collect()]
    assert len(set(numbers)) == len(numbers)


def test_a_late_row_without_a_log_holds_until_the_next_change(spark):
    h = first_history(batch(spark, 0, k1="a", k2="s"), "k", ["a"], "sk")
    h = step(h, batch(spark, 3, k1="c"))
    before = {r.a: r.sk for r in h.collect()}
    h = step(h, batch(spark, 1, k1="b", k2="s2"))
    start = datetime(1900, 1, 1)
    assert rows(h, *KEYS) == sorted([
        (1, "a", start, D[1], False), (1, "b", D[1], D[3], False), (1, "c", D[3], None, True),
        (2, "s", start, D[1], False), (2, "s2", D[1], None, True)], key=repr)
    after = {r.a: r.sk for r in h.collect()}
    assert all(after[a] == n for a, n in before.items()) and len(set(after.values())) == 5
    h = step(h, batch(spark, 2, k1="c"))  # the same state, known a day earlier
    assert rows(h.where("k = 1"), *KEYS)[1:] == [
        (1, "b", D[1], D[2], False), (1, "c", D[2], None, True)]
    assert h.where("a = 'c'").first().sk == before["c"]


def test_late_rows_see_where_a_key_was_absent(spark):
    h = first_history(batch(spark, 0, k1="a", k2="b"), "k", ["a"], "sk")
    h = step(h, batch(spark, 1, k2="b"), close_missing_at="2020-01-02 00:00:00")
    h = step(h, batch(spark, 4, k1="a2", k2="b2"))
    late = batch(spark, 2, k1="a3").withColumn("b", F.lit("new"))
    h = step(h, late)
    assert rows(h.where("k = 1"), *KEYS, "b") == [
        (1, "a", datetime(1900, 1, 1), D[1], False, None), (1, "a2", D[4], None, True, None),
        (1, "a3", D[2], D[4], False, "new")]


def test_only_late_keys_are_rebuilt(spark):
    h = first_history(batch(spark, 0, **{f"k{i}": "x" for i in range(50)}), "k", ["a"], "sk")
    h = step(h, batch(spark, 3, **{f"k{i}": "y" for i in range(50)}))
    found = H._step(h, batch(spark, 1, k7="z"), "k", ["a"], "sk", "_load_ts", None, None, None)
    assert found.late.count() == 2 and found.rebuilt.count() == 3
    gone, new = found.changes("sk")
    assert gone.count() == 2 and new.count() == 3 and found.whole().count() == 101


def test_stored_history_rewrites_few_files(spark, lake):
    values = {f"k{i}": "x" for i in range(200)}
    first = first_history(batch(spark, 0, **values), "k", ["a"], "sk")
    lake.overwrite(first.repartitionByRange(40, "k"), "gold", "dim")
    before = set(lake.read("gold", "dim").inputFiles())

    def apply(day, **v):
        return store_history(lake, "gold", "dim", batch(spark, day, **v), "k", ["a"], "sk", keep_seen=True)

    apply(2, k5="y", k300="n")
    after = set(lake.read("gold", "dim").inputFiles())
    assert len(before) == 40 and len(before - after) == 1
    apply(1, k5="w")  # late
    apply(3, k5="y")
    dim = lake.read("gold", "dim")
    assert rows(dim.where("k = 5"), *KEYS[1:]) == [
        ("w", D[1], D[2], False), ("x", datetime(1900, 1, 1), D[1], False), ("y", D[2], None, True)]
    assert dim.count() == 203 == lake.rows("gold", "dim") and lake.rows("seen", "dim") == 4
    assert lake.layer_counts(("gold",)).first().tables == 1
