from datetime import datetime

from conftest import rows

from starmill.operators.history import first_history, next_history
from starmill.sources.workdir import materialize

BATCH = [(1, "a"), (1, "b"), (2, "x"), (None, "n")]


def test_rejected_rows_open_no_version(spark):
    kept = []

    def batch(listed, day):
        df = spark.createDataFrame([(k, v, datetime(2024, 1, day)) for k, v in listed],
                                   "id int, v string, _load_ts timestamp")
        return df

    history = first_history(batch(BATCH, 1), "id", ["v"], "sk", on_reject=kept.append)
    history = materialize(history, "hist")
    assert rows(history, "sk", "id", "v", "is_current") == [(1, 2, "x", True)]
    assert rows(kept[0], "id", "v", "_quarantine_reasons") == [
        (1, "a", "unique_id"), (1, "b", "unique_id"), (None, "n", "not_null")]
    again = next_history(history, batch([*BATCH, (3, "new")], 2), "id", ["v"], "sk",
                         close_missing_at="2024-01-02")
    assert rows(again, "sk", "id", "is_current") == [(1, 2, True), (2, 3, True)]
