"""Type 2 history: versions per business key with half-open validity.

A version is valid in ``[eff_start_ts, eff_end_ts)``; an open end is NULL. First-load versions
start at a sentinel so that older facts still resolve. Each step returns the whole new history;
store it before applying the next batch. ``store_history`` applies a batch to a stored table and
rewrites only the files that hold a version which ends or moves.

A row whose ``load_ts`` lies before the start of its key's current version, or before a time at which
the log below saw the key, is *late*. Late keys are
re-stitched: all their versions, the late rows and, if there is a log of what earlier batches saw, its
entries are put in order of time; equal neighbours become one version that starts with the first of
them, and every version ends where the next one starts. With the log (``seen_rows``) the
batches after the first may come in any order; without it a batch that confirmed a version has left no
trace, so a late version holds until the next recorded change. Of rows with the same time the one with
the greater change hash counts. Only late keys' versions take part; all others pass through.

Every step first sets aside incoming rows whose key is NULL or repeated in the batch: such a row
would open a second current version. ``on_reject`` receives them; a key's history goes on unchanged.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions.columns import change_hash
from starmill.operators import contracts
from starmill.operators.keys import surrogate_key
from starmill.operators.lookup import complete
from starmill.operators.merge import replace_rows
from starmill.sources.lake import Lake
from starmill.sources.workdir import materialize

FIRST_START = "1900-01-01 00:00:00"
Rejects = Callable[[DataFrame], None]


def split_business_keys(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: a history needs exactly one incoming row per non-NULL key."""
    repeated = materialize(contracts.repeated_keys(df, [key]), "dup")
    missing = contracts.Check("not_null", "_fail_not_null", "hard", 0.0, fails=~complete([key]))
    unique = contracts.Check(
        f"unique[{key}]", f"_fail_unique_{key}", "hard", 0.0, bad_keys=repeated, on=(key,)
    )
    checks = [missing, unique]
    flagged = contracts.flag_rows(df, checks)
    return contracts.clean_rows(flagged, checks), contracts.quarantined_rows(flagged, checks)


@dataclass(frozen=True)
class Batch:
    """The accepted rows of a batch, and the least of their times."""

    rows: DataFrame
    earliest: object


def _accepted(
    df: DataFrame, key: str, load_ts: str, on_reject: Rejects | None, kind: T.DataType | None = None
) -> Batch:
    """One aggregate says whether any row must be set aside and when the batch begins (as ``kind``)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(load_ts).alias("least"))
    twice = F.max(F.when(F.col(key).isNotNull(), F.col("n"))).alias("most")
    nulls = F.count_if(F.col(key).isNull()).alias("nulls")
    least = F.min("least")
    least = least if kind is None else least.try_cast(kind)
    row = counts.agg(twice, nulls, least.alias("least")).first()
    if (row["most"] or 0) <= 1 and not row["nulls"]:
        return Batch(df, row["least"])
    accepted, rejected = split_business_keys(df, key)
    if on_reject is not None:
        on_reject(rejected)
    return Batch(accepted, row["least"])


def _open_versions(df: DataFrame, start: Column, load_ts: str) -> DataFrame:
    ts_type = df.schema[load_ts].dataType
    return df.withColumns(
        {
            "eff_start_ts": start.cast(ts_type),
            "eff_end_ts": F.lit(None).cast(ts_type),
            "is_current": F.lit(True),
        }
    ).drop(load_ts)


def first_history(
    df: DataFrame,
    key: str,
    tracked: Sequence[str],
    sk: str,
    load_ts: str = "_load_ts",
    on_reject: Rejects | None = None,
) -> DataFrame:
    """Every accepted row becomes an open version; keys are numbered in business-key order."""
    hashed = _accepted(df, key, load_ts, on_reject).rows.withColumn("row_hash", change_hash(tracked))
    return _open_versions(surrogate_key(hashed, [key], sk, unique=True), F.lit(FIRST_START), load_ts)


def seen_rows(incoming: DataFrame, key: str, tracked: Sequence[str], load_ts: str = "_load_ts") -> DataFrame:
    """What a batch says about its keys, for the log that makes late batches exact: key, ``seen_ts``
    and ``row_hash``. Append it for every batch, the first included."""
    rows = incoming.where(F.col(key).isNotNull())
    return rows.select(key, F.col(load_ts).alias("seen_ts"), change_hash(tracked).alias("row_hash"))


@dataclass(frozen=True)
class Step:
    """What one batch does to a history, all in the history's columns."""

    past: DataFrame  # closed versions as they were, late keys' left out
    current: DataFrame  # current versions as they were or now ended, late keys' left out
    opened: DataFrame
    late: DataFrame | None = None  # all versions of late keys, as they were ...
    rebuilt: DataFrame | None = None  # ... and as they are now

    def whole(self) -> DataFrame:
        parts = [self.past, self.current, self.opened, *([self.rebuilt] if self.rebuilt else [])]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def changes(self, sk: str) -> tuple[DataFrame, DataFrame]:
        """``(keys of versions that go, rows that come)``."""
        ended = self.current.where(~F.col("is_current"))
        gone, rows = ended.select(sk), ended.unionByName(self.opened, allowMissingColumns=True)
        if self.late is not None:
            gone = gone.unionByName(self.late.select(sk))
            rows = rows.unionByName(self.rebuilt, allowMissingColumns=True)
        return gone, rows


def _step(
    history: DataFrame,
    incoming: DataFrame,
    key: str,
    tracked: Sequence[str],
    sk: str,
    load_ts: str,
    close_missing_at: str | None,
    on_reject: Rejects | None,
    seen: DataFrame | None,
) -> Step:
    current, past = history.where("is_current"), history.where("NOT is_current")
    kind = history.schema["eff_start_ts"].dataType
    batch = _accepted(incoming, key, load_ts, on_reject, kind)
    hashed = batch.rows.withColumn("row_hash", change_hash(tracked))
    known = current.select(
        key, F.col("row_hash").alias("_known"), F.col("eff_start_ts").alias("_since")
    )
    bounds = history.agg(
        F.max(sk).alias("sk"), F.max(F.when(F.col("is_current"), F.col("eff_start_ts"))).alias("newest")
    ).first()
    last, newest = bounds["sk"] or 0, bounds["newest"]
    if seen is not None:
        confirmed = seen.agg(F.max("seen_ts").try_cast(kind)).first()[0]
        if None not in (confirmed, batch.earliest) and batch.earliest < confirmed:
            # a batch from before another one: what was confirmed after it counts as well
            times = seen.groupBy(key).agg(F.max("seen_ts").alias("_confirmed"))
            known = known.join(times, key, "left").select(
                key, "_known", F.greatest("_since", "_confirmed").alias("_since")
            )
            newest = confirmed
    # most batches begin after all that is stored: no row can be late then
    any_late = None not in (newest, batch.earliest) and batch.earliest < newest
    is_late = F.coalesce(F.col(load_ts) < F.col("_since"), F.lit(False)) if any_late else F.lit(False)
    changed = (
        hashed.join(known, key, "left")
        .withColumn("_late", is_late)
        .where(F.col("_known").isNull() | (F.col("row_hash") != F.col("_known")) | F.col("_late"))
        .select(*hashed.columns, "_late")
    )
    numbered = surrogate_key(changed, [key], sk, after=last, unique=True)  # stored
    late_rows = numbered.where("_late").drop("_late")
    opened = _open_versions(numbered.where("NOT _late").drop("_late"), F.col(load_ts), load_ts)
    late = rebuilt = None
    if any_late and not late_rows.isEmpty():
        keys = late_rows.select(key)
        late = materialize(history.join(keys, key, "left_semi"), "late")
        past, current = (df.join(keys, key, "left_anti") for df in (past, current))
        confirmed = None if seen is None else seen.join(keys, key, "left_semi")
        rebuilt = _restitched(late, late_rows, confirmed, key, sk, load_ts, last + numbered.count())
    ended = opened.select(key, F.col("eff_start_ts").alias("_ended"))
    current = current.join(ended, key, "left")
    if close_missing_at is not None:
        # a key that is only among the rejected rows was seen all the same
        found = incoming.select(key).distinct().withColumn("_seen", F.lit(True))
        ts_type = history.schema["eff_start_ts"].dataType
        gone = F.when(F.col("_seen").isNull(), F.lit(close_missing_at).cast(ts_type))
        current = current.join(found, key, "left").withColumn("_ended", F.coalesce("_ended", gone))
    current = current.withColumns(
        {"eff_end_ts": F.col("_ended"), "is_current": F.col("_ended").isNull()}
    ).select(*history.columns)
    return Step(past, current, opened, late, rebuilt)


def _restitched(
    late: DataFrame,
    rows: DataFrame,
    confirmed: DataFrame | None,
    key: str,
    sk: str,
    load_ts: str,
    last: int,
) -> DataFrame:
    """The versions of late keys anew. A version keeps its number if it is still there; new ones have
    the late row's, or one after ``last`` where a confirmed row proves that a version came back."""
    kinds = {f.name: f.dataType for f in late.schema.fields}
    added = [c for c in rows.columns if c not in kinds and c != load_ts]
    fixed = {sk, key, "row_hash", "eff_start_ts", "eff_end_ts", "is_current"}
    attributes = [c for c in (*late.columns, *added) if c not in fixed]

    def observations(df: DataFrame, at: str, known: bool) -> DataFrame:
        have = set(df.columns) if known else set()
        row = F.struct(
            F.lit(1).alias("_row"),
            *[
                (F.col(c) if c in have else F.lit(None)).cast(kinds.get(c) or rows.schema[c].dataType)
                .alias(c) for c in attributes
            ],
        )
        number = F.col(sk) if known else F.lit(None)
        return df.select(
            key,
            F.col(at).cast(kinds["eff_start_ts"]).alias("_at"),
            F.col("row_hash").alias("_hash"),
            number.cast(kinds[sk]).alias("_sk"),
            (row if known else F.when(F.lit(False), row)).alias("_values"),
        )

    by_start = Window.partitionBy(key).orderBy("eff_start_ts")
    following = late.withColumn("_next", F.lead("eff_start_ts").over(by_start))
    # where a version was closed without a successor the key was absent: a state like others
    absent = following.where("eff_end_ts IS NOT NULL AND (_next IS NULL OR eff_end_ts < _next)")
    absent = absent.withColumn("row_hash", F.lit(None).cast("string"))
    every = observations(late, "eff_start_ts", True)
    every = every.unionByName(observations(absent, "eff_end_ts", False))
    every = every.unionByName(observations(rows, load_ts, True))
    if confirmed is not None:
        every = every.unionByName(observations(confirmed, "seen_ts", False))
    of_hash = Window.partitionBy(key, "_hash")
    every = every.withColumn("_values", F.first("_values", ignorenulls=True).over(of_hash))
    # a logged row that no stored or incoming version explains was replaced by a greater hash
    every = every.where(F.col("_hash").isNull() | F.col("_values").isNotNull())
    at_once = Window.partitionBy(key, "_at").orderBy(F.col("_hash").desc_nulls_last(), F.col("_sk").asc_nulls_last())
    states = every.withColumn("_rank", F.row_number().over(at_once)).where("_rank = 1")
    in_order = Window.partitionBy(key).orderBy("_at")
    same = F.col("_hash").eqNullSafe(F.lag("_hash").over(in_order)) & (F.row_number().over(in_order) > 1)
    runs = states.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(in_order)
    )
    versions = runs.groupBy(key, "_run").agg(
        F.min("_at").alias("eff_start_ts"),
        F.min("_sk").alias("_sk"),
        F.first("_hash").alias("row_hash"),
        F.first("_values").alias("_values"),
    )
    end = F.lead("eff_start_ts").over(Window.partitionBy(key).orderBy("_run"))
    versions = versions.withColumn("eff_end_ts", end).where("row_hash IS NOT NULL")
    versions = materialize(versions.withColumn("is_current", F.col("eff_end_ts").isNull()), "stitched")
    numbered = versions.where("_sk IS NOT NULL").withColumn(sk, F.col("_sk"))
    returned = versions.where("_sk IS NULL")
    if not returned.isEmpty():
        fresh = surrogate_key(returned, [key, "_run"], sk, after=last, unique=True)
        numbered = numbered.unionByName(fresh.withColumn(sk, F.col(sk).cast(kinds[sk])))
    columns = [c for c in (*late.columns, *added)]
    return numbered.select("*", *[F.col(f"_values.{c}").alias(c) for c in attributes]).select(*columns)


def next_history(
    history: DataFrame,
    incoming: DataFrame,
    key: str,
    tracked: Sequence[str],
    sk: str,
    load_ts: str = "_load_ts",
    close_missing_at: str | None = None,
    on_reject: Rejects | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Apply one batch: changed keys get their current version closed at the row's ``load_ts``
    and a new one opened there; unseen keys are opened; late rows are placed by their time (``seen``:
    the log of ``seen_rows``); everything else passes through, earlier closed versions included. With
    ``close_missing_at`` keys absent from the batch are closed at that time (by default they stay
    current); such a key may come back at that time or later.

    Closed versions of keys without a late row take no part in any join. New versions are numbered
    after the greatest key.
    """
    return _step(
        history, incoming, key, tracked, sk, load_ts, close_missing_at, on_reject, seen
    ).whole()


def store_history(
    lake: Lake,
    layer: str,
    table: str,
    incoming: DataFrame,
    key: str,
    tracked: Sequence[str],
    sk: str,
    load_ts: str = "_load_ts",
    on_reject: Rejects | None = None,
    keep_seen: bool = False,
) -> str:
    """Apply one batch to a stored history (created if absent). Files in which no version ends or
    moves are kept as they are. With ``keep_seen`` the log of the batches is kept beside the
    table, in the layer ``seen``, and late batches are exact."""
    base = lake.snapshot(layer, table)
    if base is None:
        first = first_history(incoming, key, tracked, sk, load_ts, on_reject)
        path = lake.overwrite(first, layer, table)
    else:
        stored = lake.frame(layer, table, base)
        seen = lake.read("seen", table) if keep_seen and lake.exists("seen", table) else None
        step = _step(stored, incoming, key, tracked, sk, load_ts, None, on_reject, seen)
        gone, rows = step.changes(sk)
        path = replace_rows(lake, layer, table, base, gone, rows, [sk])
    if keep_seen:
        lake.append(seen_rows(incoming, key, tracked, load_ts), "seen", table)
    return path


def history_after(
    lake: Lake, table: str, incoming: DataFrame, key: str, tracked: Sequence[str], sk: str
) -> DataFrame:
    """The stored gold history with the batch applied, or the first one if there is none. Rows
    set aside become the quarantine table ``<table>_keys``."""

    def keep(rejected: DataFrame) -> None:
        lake.overwrite(rejected, "quarantine", f"{table}_keys")

    if lake.exists("gold", table):
        stored = lake.read("gold", table)
        return next_history(stored, incoming, key, tracked, sk, on_reject=keep)
    return first_history(incoming, key, tracked, sk, on_reject=keep)
