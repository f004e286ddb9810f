"""Point-in-time key resolution: which version of a dimension row was valid at the event?

Left join semantics: an event without a valid version gets a NULL key, and no event is lost or
doubled. Of the versions that have started, only the last one (by start, then key) is considered,
so where versions of one key overlap, the later start wins. Histories of this library do not overlap;
with ``disjoint`` that is taken as given, and no window over the versions is needed. Two exact strategies with the same
answer, chosen by the depth of the history:

``range``  equi join on the key with both validity bounds as residual. Right while a key has few
           versions; hot event keys are spread (see ``lookup``).
``merge``  events and versions sorted together per key, the last version seen carried forward.
           Linear however many versions a key has. Hot keys are cut into time slices, each slice
           starting with the version in force at its start, so one key is many tasks.

Before the choice both sides' times and keys are brought to one type, upwards: a DATE becomes the
timestamp of its midnight, the narrower number the wider one. Text meets another type as that
type; text that does not convert matches nothing.
"""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions.columns import common_type
from starmill.operators.lookup import (
    SALT_FROM_ROWS,
    Skew,
    complete,
    key_hash,
    measure_skew,
    repeat_per_part,
    saltable,
    spread,
    with_part,
)

DEEP = 1000  # versions of one key beyond which comparing each event with each of them is too much
MAX_SLICES = 64  # time slices of one hot key; finer splitting is by row


def _as(column: str, kind: T.DataType, wanted: T.DataType) -> Column:
    c = F.col(column)
    return c if kind == wanted else c.try_cast(wanted)


def _aligned(events, versions, event_key, event_ts, version_key, sk):
    """Both sides with key ``_k`` and time ``_t`` (a version's start) in common types; versions
    also with ``_end``. Versions without key or start are never valid."""
    kinds = {c: events.schema[c].dataType for c in (event_key, event_ts)}
    v = {c: versions.schema[c].dataType for c in (version_key, "eff_start_ts", "eff_end_ts")}
    key = common_type(kinds[event_key], v[version_key])
    time = common_type(v["eff_start_ts"], v["eff_end_ts"])
    time = common_type(kinds[event_ts], time)
    if isinstance(time, T.StringType):  # text on both sides
        time = T.TimestampType()
    left = events.withColumns(
        {"_k": _as(event_key, kinds[event_key], key), "_t": _as(event_ts, kinds[event_ts], time)}
    )
    right = versions.select(
        _as(version_key, v[version_key], key).alias("_k"),
        _as("eff_start_ts", v["eff_start_ts"], time).alias("_t"),
        _as("eff_end_ts", v["eff_end_ts"], time).alias("_end"),
        F.col(sk).alias("_sk"),
    ).dropna(subset=["_k", "_t"])
    return left, right


def asof_join(
    events: DataFrame,
    versions: DataFrame,
    event_key: str,
    event_ts: str,
    version_key: str,
    sk: str,
    strategy: str | None = None,
    salt_from: int = SALT_FROM_ROWS,
    disjoint: bool = False,
    measured: DataFrame | None = None,
    distinct: bool = False,
) -> DataFrame:
    """``events`` plus column ``sk`` of the version valid at ``event_ts``. ``versions`` should be
    a stored frame: it is measured first (one narrow aggregate) to choose the strategy. ``disjoint``
    says that no two versions of a key are valid at once (``overlapping`` finds those that are).
    ``measured`` is a cheaper frame with the same keys, such as ``events`` before earlier joins;
    ``distinct``: no two events are alike."""
    names = events.columns
    left, right = _aligned(events, versions, event_key, event_ts, version_key, sk)
    size = (
        right.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("deepest"), F.sum("n").alias("rows")).first()
    )
    if strategy is None:
        strategy = "merge" if (size["deepest"] or 0) > DEEP else "range"
    if strategy == "merge":
        return _merge(left, right, names, sk)
    skew = Skew()
    if (size["rows"] or 0) >= salt_from and saltable(left, right, ["_k"]):
        kind = (events if measured is None else measured).schema[event_key].dataType
        keys = (events if measured is None else measured).select(
            _as(event_key, kind, right.schema["_k"].dataType).alias("_k")
        )
        skew = measure_skew(keys, ["_k"])
    # a key or time that needed no cast moves once, as _k or _t
    twins = {c: a for c, a in ((event_key, "_k"), (event_ts, "_t")) if left.schema[a].dataType == left.schema[c].dataType}
    out = [F.col(twins[c]).alias(c) if c in twins else F.col(c) for c in names]
    return _range(left.drop(*twins), right, out, sk, skew, disjoint, distinct)


def overlapping(
    versions: DataFrame, key: str, start: str = "eff_start_ts", end: str = "eff_end_ts"
) -> DataFrame:
    """Versions that are still valid when the key's next one starts: none in a history that may be
    joined as ``disjoint``. For a check when a history of other origin is stored."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    marked = versions.withColumn("_next", following)
    late = F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col("_next") < F.col(end)))
    return marked.where(late).drop("_next")


def _range(events, versions, names, sk, skew, disjoint, distinct) -> DataFrame:
    if not disjoint:
        # few versions per key here: each ends where the next one starts, at the latest
        following = F.lead("_t").over(Window.partitionBy("_k").orderBy("_t", "_sk"))
        versions = versions.withColumn("_end", F.least("_end", following))
    on = ["_k"]
    if skew:
        events, versions = spread(events, versions, ["_k"], skew, distinct=distinct)
        on.append("_salt")
    right = versions.select(*[F.col(c).alias(f"_v{c}") for c in versions.columns])
    condition = [events[c] == right[f"_v{c}"] for c in on]
    condition.append(right["_v_t"] <= events["_t"])
    condition.append(right["_v_end"].isNull() | (events["_t"] < right["_v_end"]))
    joined = events.join(right, functools.reduce(operator.and_, condition), "left")
    return joined.select(*names, F.col("_v_sk").alias(sk))


def _cuts(times: DataFrame, skew: Skew) -> dict[int, list[str]]:
    """Per hot key, times that part its rows into slices of about equal size (at most
    MAX_SLICES; the key list is bounded, so this is too)."""
    quantiles = [i / MAX_SLICES for i in range(1, MAX_SLICES)]
    hashed = key_hash(["_k"])
    points = (
        times.where(hashed.isin(list(skew.splits)))
        .groupBy(hashed.alias("h"))
        .agg(F.percentile_approx("_t", quantiles, 1000).cast("array<string>").alias("points"))
    )
    cuts = {}
    for row in points.collect():
        step = max(1, MAX_SLICES // skew.splits[row["h"]])
        cuts[row["h"]] = sorted(set(row["points"][step - 1 :: step]))
    return cuts


def _slice_of(cuts: dict[int, list[str]], time_type: str) -> Column:
    """How many of its key's cuts lie at or before the row's time (binary search over a constant
    array); 0 for all but hot keys."""
    if not cuts:
        return F.lit(0)
    pairs = []
    for hashed, points in cuts.items():
        array = F.from_json(F.lit(json.dumps(points)), "array<string>")
        pairs += [F.lit(hashed), array.cast(f"array<{time_type}>")]
    own = F.try_element_at(F.create_map(*pairs), key_hash(["_k"]))
    strides = []
    while not strides or strides[-1] * 2 <= max(len(p) for p in cuts.values()):
        strides.append(strides[-1] * 2 if strides else 1)
    found = F.aggregate(
        F.array(*[F.lit(n) for n in reversed(strides)]),
        F.lit(0),
        lambda at, n: at + F.when(F.get(own, at + n - 1) <= F.col("_t"), n).otherwise(0),
    )
    return F.when(key_hash(["_k"]).isin(list(cuts)), found).otherwise(F.lit(0))


def _merge(events, versions, names, sk) -> DataFrame:
    usable = complete(["_k", "_t"])
    time_type = events.schema["_t"].dataType.simpleString()
    left = events.where(usable).select(
        "_k", "_t", F.lit(1).alias("_kind"), F.struct(*names).alias("_event")
    )
    right = versions.select(
        "_k", "_t", F.lit(0).alias("_kind"), F.struct("_end", "_sk").alias("_version")
    )
    by_events, by_versions = measure_skew(left, ["_k"]), measure_skew(right, ["_k"])
    hot = {
        h: max(by_events.splits.get(h, 1), by_versions.splits.get(h, 1))
        for h in {**by_events.splits, **by_versions.splits}
    }
    cuts: dict[int, list[str]] = {}
    if hot:
        cuts = _cuts(left.select("_k", "_t").unionByName(right.select("_k", "_t")), Skew(hot))
    # beyond its time slices a hot key is split by row, its versions repeated for each part
    slices = {h: len(points) + 1 for h, points in cuts.items()}
    by_row = Skew({h: -(-n // slices.get(h, 1)) for h, n in by_events.splits.items()})
    by_row = Skew({h: n for h, n in by_row.splits.items() if n > 1})
    slice_of = _slice_of(cuts, time_type)
    right = right.withColumn("_slice", slice_of)
    if cuts:
        right = right.unionByName(
            _in_force_at_slice_start(right.where(key_hash(["_k"]).isin(list(cuts))))
        )
    if by_row:
        left = with_part(left, by_row.parts(["_k"]), "_sub")
        right = repeat_per_part(right, by_row.parts(["_k"]), "_sub")
    else:
        left, right = left.withColumn("_sub", F.lit(0)), right.withColumn("_sub", F.lit(0))
    left = left.withColumn("_slice", slice_of)

    order = ["_t", "_kind", F.col("_version._sk")]
    so_far = Window.partitionBy("_k", "_slice", "_sub").orderBy(*order)
    together = left.unionByName(right, allowMissingColumns=True).withColumn(
        "_valid", F.last("_version", ignorenulls=True).over(
            so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
    )
    end = F.col("_valid._end")
    found = F.when(end.isNull() | (F.col("_t") < end), F.col("_valid._sk"))
    resolved = together.where("_kind = 1").select("_event.*", found.alias(sk))
    none = F.lit(None).cast(versions.schema["_sk"].dataType)
    return resolved.unionByName(events.where(~usable).select(*names, none.alias(sk)))


def _in_force_at_slice_start(hot_versions: DataFrame) -> DataFrame:
    """For each slice after a hot key's first, the newest version of the earlier slices. At most
    hot keys x slices rows; versions are pre-aggregated per slice before anything moves."""
    latest = F.struct("_t", F.col("_version._sk").alias("sk"))
    newest = F.max_by(F.struct("_t", "_kind", "_version"), latest).alias("_newest")
    per_slice = hot_versions.groupBy("_k", "_slice").agg(newest)
    later = per_slice.where(F.col("_slice") < MAX_SLICES - 1).select(
        "_k",
        F.explode(F.sequence(F.col("_slice") + 1, F.lit(MAX_SLICES - 1))).alias("_slice"),
        "_newest",
    )
    carried = later.groupBy("_k", "_slice").agg(
        F.max_by("_newest", F.struct("_newest._t", "_newest._version._sk")).alias("_newest")
    )
    return carried.select("_k", "_newest._t", "_newest._kind", "_newest._version", "_slice")
