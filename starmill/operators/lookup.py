"""Left joins against a side that is unique on the join key, safe for hot keys.

Order of preference:

1. the lookup side is stored, so its file size is known and Spark broadcasts it only below
   ``spark.sql.autoBroadcastJoinThreshold``; the wide side is then never shuffled;
2. otherwise both sides shuffle on the key. A key (or NULL) that holds a large share of the wide
   side is split: its rows get a salt, its lookup row is repeated once per salt value. A key gets
   salts in proportion to its share, so all keys together add at most about two lookup rows per
   shuffle partition.

The hot keys come from a fixed-size sketch, so their list is bounded whatever the data looks like;
it only steers where rows go, never which rows match.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.sources.workdir import materialize

HOT_SHARE = 1 / 256  # a key with this share of the rows is split
SKETCH_ITEMS = 8192  # the sketch's error is a small fraction of HOT_SHARE
SALT_FROM_ROWS = 100_000  # a smaller lookup side is normally broadcast, by its size
HELD_ROWS = 500_000  # rows of a key, a number and times that every task can hold, some 50 MB

_UNSALTABLE = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Skew:
    """Into how many parts each hot key (by hash) and the NULL keys are split."""

    splits: dict[int, int] = field(default_factory=dict)
    null_splits: int = 1

    def __bool__(self) -> bool:
        return bool(self.splits) or self.null_splits > 1

    def parts(self, on: Sequence[str]) -> Column:
        """Number of parts of the row's key; 1 for all but the hot ones."""
        found = F.lit(None).cast("int")
        if self.splits:
            pairs = [F.lit(v) for pair in self.splits.items() for v in pair]
            found = F.try_element_at(F.create_map(*pairs), key_hash(on))
        return F.when(~complete(on), self.null_splits).otherwise(F.coalesce(found, F.lit(1)))


def key_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def complete(columns: Sequence[str]) -> Column:
    """No NULL among the columns."""
    result = F.lit(True)
    for c in columns:
        result = result & F.col(c).isNotNull()
    return result


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(
        *[F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    )


def _frequent(df: DataFrame, value: Column, share: float, keep: Column | None = None) -> tuple:
    """``(rows, rows with keep false, {value: rows} for frequent values)``: one aggregate whose
    result has a fixed size."""
    keep = F.lit(True) if keep is None else keep
    top = f"approx_top_k(v, {int(2 / share)}, {SKETCH_ITEMS}) FILTER (WHERE keep)"
    row = df.select(value.alias("v"), keep.alias("keep")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("keep")).alias("skipped"),
        F.expr(top).alias("top"),
    ).first()
    items = {i["item"]: i["count"] for i in row["top"] or [] if i["count"] >= row["n"] * share}
    return row["n"], row["skipped"], items


def measure_skew(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> Skew:
    """One narrow scan of the key columns."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, nulls, hot = _frequent(df, key_hash(on), share, complete(on))

    def parts(count: int) -> int:
        return max(2, math.ceil(2 * tasks * count / rows))

    null_splits = parts(nulls) if rows and nulls >= rows * share else 1
    return Skew({item: parts(count) for item, count in hot.items()}, null_splits)


def has_abundant(df: DataFrame, value: Column) -> bool:
    """Does one value hold a large share of the rows?"""
    return bool(_frequent(df, value, HOT_SHARE)[2])


def with_part(df: DataFrame, parts: Column, name: str, distinct: bool = False) -> DataFrame:
    """Number the rows 0 .. ``parts``-1. The number is a hash of the row, so a retried task gives
    the same one. Where identical rows abound a hash cannot part them: the rows are then stored
    and numbered by their place in the files, which a retry does not change either. ``distinct``
    says that no two rows are alike (they hold a number), so that nothing needs to be looked for."""
    if not distinct and has_abundant(df.where(parts > 1), row_hash(df)):
        df = materialize(df, "spread")
        source = F.monotonically_increasing_id()
    else:
        source = row_hash(df)
    part = F.when(parts > 1, F.pmod(source, parts.cast("long"))).otherwise(F.lit(0).cast("long"))
    return df.withColumn(name, part.cast("int"))


def repeat_per_part(df: DataFrame, parts: Column, name: str) -> DataFrame:
    numbers = F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return df.withColumn(name, F.explode(numbers))


def spread(
    left: DataFrame, right: DataFrame, on: Sequence[str], skew: Skew, salt: str = "_salt",
    distinct: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Add ``salt`` to both sides: split hot rows on the left, repeat hot rows on the right."""
    parts = skew.parts(on)
    return with_part(left, parts, salt, distinct), repeat_per_part(right.where(complete(on)), parts, salt)


def saltable(left: DataFrame, right: DataFrame, on: Sequence[str]) -> bool:
    """Both sides must hash a matching key alike: same types, no floating point."""
    return all(
        left.schema[c].dataType == right.schema[c].dataType
        and not isinstance(left.schema[c].dataType, _UNSALTABLE)
        for c in on
    )


def held(df: DataFrame, rows: int) -> bool:
    """May every task hold this side's ``rows`` rows of a few short columns? Not if the session
    broadcasts nothing."""
    threshold = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return rows <= HELD_ROWS and not threshold.startswith("-")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    right_rows: int,
    salt_from: int = SALT_FROM_ROWS,
    measured: DataFrame | None = None,
    distinct: bool = False,
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on same-named columns, keeping ``left``'s column order.

    ``right`` should be a stored frame of ``right_rows`` rows, unique on ``on``. ``measured`` is a
    cheaper frame with the same keys, such as ``left`` before earlier joins; ``distinct``: no two rows of ``left`` are alike.
    """
    on = list(on)
    added = [c for c in right.columns if c not in on]
    if right_rows >= salt_from and saltable(left, right, on):
        skew = measure_skew(left if measured is None else measured, on)
        if skew:
            salted_left, salted_right = spread(left, right, on, skew, distinct=distinct)
            joined = salted_left.join(salted_right, [*on, "_salt"], "left")
            return joined.select(*left.columns, *added)
    return left.join(right, on, "left").select(*left.columns, *added)
