"""Surrogate keys: the values of ``row_number() over (order by ...)`` without the one partition.

The rows are range-partitioned and sorted, written once, and numbered as *rows before this
partition* + *position in it*. Only one count per partition reaches the driver. The written copy
fixes partition and position, so a retried task cannot renumber anything.

A wide frame that is used once, such as a fact, need not be stored for that: ``ranged_key`` cuts the
order at fixed values, counts the rows between them with one narrow aggregate and numbers each range
by a window. The cuts are literals and ties are numbered by their place in the files read, so a retry
gives the same. Lookups against large tables join in: for them only keys move, and what they find
comes to the ranges, so that the wide rows move once for the number and all lookups together.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.operators.lookup import complete, has_abundant
from starmill.sources.workdir import materialize

_POSITION_BITS = 33  # layout of monotonically_increasing_id(): partition << 33 | position
RANGES_PER_TASK, MAX_RANGES = 8, 4096
TASK_ROWS = 250_000  # rows whose ranges a task sorts together with what their lookups found
SAMPLES_PER_RANGE = 16  # keys drawn to place the cuts; they steer where rows go, not their numbers
WIDE_RANGE = 8  # a range with so many times its share of the rows is too much for one task
SMALL_RANGE = 100_000  # rows that one task may hold in any case

# Key columns, and what adds columns to the rows of a frame that has these.
Lookup = tuple[Sequence[str], Callable[[DataFrame], DataFrame]]


def surrogate_key(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str,
    after: int = 0,
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add ``name`` = ``after`` + 1, 2, 3 ... in the order of ``order_by`` (NULLs first).

    Rows equal in ``order_by`` are numbered in arbitrary order, so it should hold tie-breakers.
    Range bounds cannot part equal rows: unless the caller knows the order to be ``unique``, a
    sketch looks for an abundant one, and if there is one the rows are stored first and their
    place in the files becomes the last range column.
    """
    tie: list[str] = []
    if not unique and has_abundant(df, F.xxhash64(*order_by)):
        df = materialize(df, "ties").withColumn("_tie", F.monotonically_increasing_id())
        tie = ["_tie"]
    # without a number AQE merges small neighbouring ranges, which keeps their order
    ranges = df.repartitionByRange(*([partitions] if partitions else []), *order_by, *tie)
    ordered = ranges.drop(*tie).sortWithinPartitions(*order_by).withColumn(
        "_pos", F.monotonically_increasing_id()
    )
    stored = materialize(ordered, "keyed")
    part = F.shiftright("_pos", _POSITION_BITS).cast("int")
    sizes = {
        r["p"]: r["n"]
        for r in stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    width = max(sizes, default=0) + 1
    before = [0, *itertools.accumulate(sizes.get(p, 0) for p in range(width))][:width]
    offsets = F.from_json(F.lit(json.dumps(before)), "array<bigint>")
    position = F.col("_pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    number = F.get(offsets, part) + position + F.lit(after + 1)
    return stored.withColumn(name, number.cast("long")).drop("_pos")


def _tasks(df: DataFrame, rows: int) -> tuple[int, bool]:
    """How many tasks the ranges are dealt to; whether this is more than the session's number."""
    usual, wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)
    return max(usual, wanted), wanted > usual


def _cuts(df: DataFrame, column: str, rows: int) -> list:
    """Values that part the rows into ranges of about equal size, from a sample of bounded size."""
    tasks, _ = _tasks(df, rows)
    ranges = min(MAX_RANGES, RANGES_PER_TASK * tasks, -(-rows // SAMPLES_PER_RANGE))
    keys = df.select(column).where(F.col(column).isNotNull())
    share = min(1.0, ranges * SAMPLES_PER_RANGE / max(rows, 1))
    # text is ordered by its bytes, as Spark does it
    drawn = sorted((r[0] for r in keys.sample(share, seed=17).collect()),
                   key=lambda v: v.encode() if isinstance(v, str) else v)
    return list(dict.fromkeys(drawn[i * len(drawn) // ranges] for i in range(1, ranges))) if drawn else []


def _range_of(cuts: list, column: str) -> Column:
    """How many cuts lie at or before the row's value (binary search in a constant array)."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(v) for v in cuts])
    strides = [1 << n for n in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(n) for n in strides]),
        F.lit(0),
        lambda at, n: at + F.when(F.get(array, at + n - 1) <= F.col(column), n).otherwise(0),
    )
    return F.when(F.col(column).isNull(), 0).otherwise(found)


def _answered(rows: DataFrame, lookups: Sequence[Lookup], tasks: int | None) -> DataFrame:
    """``rows``, moved to their ``_range``, with the columns that the lookups add. A lookup is given
    the keys alone; its answers move to the range that asked, and the rows of these keys take them."""
    keys = list(dict.fromkeys(c for on, _ in lookups for c in on))
    others = [c for c in rows.columns if c not in (*keys, "_range")]
    together = rows.select("_range", *keys, F.struct(*others).alias("_row"))
    found: dict[str, Column] = {}
    for on, look in lookups:
        asked = rows.where(complete(on)).select("_range", "_place", *on)
        answers = look(asked)
        new = [c for c in answers.columns if c not in asked.columns]
        known = functools.reduce(operator.or_, [F.col(c).isNotNull() for c in new])
        answers = answers.where(known).select("_range", *on, *new)
        together = together.unionByName(answers, allowMissingColumns=True)
        found |= {c: F.max(c).over(Window.partitionBy("_range", *on)) for c in new}
    # dealt by the range alone, which serves all windows
    dealt = together.repartition(*([tasks] if tasks else []), "_range")
    return dealt.withColumns(found).where(F.col("_row").isNotNull()).select("_range", *keys, "_row.*", *found)


def ranged_key(
    df: DataFrame, order_by: Sequence[str], name: str, lookups: Sequence[Lookup] = ()
) -> DataFrame:
    """The numbers of ``surrogate_key`` for a stored ``df`` whose result is read once: nothing is
    written, the rows move once. Ranges are cut by the first column, which must be a whole number or
    text; where one of its values (or NULL) abounds the counts show it and the rows are stored.

    ``lookups`` add columns that depend on their key columns alone, NULL where a key is NULL, and no
    rows: each is a left join that holds a key once. No row moves for them, only its keys."""
    first = order_by[0]

    def stored() -> DataFrame:
        return functools.reduce(lambda rows, one: one[1](rows), lookups, surrogate_key(df, order_by, name))

    if not isinstance(df.schema[first].dataType, (T.IntegralType, T.StringType)):
        return stored()
    rows = df.count()
    part = _range_of(_cuts(df, first, rows), first)
    counts = df.select(part.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["p"]: r["n"] for r in counts.collect()}
    width = max(sizes, default=0) + 1
    if max(sizes.values(), default=0) > max(SMALL_RANGE, WIDE_RANGE * rows / width):
        return stored()
    before = [0, *itertools.accumulate(sizes.get(p, 0) for p in range(width))][:width]
    offsets = F.from_json(F.lit(json.dumps(before)), "array<bigint>")
    placed = df.withColumn("_place", F.monotonically_increasing_id())  # ties as they lie in the files
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by, "_place"))
    placed = placed.withColumn("_range", part)
    tasks, more = _tasks(df, rows)
    answered = _answered(placed, lookups, tasks if more else None) if lookups else placed
    ranged = answered.withColumn(name, place)
    ranged = ranged.withColumn(name, (F.get(offsets, F.col("_range")) + F.col(name)).cast("long"))
    added = [c for c in ranged.columns if c not in (*df.columns, name, "_range", "_place")]
    return ranged.select(*df.columns, name, *added)
