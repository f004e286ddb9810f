"""Column statistics of stored tables.

Plain statistics are one aggregate over the table. Exact distinct counts are one narrow branch
per column instead of many ``count(distinct)`` in one aggregate: that would multiply every row by
the number of columns, while a columnar file gives each branch just its column, and each value is
pre-aggregated before it moves. Profile Parquet, not CSV (a CSV branch reads whole lines).

A table that grows load by load need not be read again: ``profile_state`` of each load is stored, and
``merged_profile`` adds the states up.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions.columns import blank, is_numeric

VALUE_COUNT_LIMIT = 25
SKETCH_BITS = 14  # of a distinct-count sketch: 2 ** 14 registers, about 0.8 % error
ID_SUFFIX = "_id"


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def column_statistics(df: DataFrame, table: str) -> DataFrame:
    """Everything but distinct counts, long form, from one aggregate without a data shuffle:
    ``table, column, position, dtype, row_count, column_count, null_count, null_pct, min_value,
    max_value, avg, stddev``. NULL and empty text count as missing. Minimum and maximum are text
    so that wide integers and decimals stay exact."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        aggregates.append(F.coalesce(F.sum(blank(f).cast("long")), F.lit(0)).alias(f"_null{i}"))
        if is_numeric(f.dataType):
            c = F.col(f.name)
            aggregates += [
                F.min(c).alias(f"_min{i}"),
                F.max(c).alias(f"_max{i}"),
                F.avg(c).cast("double").alias(f"_avg{i}"),
                F.stddev_samp(c).alias(f"_std{i}"),
            ]
    lines = []
    for i, f in enumerate(df.schema.fields):
        numeric = is_numeric(f.dataType)
        nulls = F.col(f"_null{i}")
        pct = F.when(F.col("_rows") > 0, F.round(100.0 * nulls / F.col("_rows"), 2)).otherwise(0.0)
        text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
        lines.append(
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("_rows").alias("row_count"),
                F.lit(len(df.columns)).alias("column_count"),
                nulls.alias("null_count"),
                pct.alias("null_pct"),
                (F.col(f"_min{i}").cast("string") if numeric else text).alias("min_value"),
                (F.col(f"_max{i}").cast("string") if numeric else text).alias("max_value"),
                (F.round(f"_avg{i}", 4) if numeric else number).alias("avg"),
                (F.round(f"_std{i}", 4) if numeric else number).alias("stddev"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*lines)).alias("s")).select("s.*")


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """``column, distinct_count`` (NULL excluded). ``exact=False`` is one pass with sketches."""
    columns = list(columns or df.columns)
    if exact:
        return _stack(
            [
                df.select(c).distinct().agg(F.count(c).alias("distinct_count")).select(
                    F.lit(c).alias("column"), "distinct_count"
                )
                for c in columns
            ]
        )
    row = df.agg(*[F.approx_count_distinct(c).alias(f"_{i}") for i, c in enumerate(columns)])
    lines = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("distinct_count"))
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*lines)).alias("s")).select("s.*")


def profile_table(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """``column_statistics`` with ``distinct_count``; one row per column."""
    # both sides have one row per column of the schema
    return column_statistics(df, table).join(distinct_counts(df, exact=exact), "column")


# ---------------------------------------------------------------- mergeable states


def profile_state(df: DataFrame, table: str) -> DataFrame:
    """What a load contributes to a table's profile: one row per column, from one aggregate, that
    ``merged_profile`` adds to other loads' rows. Distinct values are a sketch of fixed size;
    numbers have count, mean, squared deviations and extremes (as text, so that they stay exact)."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        kind = f.dataType
        # sketches pass over an empty text, so every text gets a first character
        whole = isinstance(kind, (T.IntegerType, T.LongType))
        hashed = c if whole else F.concat(F.lit("="), c.cast("string"))
        aggregates.append(F.coalesce(F.sum(blank(f).cast("long")), F.lit(0)).alias(f"_null{i}"))
        aggregates.append(F.hll_sketch_agg(hashed, F.lit(SKETCH_BITS)).alias(f"_seen{i}"))
        if is_numeric(kind):
            aggregates += [
                F.count(c).alias(f"_n{i}"),
                F.min(c).alias(f"_min{i}"),
                F.max(c).alias(f"_max{i}"),
                F.avg(c).cast("double").alias(f"_avg{i}"),
                (F.var_pop(c) * F.count(c)).alias(f"_dev{i}"),
            ]
    lines = []
    for i, f in enumerate(df.schema.fields):
        numeric = is_numeric(f.dataType)

        def number(name: str, kind: str) -> Column:
            return (F.col(f"{name}{i}") if numeric else F.lit(None)).cast(kind)

        lines.append(
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("_rows").alias("row_count"),
                F.col(f"_null{i}").cast("long").alias("null_count"),
                F.col(f"_seen{i}").alias("seen"),
                number("_n", "long").alias("n"),
                number("_min", "string").alias("least"),
                number("_max", "string").alias("most"),
                number("_avg", "double").alias("mean"),
                number("_dev", "double").alias("deviation"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*lines)).alias("s")).select("s.*")


def merged_profile(states: DataFrame) -> DataFrame:
    """The profile of all loads together, in the columns of ``profile_table`` (distinct counts are
    estimates), from their states alone (with a column ``load``): a few rows per load. A column's
    type is that of the largest load."""

    def order(text: str) -> Column:
        # doubles part what decimals cannot hold, decimals part what doubles cannot tell apart
        value = F.struct(F.col(text).try_cast("double"), F.col(text).try_cast("decimal(38,6)"))
        return F.when(F.col(text).isNotNull(), value)

    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    squares = F.sum(F.col("deviation") + F.col("n") * F.col("mean") * F.col("mean"))
    merged = states.groupBy("table", "column").agg(
        F.max("position").alias("position"),
        F.max_by("dtype", "row_count").alias("dtype"),
        F.sum("row_count").alias("own_rows"),
        F.sum("null_count").alias("own_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("seen")).alias("distinct_count"),
        F.sum("n").alias("n"),
        F.min_by("least", order("least")).alias("min_value"),
        F.max_by("most", order("most")).alias("max_value"),
        mean.alias("mean"),
        squares.alias("squares"),
    )
    # a load from before a column was added has it as NULL in all its rows
    loads = states.groupBy("table", "load").agg(F.max("row_count").alias("rows"))
    whole = loads.groupBy("table").agg(F.sum("rows").alias("row_count"))
    nulls = F.col("own_nulls") + F.col("row_count") - F.col("own_rows")
    spread = F.greatest(F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    stddev = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1)))
    pct = F.when(F.col("row_count") > 0, F.round(100.0 * nulls / F.col("row_count"), 2)).otherwise(0.0)
    counted = merged.groupBy("table").agg(F.count(F.lit(1)).cast("int").alias("column_count"))
    return merged.join(whole, "table").join(counted, "table").select(
        "table", "column", "position", "dtype", "row_count", "column_count",
        nulls.alias("null_count"), pct.alias("null_pct"), "min_value", "max_value",
        F.round("mean", 4).alias("avg"), F.round(stddev, 4).alias("stddev"), "distinct_count",
    )


def value_counts(
    df: DataFrame, columns: Sequence[str], limit: int = VALUE_COUNT_LIMIT
) -> DataFrame:
    """``column, value, n, rank``: most frequent values first, ties by value; NULL is "None".
    Each branch aggregates one column, then keeps its top ``limit`` inside the tasks."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    branches = [
        df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(c).alias("column"), "value", "n")
        for c in columns
    ]
    ranked = _stack(branches).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def categorical_columns(
    df: DataFrame, profile: Sequence[Mapping[str, Any]], limit: int = VALUE_COUNT_LIMIT
) -> list[str]:
    """Non-numeric columns with at most ``limit`` distinct values, from collected profile rows."""
    distinct = {r["column"]: r["distinct_count"] for r in profile}
    return [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and distinct[f.name] <= limit
    ]


def candidate_keys(profile: DataFrame, suffix: str = ID_SUFFIX) -> DataFrame:
    """Columns named as identifiers that are complete and distinct."""
    return profile.where(
        F.lower("column").endswith(suffix)
        & (F.col("null_count") == 0)
        & (F.col("distinct_count") == F.col("row_count"))
    ).select("table", "column")


def identifier_keys(df: DataFrame, table: str, suffix: str = ID_SUFFIX) -> DataFrame:
    """``candidate_keys`` straight from the table, reading nothing but the identifier columns:
    each is grouped once, and the groups give rows, missing and distinct values together."""
    fields = [f for f in df.schema.fields if f.name.lower().endswith(suffix)]
    branches = []
    for f in fields:
        groups = df.groupBy(f.name).agg(F.count(F.lit(1)).alias("_n"))
        found = groups.agg(
            F.sum("_n").alias("row_count"),
            F.sum(F.when(blank(f), F.col("_n")).otherwise(0)).alias("null_count"),
            F.count(f.name).alias("distinct_count"),
        )
        names = (F.lit(table).alias("table"), F.lit(f.name).alias("column"))
        branches.append(found.select(*names, "row_count", "null_count", "distinct_count"))
    if not branches:
        return df.sparkSession.createDataFrame([], "table string, column string")
    return candidate_keys(_stack(branches), suffix)


def duplicate_key_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row ``rows, distinct_keys, duplicates``; NULLs are values here. The rows are grouped
    once (partially in the map tasks) and the groups counted."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys")
    ).withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))
