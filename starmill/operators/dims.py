"""Calendar, combination and type 1 dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.columns import date_key
from starmill.operators.keys import surrogate_key


def _calendar_columns(days: DataFrame) -> DataFrame:
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_sk"),
        d,
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week"),  # 1 = Sunday
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"),  # ISO
        F.month(d).alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day from ``first`` to ``last``, both included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return _calendar_columns(spark.range(1).select(F.explode(days).alias("full_date")))


def calendar_of(df: DataFrame, column: str) -> DataFrame:
    """The calendar from the earliest to the latest day found in ``column``."""
    span = df.agg(
        F.min(column).cast("date").alias("first"), F.max(column).cast("date").alias("last")
    )
    days = F.explode(F.sequence("first", "last")).alias("full_date")
    return _calendar_columns(span.where("first IS NOT NULL").select(days))


def combination_dim(df: DataFrame, columns: Sequence[str], sk: str) -> DataFrame:
    """One numbered row per distinct combination (partially deduplicated before the shuffle)."""
    return surrogate_key(df.select(*columns).distinct(), list(columns), sk, unique=True).select(sk, *columns)


def type1_dim(df: DataFrame, key: str, sk: str, columns: Mapping[str, Column | str]) -> DataFrame:
    """Current attributes, numbered in key order; ``columns`` maps output names to sources."""
    projected = df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    )
    return surrogate_key(projected, [key], sk, unique=True).select(sk, *columns)
