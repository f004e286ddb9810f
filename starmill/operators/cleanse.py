"""Raw to bronze to silver: load metadata, text cleaning, empty columns, newest row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions.columns import YES_NO, blank, flag_from_text
from starmill.operators.lookup import complete, row_hash


def with_load_columns(
    df: DataFrame, ingestion_ts: Column, batch_id: str, source_layer: str = "raw"
) -> DataFrame:
    """Bronze metadata; the values are arguments so that a rerun gives the same rows."""
    return df.withColumns(
        {
            "_ingestion_ts": ingestion_ts,
            "_batch_id": F.lit(batch_id),
            "_source_layer": F.lit(source_layer),
        }
    )


def trim_text(df: DataFrame) -> DataFrame:
    """Trim every text column, in one projection."""
    return df.select(
        *[
            F.trim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value (NULL or blank text everywhere), from one aggregate.
    An empty frame proves nothing, so it has none."""
    filled = [F.max(~blank(f)).alias(f.name) for f in df.schema.fields]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *filled).first()
    return [c for c in df.columns if row["_n"] and not row[c]]


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def text_flags_to_boolean(
    df: DataFrame, columns: Sequence[str], mapping: Mapping[str, bool] = YES_NO
) -> DataFrame:
    named = {c: flag_from_text(c, mapping) for c in columns if c in df.columns}
    return df.withColumns(named) if named else df


def newest_per_key(
    df: DataFrame,
    key: Sequence[str],
    newest_first: Sequence[str] = ("_ingestion_ts",),
    ties: Sequence[str | Column] = (),
) -> DataFrame:
    """One row per key: greatest ``newest_first``, then smallest ``ties`` (by default a hash of
    the whole row, so the choice does not depend on file order).

    Rows with a NULL in the key are all kept: a missing key does not identify anything. Spark
    applies the ``= 1`` limit inside each map task too (WindowGroupLimit), so a key with a third
    of all rows sends one row per task through the shuffle.
    """
    tie_order = [F.col(t) if isinstance(t, str) else t for t in ties] or [row_hash(df)]
    order = [F.col(c).desc() for c in newest_first] + [t.asc() for t in tie_order]
    # a row without a key is a group of its own, so one scan serves both kinds
    alone = F.when(~complete(key), F.monotonically_increasing_id())
    return (
        df.withColumn("_alone", alone)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*key, "_alone").orderBy(*order)))
        .where("_rank = 1")
        .drop("_rank", "_alone")
    )
