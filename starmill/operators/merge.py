"""Upsert and delete as set operations.

On a stored table they are copy on write: the key columns alone are read to find the files that hold
a touched row (min/max of the files prune them first, through the pushed-down range of the incoming
keys), only those files are rewritten, and the new version is committed against the one that was
read. A concurrent commit in between raises ``ConcurrentLoad``; nothing is lost then.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.operators.contracts import repeated_keys
from starmill.operators.lookup import complete
from starmill.sources.lake import Lake, Snapshot
from starmill.sources.workdir import materialize


def upsert(
    target: DataFrame | None, source: DataFrame, key: Sequence[str], check: bool = True
) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with the same key; others are added. A NULL
    in the key matches nothing. With ``check`` a repeated source key raises, as MERGE does."""
    if check and not repeated_keys(source, key).isEmpty():
        raise ValueError(f"source rows repeat a key of {list(key)}")
    if target is None:
        return source
    # a key with a NULL gets a number of its own: it matches nothing and is not one hot key
    own = F.when(~complete(key), F.monotonically_increasing_id())
    on = [F.col(f"_t.{k}") == F.col(f"_s.{k}") for k in key] + [F.col("_t._own").isNull()]
    left = target.withColumn("_own", own).alias("_t")
    kept = left.join(source.select(*key).alias("_s"), on, "left_anti").select(*target.columns)
    return kept.unionByName(source.select(*target.columns))


def delete_where_equal(df: DataFrame, **equals: Any) -> DataFrame:
    """Without the rows matching every given value; without arguments nothing remains."""
    hit = F.lit(True)
    for column, value in equals.items():
        hit = hit & F.col(column).eqNullSafe(F.lit(value))
    return df.where(~hit)


def _hit_files(lake: Lake, layer: str, table: str, base: Snapshot, source: DataFrame, key) -> list[str]:
    """Files of the stored table that hold a key of ``source``."""
    stored = lake.frame(layer, table, base, file="_file").select(*key, "_file")
    keys = source.select(*key).dropna()
    bounds = keys.agg(*[f(c).alias(f"{n}_{c}") for c in key for n, f in (("lo", F.min), ("hi", F.max))])
    row = bounds.first()
    for c in key:
        if row[f"lo_{c}"] is None:
            return []
        if stored.schema[c].dataType == source.schema[c].dataType:
            stored = stored.where(F.col(c).between(F.lit(row[f"lo_{c}"]), F.lit(row[f"hi_{c}"])))
    hit = stored.join(keys, list(key), "left_semi").select("_file").distinct()
    return [r["_file"] for r in hit.collect()]  # file names: metadata


def _only(base: Snapshot, files: Sequence[str]) -> Snapshot:
    """``base`` reduced to the given files."""
    parts = []
    for p in base.parts:
        inside = [unquote(f.split(f"/{p.folder}/", 1)[1]) for f in files if f"/{p.folder}/" in f]
        if inside:
            parts.append(replace(p, files=tuple(inside), rows=None))
    return replace(base, parts=tuple(parts))


def replace_rows(
    lake: Lake, layer: str, table: str, base: Snapshot, gone: DataFrame, rows: DataFrame, key: Sequence[str]
) -> str:
    """Commit the version after ``base`` without the rows whose key is in ``gone`` and with ``rows``.
    Files that hold no such key are kept."""
    gone = materialize(gone.select(*key), "gone")
    rows = materialize(rows, "rows")
    hit = _hit_files(lake, layer, table, base, gone, key)
    touched = lake.frame(layer, table, _only(base, hit))
    kept = touched.join(gone, list(key), "left_anti").select(*touched.columns)
    return lake.replace_files(
        layer, table, base, hit, kept.unionByName(rows, allowMissingColumns=True)
    )


def upsert_table(lake: Lake, df: DataFrame, layer: str, table: str, key: Sequence[str]) -> str:
    """``upsert`` into a stored table (created if absent). Files without a touched key are kept."""
    base = lake.snapshot(layer, table)
    if base is None:
        return lake.overwrite(upsert(None, df, key), layer, table)
    source = materialize(df, "source")
    if not repeated_keys(source, key).isEmpty():
        raise ValueError(f"source rows repeat a key of {list(key)}")
    hit = _hit_files(lake, layer, table, base, source, key)
    touched = lake.frame(layer, table, _only(base, hit))
    return lake.replace_files(layer, table, base, hit, upsert(touched, source, key, check=False))


def delete_from_table(lake: Lake, layer: str, table: str, **equals: Any) -> str:
    """``delete_where_equal`` on a stored table; without arguments all rows go, and no file is
    read. Files without a matching row are kept."""
    base = lake.snapshot(layer, table)
    if base is None:
        raise LookupError(f"no complete load of {layer}.{table} below {lake.root}")
    if not equals:
        empty = lake.spark.createDataFrame([], base.schema)
        return lake.overwrite(empty, layer, table, base.partition_by)
    rows = lake.frame(layer, table, base, file="_file")
    matching = F.lit(True)
    for column, value in equals.items():
        matching = matching & F.col(column).eqNullSafe(F.lit(value))
    hit = [r["_file"] for r in rows.where(matching).select("_file").distinct().collect()]
    kept = delete_where_equal(lake.frame(layer, table, _only(base, hit)), **equals)
    return lake.replace_files(layer, table, base, hit, kept if hit else None)
