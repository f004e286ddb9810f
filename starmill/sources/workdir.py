"""Intermediate tables in the folder the cluster shares.

Writing an intermediate to the shared folder cuts its lineage (a lost executor never triggers the
upstream shuffle again) and gives the planner true file sizes, so a later join broadcasts it only
when those sizes are below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_scopes: list[list[str]] = []
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: list[str] = []  # the setting that the first of the present writers found, once for each of them
_writers = threading.Lock()


def work_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary folder stands in
    only for a local session that names none."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folders.setdefault(app, "") or tempfile.mkdtemp(prefix="starmill-")
        _local_folders[app] = folder
    return f"{folder.rstrip('/')}/starmill-{app}"


def drop_work_tables(spark: SparkSession) -> None:
    """Delete this application's intermediates. For the end of a load: frames that still read
    them cannot be used any more."""
    _delete(spark, work_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediates written inside the block when it ends, well or not."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def fresh_path(spark: SparkSession, label: str = "t") -> str:
    """A path below the work folder that no other call returns."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write inside the block shuffles is deleted when it ends. Else the files stay until the
    driver happens to collect its garbage, beside all that later steps shuffle."""
    with _writers:
        _writing.append(_writing[0] if _writing else spark.conf.get(_DROP, "false"))
        spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        with _writers:
            found = _writing.pop()
            if not _writing:
                spark.conf.set(_DROP, found)


def materialize(df: DataFrame, label: str = "t", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the work folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
