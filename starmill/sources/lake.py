"""Layered tables on Parquet with a commit log.

A table is a folder ``<root>/<layer>/<table>``. Every write puts its files into a folder of its own
(``_load=<id>``) and then commits a manifest ``_log/v=000001.json``, ``v=000002.json`` ...: schema,
partition columns, and the *parts* that make up the table, each with the schema its files were
written with, its number of rows, and which of its files still count.

* A manifest is created only if there is none of that number yet, so of two writers that start from
  the same version one succeeds. The other's files are deleted and it raises ``ConcurrentLoad``; an
  append, which commutes with other writers' work, starts again from the new version instead.
* Nothing that a manifest names is ever changed: readers see the version they opened, and a plan may
  read the table that it is about to replace.
* Parts are read with their own schema and cast to the table's, so a column can be added or widened
  (numbers, and dates to timestamps) without touching earlier files.
* Rows are counted while they are written; counting tables reads manifests only.
* ``replace_files`` commits new rows in place of single files: an upsert or a delete rewrites the files
  that hold a touched row and keeps the others.

A table without a log that holds folders ``v=000001`` ... with ``_SUCCESS`` is read as its newest
complete folder. (An empty text in a partition column is read as NULL: the folder layout knows
no empty value.)
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions.columns import common_type, is_numeric
from starmill.sources.files import (
    create_text,
    delete_path,
    hadoop_fs,
    list_names,
    read_text,
)
from starmill.sources.workdir import shuffles_dropped

LAYERS = ("raw", "bronze", "silver", "quarantine", "gold", "products")
LOAD = "_load"
RETRIES = 50  # an append starts again so often when others commit first
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)


class ConcurrentLoad(RuntimeError):
    """Another writer has committed the version that this one meant to write."""


@dataclass(frozen=True)
class Part:
    """Files of one write. ``files`` (paths below ``folder``) is None while all of them count."""

    folder: str
    schema: T.StructType
    rows: int | None
    files: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    version: int
    schema: T.StructType
    partition_by: tuple[str, ...]
    parts: tuple[Part, ...]

    @property
    def rows(self) -> int | None:
        counts = [p.rows for p in self.parts]
        return None if None in counts else sum(counts)

    def to_json(self) -> str:
        parts = [
            {"folder": p.folder, "schema": json.loads(p.schema.json()), "rows": p.rows, "files": p.files}
            for p in self.parts
        ]
        schema = json.loads(self.schema.json())
        return json.dumps({"schema": schema, "partition_by": self.partition_by, "parts": parts})

    @classmethod
    def from_json(cls, version: int, text: str) -> Snapshot:
        d = json.loads(text)
        parts = [
            Part(p["folder"], T.StructType.fromJson(p["schema"]), p["rows"],
                 None if p["files"] is None else tuple(p["files"]))
            for p in d["parts"]
        ]
        return cls(version, T.StructType.fromJson(d["schema"]), tuple(d["partition_by"]), tuple(parts))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def widened(schema: T.StructType, new: T.StructType, name: str) -> T.StructType:
    """``schema`` with the columns that only ``new`` has, and the wider of two types; types that
    have no wider one raise."""
    kinds = {f.name: f.dataType for f in schema.fields}
    for f in new.fields:
        known = kinds.get(f.name, f.dataType)
        numbers = is_numeric(known) and is_numeric(f.dataType)
        times = isinstance(known, _TIMES) and isinstance(f.dataType, _TIMES)
        if known != f.dataType and not numbers and not times:
            raise TypeError(f"{name}.{f.name} is {known}, the new rows' is {f.dataType}")
        kinds[f.name] = common_type(known, f.dataType)
    return T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _manifest(self, layer: str, table: str, version: int) -> str:
        return f"{self._folder(layer, table)}/_log/v={version:06d}"

    def _versions(self, layer: str, table: str) -> list[int]:
        names = list_names(self.spark, f"{self._folder(layer, table)}/_log")
        stems = [n.removesuffix(".json").removeprefix("v=") for n in names if n.endswith(".json")]
        return sorted(int(s) for s in stems if s.isdigit())

    def snapshot(self, layer: str, table: str, version: int | None = None) -> Snapshot | None:
        """The newest version (or the given one); None if there is no such table."""
        versions = self._versions(layer, table)
        if versions:
            number = versions[-1] if version is None else version
            text = read_text(self.spark, f"{self._manifest(layer, table, number)}.json")
            return Snapshot.from_json(number, text)
        return self._of_other_origin(layer, table)

    def _of_other_origin(self, layer: str, table: str) -> Snapshot | None:
        folder = self._folder(layer, table)
        for name in sorted(list_names(self.spark, folder), reverse=True):
            if not name.startswith("v="):
                continue
            fs, done = hadoop_fs(self.spark, f"{folder}/{name}/_SUCCESS")
            if fs.exists(done):
                read = self.spark.read.option("mergeSchema", True)
                schema = _nullable(read.parquet(f"{folder}/{name}").schema)
                return Snapshot(0, schema, (), (Part(name, schema, None),))
        return None

    def exists(self, layer: str, table: str) -> bool:
        return self.snapshot(layer, table) is not None

    def partition_columns(self, layer: str, table: str) -> list[str]:
        snapshot = self.snapshot(layer, table)
        return list(snapshot.partition_by) if snapshot else []

    # ---------------------------------------------------------------- reading

    def _part_frames(self, layer: str, table: str, snapshot: Snapshot) -> list[DataFrame]:
        """One scan for all parts of the same schema, cast to the table's."""
        groups: dict[tuple[str, str], list[str]] = {}
        folder = self._folder(layer, table)
        for p in snapshot.parts:
            # a folder of this lake is told from the others by the partition column LOAD
            base = folder if p.folder.startswith(f"{LOAD}=") else f"{folder}/{p.folder}"
            names = [""] if p.files is None else [f"/{f}" for f in p.files]
            paths = [f"{folder}/{p.folder}{name}" for name in names]
            groups.setdefault((base, p.schema.json()), []).extend(paths)
        frames = []
        for (base, schema), paths in groups.items():
            if not paths:
                continue
            kind = T.StructType.fromJson(json.loads(schema))
            if base == folder:
                kind = kind.add(LOAD, T.StringType())
            frames.append(self.spark.read.schema(kind).option("basePath", base).parquet(*paths))
        return frames

    def frame(self, layer: str, table: str, snapshot: Snapshot, file: str | None = None) -> DataFrame:
        """The rows of ``snapshot``; with ``file`` a column of that name holds each row's file."""
        frames = []
        for stored in self._part_frames(layer, table, snapshot):
            have = dict(zip(stored.columns, (f.dataType for f in stored.schema.fields)))
            columns = []
            for f in snapshot.schema.fields:
                kind = have.get(f.name)
                value = F.lit(None) if kind is None else F.col(f"`{f.name}`")
                columns.append((value if kind == f.dataType else value.cast(f.dataType)).alias(f.name))
            if file is not None:
                columns.append(F.col("_metadata.file_path").alias(file))
            frames.append(stored.select(*columns))
        if not frames:
            extra = [] if file is None else [T.StructField(file, T.StringType())]
            return self.spark.createDataFrame([], T.StructType([*snapshot.schema.fields, *extra]))
        return functools.reduce(DataFrame.unionAll, frames)

    def read(
        self, layer: str, table: str, merge_schema: bool = False, version: int | None = None
    ) -> DataFrame:
        """The newest version, or an earlier one that is still kept. Schemas are always merged;
        ``merge_schema`` is accepted for callers that ask for it."""
        snapshot = self.snapshot(layer, table, version)
        if snapshot is None:
            raise LookupError(f"no complete load of {layer}.{table} below {self.root}")
        return self.frame(layer, table, snapshot)

    def rows(self, layer: str, table: str) -> int:
        """Number of rows, from the manifest."""
        snapshot = self.snapshot(layer, table)
        if snapshot is None:
            raise LookupError(f"no complete load of {layer}.{table} below {self.root}")
        if snapshot.rows is not None:
            return snapshot.rows
        return self.frame(layer, table, snapshot).count()

    # ---------------------------------------------------------------- writing

    def _write(
        self, df: DataFrame, layer: str, table: str, partition_by: Sequence[str], few: bool = False
    ) -> Part:
        """Write ``df`` into a new folder that no manifest names yet.

        A partitioned write is rebalanced on its partition columns first: AQE then gives each
        partition value files of a sensible size and splits a value that holds too many rows. Where
        the caller knows that there are ``few`` values, a task writes a file for each of them instead.
        """
        name = f"{LOAD}={uuid.uuid4().hex}"
        path = f"{self._folder(layer, table)}/{name}"
        seen = Observation()
        out = df.hint("rebalance", *partition_by) if partition_by and not few else df
        out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
        try:
            writer = out.write.mode("errorifexists").option("compression", "zstd")
            with shuffles_dropped(self.spark):
                writer.partitionBy(*partition_by).parquet(path)
        except BaseException:
            delete_path(self.spark, path)
            raise
        return Part(name, _nullable(df.schema), int(seen.get["rows"]))

    def _commit(self, layer: str, table: str, snapshot: Snapshot) -> str:
        path = self._manifest(layer, table, snapshot.version)
        if not create_text(self.spark, f"{path}.json", snapshot.to_json()):
            raise ConcurrentLoad(
                f"{layer}.{table}: version {snapshot.version} has been committed by another writer"
            )
        return path

    def _discard(self, layer: str, table: str, part: Part) -> None:
        delete_path(self.spark, f"{self._folder(layer, table)}/{part.folder}")

    def overwrite(
        self, df: DataFrame, layer: str, table: str, partition_by: Sequence[str] = (), few: bool = False
    ) -> str:
        """Replace contents, schema and partition columns; earlier versions stay readable until
        ``keep_last``. Of two writers that start from the same version the later one to finish
        raises ``ConcurrentLoad``, and the table is what the first one wrote. ``few``: the partition
        columns have a handful of values, so rows need not move to be written."""
        version = max(self._versions(layer, table), default=0) + 1
        part = self._write(df, layer, table, partition_by, few)
        try:
            return self._commit(
                layer, table, Snapshot(version, part.schema, tuple(partition_by), (part,))
            )
        except BaseException:
            self._discard(layer, table, part)
            raise

    def append(self, df: DataFrame, layer: str, table: str) -> str:
        """Add rows to the table (or start it), below its partition columns. Columns may be added
        over time and a column keeps the wider of two types; earlier files stay as they are.
        Another writer's commit in between is no conflict."""
        before = self.snapshot(layer, table)
        if before is None:
            by: tuple[str, ...] = ()
        else:
            widened(before.schema, df.schema, f"{layer}.{table}")
            by = before.partition_by
            absent = [c for c in by if c not in df.columns]
            df = df.withColumns({c: F.lit(None).cast(before.schema[c].dataType) for c in absent})
        part = self._write(df, layer, table, by)
        try:
            for _ in range(RETRIES):
                now = self.snapshot(layer, table)
                if now is None:
                    merged = Snapshot(1, part.schema, by, (part,))
                elif now.partition_by != by:
                    raise ConcurrentLoad(f"{layer}.{table} has been given another layout")
                else:
                    schema = widened(now.schema, part.schema, f"{layer}.{table}")
                    merged = Snapshot(now.version + 1, schema, by, (*now.parts, part))
                try:
                    return self._commit(layer, table, merged)
                except ConcurrentLoad:
                    continue
            raise ConcurrentLoad(f"{layer}.{table}: others committed {RETRIES} times in between")
        except BaseException:
            self._discard(layer, table, part)
            raise

    def replace_files(
        self, layer: str, table: str, base: Snapshot, gone: Iterable[str], df: DataFrame | None
    ) -> str:
        """Commit the version after ``base`` in which the files ``gone`` (as ``frame`` names them)
        no longer count and the rows of ``df`` are added. All other files are kept."""
        by_part: dict[str, set[str]] = {}
        for file in gone:
            for p in base.parts:
                if (at := file.find(f"/{p.folder}/")) >= 0:
                    inside = unquote(file[at + len(p.folder) + 2 :])
                    by_part.setdefault(p.folder, set()).add(inside)
        added = None
        parts = [self._without(layer, table, p, by_part.get(p.folder, set())) for p in base.parts]
        if df is not None:
            # few rows from many places: brought together, or each place would leave a file
            together = df if base.partition_by else df.hint("rebalance")
            added = self._write(together, layer, table, base.partition_by)
            parts.append(added)
        schema = base.schema if added is None else widened(base.schema, added.schema, f"{layer}.{table}")
        kept = tuple(p for p in parts if p.files is None or p.files)
        try:
            return self._commit(
                layer, table, Snapshot(base.version + 1, schema, base.partition_by, kept)
            )
        except BaseException:
            if added is not None:
                self._discard(layer, table, added)
            raise

    def _without(self, layer: str, table: str, part: Part, gone: set[str]) -> Part:
        if not gone:
            return part
        only = Snapshot(0, part.schema, (), (part,))
        stored = self._part_frames(layer, table, only)[0]
        files = [unquote(f.split(f"/{part.folder}/", 1)[1]) for f in stored.inputFiles()]
        left = replace(part, files=tuple(f for f in files if f not in gone))
        if part.rows is None:
            return left
        # a scan without columns: the counts come from the files' footers
        lost = replace(part, files=tuple(gone))
        taken = self.frame(layer, table, Snapshot(0, part.schema, (), (lost,))).count()
        return replace(left, rows=part.rows - taken)

    def keep_last(self, layer: str, table: str, loads: int = 1) -> list[str]:
        """Forget all but the newest ``loads`` versions and delete the files that no kept version
        names (what others are writing stays); returns the forgotten manifests. For a time when
        no reader uses older versions."""
        versions = self._versions(layer, table)
        cut = max(0, len(versions) - loads) if loads > 0 else 0
        used = {
            p.folder for v in versions[cut:] for p in self.snapshot(layer, table, v).parts
        }
        paths = []
        for v in versions[:cut]:
            for p in self.snapshot(layer, table, v).parts:
                if p.folder not in used:
                    self._discard(layer, table, p)
            paths.append(self._manifest(layer, table, v))
        for path in paths:
            delete_path(self.spark, f"{path}.json")
        return paths

    # ---------------------------------------------------------------- inventory

    def tables(self, layer: str) -> list[str]:
        return [
            name
            for name in list_names(self.spark, f"{self.root}/{layer}")
            if self.exists(layer, name)
        ]

    def layer_counts(self, layers: Sequence[str] = LAYERS) -> DataFrame:
        """Tables and rows per layer; layers without tables report zeros. Reads manifests only."""
        found = []
        for layer in layers:
            counts = [self.rows(layer, table) for table in self.tables(layer)]
            found.append((layer, len(counts), sum(counts)))
        return self.spark.createDataFrame(found, "layer string, tables long, rows long")

    def row_counts(self, layer: str) -> DataFrame:
        """Rows of every table of one layer. Reads manifests only."""
        found = [(table, self.rows(layer, table)) for table in self.tables(layer)]
        return self.spark.createDataFrame(found, "table string, rows long")
