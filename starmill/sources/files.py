"""CSV sources: discovery, loading, writing."""

from __future__ import annotations

import os
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PREFIX = "raw_"


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system and path object behind ``path`` (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted entry names directly below ``path``; empty if it does not exist."""
    fs, target = hadoop_fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, from any file system that Spark reads."""
    fs, target = hadoop_fs(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = hadoop_fs(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


_commits = threading.Lock()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file: all of it appears at once, or, if ``path`` is taken, nothing and the
    answer is False. The file system must rename atomically without overwriting, as HDFS does;
    a local one checks first, so there only the writers of one driver are kept apart."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    never = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = never
    source, target = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path)
    fs, _ = hadoop_fs(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    with _commits:
        try:
            context.rename(source, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            fs.delete(source, False)
            return False
    return True


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_fs(spark, path)
    fs.delete(target, True)


def table_name_of(file_name: str) -> str:
    """``raw_buyers.csv`` -> ``buyers``."""
    stem = os.path.splitext(file_name)[0]
    return stem.removeprefix(RAW_PREFIX)


def discover_sources(spark: SparkSession, folder: str) -> dict[str, str]:
    """``{table: file}`` for every ``*.csv`` (file or folder of parts) in ``folder``."""
    return {
        table_name_of(name): name
        for name in list_names(spark, folder)
        if name.endswith(".csv")
    }


UNCONVERTED = "_unconverted"  # column -> text that does not convert to the declared type
MALFORMED = "_malformed_record"  # the whole line, where it has more or fewer fields than the header


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a CSV with header. Without ``schema`` the types are inferred, which costs one more
    read of the file, so loads at scale should pass one.

    With ``schema`` columns are bound by the header's names. Every field is read as text and
    converted; a value that does not convert becomes NULL and its text is kept in the map column
    ``_unconverted``, a line with too many or too few fields is kept in ``_malformed_record``.
    Columns that the schema does not name stay text; declared columns that the file lacks are
    absent (a contract's ``required_columns`` then blocks the load).
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = {f.name: f.dataType for f in declared.fields}
    header = reader.csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in (*header, MALFORMED)]
    text = (
        reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", MALFORMED)
        .option("enforceSchema", False).csv(path)
    )
    typed = [c for c in header if not isinstance(kinds.get(c, T.StringType()), T.StringType)]
    values = {c: F.trim(c).try_cast(kinds[c]) for c in typed}
    failed = [
        F.when(F.col(c).isNotNull() & values[c].isNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value")))
        for c in typed
    ]
    kept = F.map_from_entries(F.array_compact(F.array(*failed))) if typed else F.lit(None)
    lost = F.when(F.size(kept) > 0, kept) if typed else kept.cast("map<string,string>")
    return text.select(
        *[values[c].alias(c) if c in values else F.col(c) for c in header],
        MALFORMED, lost.alias(UNCONVERTED),
    )


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
