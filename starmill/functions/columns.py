"""Column expressions shared by the operators; all run inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The separator and NULL marker decide the bytes of the change hash.
HASH_SEPARATOR = "||"
HASH_NULL = "NULL"

YES_NO = {"Y": True, "N": False}


def change_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the named columns in the given order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(HASH_NULL)) for c in columns]
    return F.sha2(F.concat_ws(HASH_SEPARATOR, *parts), 256)


def date_key(column: Column | str) -> Column:
    """``yyyymmdd`` as an integer; NULL stays NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def month_key(column: Column | str) -> Column:
    """``yyyymm`` as an integer, the write partition of date-grained facts."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.year(c) * 100 + F.month(c)).cast("int")


def money(column: Column | str, scale: int = 2) -> Column:
    """Exact decimal for arithmetic; doubles round differently from engine to engine."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast(T.DecimalType(18, scale))


def amount(column: Column | str) -> Column:
    """A sum of money before conversion. Times ``exchange_rate`` it fits 38 digits; a value too
    large for it is NULL, so that one bad value does not end a load."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast(T.DecimalType(20, 4))


def exchange_rate(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast(T.DecimalType(17, 12))


def flag_from_text(column: str, mapping: Mapping[str, bool] = YES_NO) -> Column:
    """Text flag to boolean; a value outside the mapping becomes NULL."""
    yes = [text for text, value in mapping.items() if value]
    no = [text for text, value in mapping.items() if not value]
    return F.when(F.col(column).isin(yes), True).when(F.col(column).isin(no), False)


def blank(field: T.StructField) -> Column:
    """NULL or empty text: what the profile counts as missing. Only text can be empty, so other
    types are not turned into text to find out."""
    missing = F.col(field.name).isNull()
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return missing | (F.col(field.name).cast("string") == "")
    return missing


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which values of both are compared: never narrower than either."""
    if left == right:
        return left
    if is_numeric(left) and is_numeric(right):
        if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
            return T.LongType()
        if isinstance(left, T.FractionalType) and isinstance(right, T.FractionalType):
            if not (isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType)):
                return T.DoubleType()
            scale = max(left.scale, right.scale)
            whole = max(left.precision - left.scale, right.precision - right.scale)
            return T.DecimalType(min(38, whole + scale), scale)
        other = left if isinstance(right, T.IntegralType) else right
        if isinstance(other, T.DecimalType):
            return T.DecimalType(min(38, max(19, other.precision - other.scale) + other.scale), other.scale)
        return T.DoubleType()
    times = {T.DateType(): 0, T.TimestampNTZType(): 1, T.TimestampType(): 2}
    if left in times and right in times:
        return max(left, right, key=times.get)
    if isinstance(left, T.StringType):
        return right
    if isinstance(right, T.StringType):
        return left
    return T.StringType()
