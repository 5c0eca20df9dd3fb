"""Column classes derived from a Spark schema.

The analysis operators decide what to do with a column from its class:
numeric columns get moments and quantiles, categorical ones get value
counts, datetimes get date parts.  Booleans are categorical for the profile
only; cleaning leaves them alone and models read them as 0/1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, FLOATING_TYPES)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def categorical_columns(df: DataFrame, include_boolean: bool = True) -> list[str]:
    """Text columns, plus booleans when ``include_boolean`` (the profile's view)."""
    return [f.name for f in df.schema.fields
            if is_string(f.dataType) or (include_boolean and is_boolean(f.dataType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def check_columns(df: DataFrame, names, what: str = "column") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} not found: {', '.join(missing)}")
