"""Logical types of columns and the field metadata that carries them.

A column keeps its Spark type; what the type cannot say (factor levels, their
order, the format of a text, matrix dimensions) lives in field metadata, which
Parquet keeps.  Computed expressions lose it, so every function that computes a
column attaches it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__row_id"
ROW_NAME = "__row_name"

# The names of the four atomic types.
INTEGER, NUMBER, STRING, BOOLEAN = "integer", "number", "string", "boolean"
ATOMIC = {INTEGER: T.IntegerType(), NUMBER: T.DoubleType(), STRING: T.StringType(), BOOLEAN: T.BooleanType()}
# Formats of string columns, and the key of a placeholder in metadata.
DATE, DATE_TIME = "date", "date-time"
PLACEHOLDER_KEY = "missing-value-placeholder"


def logical_type(field: T.StructField) -> str:
    """Logical type of one field: an atomic name, ``factor``, ``struct``, ``list`` or ``other``."""
    if "levels" in field.metadata:
        return "factor"
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return NUMBER
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return STRING
    if isinstance(kind, T.StructType):
        return "struct"
    return "list" if isinstance(kind, (T.ArrayType, T.MapType)) else "other"


def text_format(field: T.StructField) -> str | None:
    """``date``, ``date-time`` or None."""
    if isinstance(field.dataType, T.DateType):
        return DATE
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return DATE_TIME
    return field.metadata.get("format")


def annotate(df: DataFrame, column: str, **values) -> DataFrame:
    """``df`` with ``values`` added to the metadata of ``column``."""
    return df.withMetadata(column, {**df.schema[column].metadata, **values})


def cast_atomic(c: Column, name: str) -> Column:
    """Cast to an atomic type; values that do not fit become missing."""
    if name not in ATOMIC:
        raise TypeError(f"type '{name}' is not supported")
    return c.try_cast(ATOMIC[name])


def check_names(columns: list[str]) -> None:
    """Column names must be unique and non-empty; case matters."""
    if "" in columns:
        raise ValueError("column names must not be empty")
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if twice:
        raise ValueError(f"column names must be unique: {', '.join(map(repr, twice))}")


def versions_as_strings(df: DataFrame, *columns: str) -> DataFrame:
    """Version numbers are stored as plain strings and stay strings."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
