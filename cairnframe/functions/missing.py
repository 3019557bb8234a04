"""Missing values: NULL is missing, NaN is a number.

Our own storage needs no placeholder.  These functions serve exchange with
formats that have no NULL: they choose a value that the column does not hold,
encode with it and decode again.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnframe.functions.types import PLACEHOLDER_KEY

# Boolean placeholder, least integer, and the order in which number placeholders are tried.
BOOLEAN_PLACEHOLDER = -1
INTEGER_PLACEHOLDER = -(2**31)
# Where the least integer is a value of the column (it is one here, not missing), the next candidate stands in.
INTEGER_CANDIDATES = [INTEGER_PLACEHOLDER, 2**31 - 1, *range(-1, -65, -1)]
NUMBER_CANDIDATES = [float("inf"), float("-inf"), sys.float_info.max, -sys.float_info.max, *[float(i) for i in range(64)]]


def is_missing(c: Column) -> Column:
    return F.isnull(c)


def any_missing(c: Column) -> Column:
    """Aggregate; false for no rows."""
    return F.coalesce(F.bool_or(F.isnull(c)), F.lit(False))


def string_placeholder(c: Column) -> Column:
    """Aggregate: ``NA`` behind the least number of ``_`` that the column does not hold; NULL if nothing is missing."""
    used = F.collect_set(F.when(c.rlike(r"\A_*NA\z"), F.length(c) - 2))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
    return F.when(any_missing(c), F.concat(F.repeat(F.lit("_"), free), F.lit("NA")))


def number_placeholder(c: Column) -> Column:
    """Aggregate struct (needed, is_nan, value).

    Without NaN in the column NaN itself can stand for missing; otherwise the first candidate that
    the column does not hold does (NULL if it holds them all; ``least_free_number`` goes on from there).
    """
    held = F.collect_set(F.when(c.isin(NUMBER_CANDIDATES), c))
    free = F.get(F.filter(F.array(*[F.lit(x) for x in NUMBER_CANDIDATES]), lambda x: ~F.array_contains(held, x)), F.lit(0))
    has_nan = F.coalesce(F.bool_or(F.isnan(c) & c.isNotNull()), F.lit(False))
    return F.struct(any_missing(c).alias("needed"), (any_missing(c) & ~has_nan).alias("is_nan"), F.when(any_missing(c), F.when(has_nan, free).otherwise(F.lit(float("nan")))).alias("value"))


def least_free_number(df: DataFrame, column: str) -> float:
    """The least of 0, 1, 2, ... that the column does not hold.

    Distinct whole values are numbered by range partitions; the first whose number is not its value
    leaves a gap below it.
    """
    from cairnframe.operators.rows import dense_index

    c = F.col(f"`{column}`").cast("double")
    whole = df.select(c.alias("v")).where("v >= 0 AND v < 9007199254740992 AND v = floor(v)").select(F.col("v").cast("long").alias("v")).distinct()
    numbered = dense_index(whole, "n", F.col("v").asc())
    gap, n = numbered.agg(F.min(F.when(F.col("v") != F.col("n"), F.col("n"))), F.count("*")).first()
    return float(n if gap is None else gap)


def placeholder(df: DataFrame, column: str, version: int = 3):
    """The placeholder of one column as a Python value, None if nothing is missing. Runs one aggregate.

    Before version 3 of the format missing numbers are always NaN, whether the column holds NaN or not.
    """
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return df.agg(string_placeholder(c)).first()[0]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        if version < 3:
            return float("nan") if df.agg(any_missing(c)).first()[0] else None
        got = df.agg(number_placeholder(c.cast("double")).alias("p")).first()["p"]
        return least_free_number(df, column) if got["needed"] and got["value"] is None else got["value"]
    if isinstance(kind, T.BooleanType):
        return BOOLEAN_PLACEHOLDER if df.agg(any_missing(c)).first()[0] else None
    needed, held = df.agg(any_missing(c), F.collect_set(F.when(c.isin(INTEGER_CANDIDATES), c))).first()
    free = [i for i in INTEGER_CANDIDATES if i not in held]
    if needed and not free:
        raise ValueError(f"column '{column}' holds every candidate placeholder")
    return free[0] if needed else None


def encode_missing(df: DataFrame, column: str, version: int = 3) -> DataFrame:
    """``column`` without NULLs; the placeholder, if there is one, is in its metadata. Booleans become 0 and 1."""
    value = placeholder(df, column, version)
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.BooleanType):
        c = c.cast("int")
    meta = dict(df.schema[column].metadata)
    if value is not None:
        c = F.coalesce(c, F.lit(value))
        # JSON has no NaN or infinity: numbers are kept as text
        meta[PLACEHOLDER_KEY] = str(value)
    return df.withColumn(column, c).withMetadata(column, meta)


def decode(c: Column, value, kind: T.DataType | str | None = None) -> Column:
    """Values equal to the placeholder become NULL (NaN equals NaN), then the cast. Without one nothing is replaced."""
    out = c if value is None else F.when(~c.eqNullSafe(F.lit(value)), c)
    return out if kind is None else out.cast(kind)


def parse_placeholder(text: str | None, kind: T.DataType):
    """A placeholder as metadata keep it, as a value of its column's type."""
    if text is None or isinstance(kind, T.StringType):
        return text
    return float(text) if isinstance(kind, (T.DoubleType, T.FloatType)) else int(text)


def decode_missing(df: DataFrame, column: str, kind: T.DataType | str | None = None) -> DataFrame:
    """Inverse of ``encode_missing`` by the placeholder in the metadata."""
    field = df.schema[column]
    value = parse_placeholder(field.metadata.get(PLACEHOLDER_KEY), field.dataType)
    rest = {k: v for k, v in field.metadata.items() if k != PLACEHOLDER_KEY}
    return df.withColumn(column, decode(F.col(f"`{column}`"), value, kind)).withMetadata(column, rest)
