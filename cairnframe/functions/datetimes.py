"""Date-time strings: the text is kept as it is, a timestamp is only ever derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.types import DATE_TIME

# The internet date-time grammar, capital T and Z, leap second allowed.
RFC3339 = r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"


def is_valid(c: Column) -> Column:
    """NULL for NULL."""
    return c.rlike(RFC3339) & F.substring(c, 1, 10).try_cast("date").isNotNull()


def as_rfc3339(c: Column) -> Column:
    """The text itself where it is a date-time, NULL elsewhere."""
    text = c.cast("string")
    return F.when(is_valid(text), text)


def from_timestamp(c: Column) -> Column:
    """Text of a timestamp in the session's time zone; UTC prints +00:00."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")


def is_rfc3339(df: DataFrame, column: str) -> bool:
    return df.schema[column].metadata.get("format") == DATE_TIME


def mark_rfc3339(df: DataFrame, column: str) -> DataFrame:
    """``column`` coerced and marked as date-time text."""
    meta = {**df.schema[column].metadata, "format": DATE_TIME}
    return df.withColumn(column, as_rfc3339(F.col(f"`{column}`"))).withMetadata(column, meta)


def to_timestamp(c: Column) -> Column:
    """Instant of a date-time text, fraction dropped; NULL for other text."""
    return F.date_trunc("SECOND", F.try_to_timestamp(as_rfc3339(c)))


def sanitize_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def replace_at(c: Column, where: Column, value: Column) -> Column:
    """The replacement is coerced: what is no date-time becomes NULL."""
    return F.when(where, as_rfc3339(value)).otherwise(c)


def combine(frames: list[DataFrame], column: str) -> DataFrame:
    """Concatenation; every part is coerced."""
    return reduce(DataFrame.unionByName, [mark_rfc3339(f, column) for f in frames])
