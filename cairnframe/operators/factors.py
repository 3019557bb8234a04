"""Dictionary columns: string factors and factors whose levels are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.operators.rows import dense_index, small

#: Levels up to which codes come from an array in the plan; beyond, from a join.
INLINE_LEVELS = 200
MOST_LEVELS = 100_000


def code_of(c: Column, levels: list[str]) -> Column:
    """Zero-based code; values outside the levels and NULL give NULL."""
    return F.nullif(F.array_position(F.lit(levels).cast("array<string>"), c), F.lit(0)).cast("int") - 1


def factor_encode(df: DataFrame, column: str, levels: list[str], ordered: bool = False) -> DataFrame:
    """``column`` as codes, levels and order in its metadata."""
    if len(set(levels)) != len(levels) or None in levels:
        raise ValueError("levels must be unique and not missing")
    meta = {**df.schema[column].metadata, "levels": levels, "ordered": ordered}
    c = F.col(f"`{column}`").cast("string")
    if len(levels) <= INLINE_LEVELS:
        return df.withColumn(column, code_of(c, levels)).withMetadata(column, meta)
    spark = df.sparkSession
    known = spark.createDataFrame(list(enumerate(levels)), "__code int, __level string")
    joined = df.join(small(known), c == F.col("__level"), "left")
    return joined.withColumn(column, F.col("__code")).withMetadata(column, meta).drop("__code", "__level").select(*[f"`{x}`" for x in df.columns])


def factor_levels(df: DataFrame, column: str) -> list[str]:
    """Distinct values in ascending order, ``MOST_LEVELS`` at most: a dictionary is to fit the driver and a field's metadata.

    Columns with more are no factors; ``row_factor_levels`` numbers any number of them without the driver.
    """
    distinct = df.select(F.col(f"`{column}`").cast("string").alias("v")).where("v is not null").distinct()
    found = sorted((r[0] for r in distinct.limit(MOST_LEVELS + 1).collect()), key=lambda v: v.encode())
    if len(found) > MOST_LEVELS:
        raise ValueError(f"column '{column}' has more than {MOST_LEVELS} values")
    return found


def factor_decode(df: DataFrame, column: str) -> DataFrame:
    """Codes back to their levels; NULL and codes without level give NULL."""
    levels = df.schema[column].metadata["levels"]
    meta = {k: v for k, v in df.schema[column].metadata.items() if k not in ("levels", "ordered")}
    code = F.col(f"`{column}`")
    value = F.when(code >= 0, F.get(F.lit(levels).cast("array<string>"), code))
    return df.withColumn(column, value).withMetadata(column, meta)


def with_placeholder(df: DataFrame, column: str, placeholder: int | None = None) -> DataFrame:
    """Codes for formats without NULL: missing becomes the number of levels (or the placeholder given)."""
    n = len(df.schema[column].metadata["levels"]) if placeholder is None else placeholder
    return df.withColumn(column, F.coalesce(f"`{column}`", F.lit(n))).withMetadata(column, df.schema[column].metadata)


def code_violations(df: DataFrame, column: str, n_levels: int) -> DataFrame:
    """Rows whose code has no level."""
    code = F.col(f"`{column}`")
    return df.where(code.isNotNull() & ((code < 0) | (code >= n_levels)))


def row_factor_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` and their code: ascending on all columns, NULL first."""
    distinct = df.select(*[f"`{c}`" for c in columns]).distinct()
    return dense_index(distinct, "code", *[F.col(f"`{c}`").asc_nulls_first() for c in columns]).withColumn("code", F.col("code").cast("int"))


def row_factor_encode(df: DataFrame, columns: list[str], levels: DataFrame) -> DataFrame:
    """``df`` with the code of its level row; NULL equals NULL and NaN equals NaN."""
    right = levels.select(*[F.col(f"`{c}`").alias(f"__l{i}") for i, c in enumerate(columns)], F.col("code").alias("code"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__l{i}")) for i, c in enumerate(columns)])
    return df.join(small(right), same, "left").drop(*[f"__l{i}" for i in range(len(columns))])


def row_factor_decode(codes: DataFrame, levels: DataFrame) -> DataFrame:
    """Codes joined to their level rows."""
    return codes.join(small(levels), "code", "left")


def duplicate_levels(levels: DataFrame, columns: list[str]) -> DataFrame:
    """Level rows that occur more than once, with their count."""
    return levels.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("n")).where("n > 1")
