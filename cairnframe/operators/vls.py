"""Variable-length strings as pointers into byte heaps.

Rows belong to blocks of ``block_rows`` consecutive row numbers.  Each block has
its own heap, so no heap grows with the table; global offsets are a prefix sum
over block totals plus a running sum inside the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnframe.operators.rows import prefix_sums

BLOCK_ROWS = 4096
# Fixed value: bytes of one pointer (two 64-bit numbers).
POINTER_BYTES = 16


def use_vls(c: Column) -> Column:
    """Aggregate: does a fixed-width layout need more bytes than pointers and a heap? False for no rows."""
    size = F.octet_length(c).cast("long")
    return F.coalesce(F.max(size) * F.count(c) > F.sum(size) + POINTER_BYTES * F.count(c), F.lit(False))


def with_blocks(df: DataFrame, row: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn("block", F.floor(F.col(row) / block_rows))


def pointers(df: DataFrame, row: str, text: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with block, offset (from the start of all heaps), block_offset and length, all in bytes."""
    blocked = with_blocks(df, row, block_rows).withColumn("length", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    totals = blocked.groupBy("block").agg(F.sum("length").alias("bytes"))
    starts = prefix_sums(totals, "block", "bytes", "start").select("block", "start")
    inside = Window.partitionBy("block").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("block_offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.join(starts, "block").withColumn("offset", F.col("start") + F.col("block_offset")).drop("start")


def heaps(df: DataFrame, row: str, text: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, heap binary): the bytes of each block's strings in row order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(row).alias("row"), F.col(text).alias("text"))))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return with_blocks(df, row, block_rows).groupBy("block").agg(joined.cast("binary").alias("heap"))


def read(pointed: DataFrame, heap: DataFrame, placeholder: str | None = None) -> DataFrame:
    """``pointed`` (block, block_offset, length, ...) with ``value``: sliced, cut at a NUL, placeholder to NULL."""
    raw = F.substring(F.col("heap"), F.col("block_offset").cast("int") + 1, F.col("length").cast("int")).cast("string")
    text = F.substring_index(raw, "\0", 1)
    value = text if placeholder is None else F.when(text != placeholder, text)
    return pointed.join(heap, "block").withColumn("value", value).drop("heap")


def bounds_violations(pointed: DataFrame, heap: DataFrame) -> DataFrame:
    """Pointers that leave their heap or belong to none."""
    sizes = heap.select("block", F.octet_length("heap").cast("long").alias("heap_bytes"))
    bad = (F.col("block_offset") < 0) | (F.col("length") < 0) | (F.col("block_offset") + F.col("length") > F.coalesce("heap_bytes", F.lit(0)))
    return pointed.join(sizes, "block", "left").where(bad)
