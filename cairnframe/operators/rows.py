"""Row numbers without a single-task window, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Counted rows of a narrow side up to which it is broadcast.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is named, a local session (one machine) gets a temporary one; on a cluster that
    folder would not be shared, and this fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("no checkpoint folder: set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnframe-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/artifacts/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast only if its counted rows allow it; otherwise both sides are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_by_weight(rows: DataFrame, side: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (cut, one row a key, ``weight`` = how many rows have the key).

    Keys that hold more than a quarter of an even partition's rows are joined by broadcast: there
    are fewer than four times the partitions of them, whatever the data.  The rest is shuffled.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = F.lit(max(1000, (side.agg(F.sum(weight)).first()[0] or 0) // (4 * parts)))
    hot = F.broadcast(side.where(F.col(weight) > bound).drop(weight))
    cold = side.where(F.col(weight) <= bound).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def dense_index(df: DataFrame, column: str, *order) -> DataFrame:
    """``df`` with a gapless number from 0 in the order given (or in partition order).

    Rows are range-partitioned and sorted, then numbered per partition; only one count per
    partition reaches the driver.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = cut(laid).withColumn("__at", F.monotonically_increasing_id())
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    offset, offsets = 0, {}
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()):
        offsets[p] = offset
        offset += n
    if not offsets:
        return rows.withColumn(column, F.lit(0).cast("long")).drop("__at")
    # an array by partition number: as long as there are partitions
    starts = F.lit([offsets.get(p, 0) for p in range(max(offsets) + 1)]).cast("array<long>")
    return rows.withColumn(column, F.get(starts, part.cast("int")) + within).drop("__at")


def prefix_sums(df: DataFrame, order: str, value: str, column: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in ``order``.

    Range partitions are summed one by one (one sum per partition reaches the driver) and added up
    inside, so no task ever holds more than its own range.
    """
    rows = cut(df.repartitionByRange(order).sortWithinPartitions(order)).withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))
    total, starts = 0, {}
    for p, n in sorted(tuple(r) for r in rows.groupBy("__part").agg(F.sum(value)).collect()):
        starts[p] = total
        total += n or 0
    offsets = F.lit([starts.get(p, 0) for p in range(max(starts, default=0) + 1)]).cast("array<long>")
    before = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(column, F.coalesce(before, F.lit(0)) + F.get(offsets, F.col("__part"))).drop("__part")
