"""Shared plumbing of the corpus operators: reading, lineage cuts, size-checked joins, components.

Nothing here knows about a particular operator.  All intermediate results that
are read more than once are cut with ``checkpoint()`` into the folder named by
``spark.checkpoint.dir``, so a lost executor never forces a text pass to rerun
and no machine-local file is needed.
"""

from __future__ import annotations

import gc
import itertools
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.operators.rows import join_by_weight  # noqa: F401  used by the operators

#: Rows of a fixed-width side up to which it may be broadcast; counted, never guessed.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where none is named, a local session (one machine, as in tests) gets a temporary one; on a
    cluster that folder would not be shared, and this fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("no checkpoint folder: set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return context.getCheckpointDir()


def key_runs(batches: Iterator[pa.RecordBatch], columns: int, rows: int = 50_000, size: int = 1 << 25) -> Iterator[list[np.ndarray]]:
    """Runs of sorted rows (as numpy columns) that end where the leading ``columns`` columns change."""
    held: list[pa.RecordBatch] = []
    have = held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.num_rows
        held_bytes += batch.nbytes
        if have < rows and held_bytes < size:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = key_edges(*(whole.column(c).to_numpy() for c in range(columns)))[0]
        if len(at) > 1:
            yield [x.to_numpy(zero_copy_only=False) for x in whole.slice(0, at[-1]).columns]
            held = [whole.slice(at[-1])]
        else:
            held = [whole]
        have, held_bytes = held[0].num_rows, held[0].nbytes
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield [x.to_numpy(zero_copy_only=False) for x in whole.columns]


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of plans that nothing refers to any more, now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keys_and_crowds(batches: Iterator[pa.RecordBatch], most: int, rows: int = 50_000) -> Iterator[tuple[list[np.ndarray], bool]]:
    """(columns, False): rows sorted by their first column, the key, in whole runs of it; (columns, True): rows of a key with more than ``most``.

    A crowded key passes through in pieces, however many rows it has; small keys come whole.
    """
    held: pa.Table | None = None
    crowd = None  # the key that is passing through
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
        if held is None or (batch is not None and held.num_rows < rows):
            continue
        key = held.column(0).to_numpy()
        if crowd is not None:
            n = int(np.searchsorted(key, crowd, side="right"))
            if n:
                yield [c.to_numpy() for c in held.slice(0, n).columns], True
            held, key = held.slice(n), key[n:]
            if not len(key):
                continue
            crowd = None
        last = 0 if key[0] == key[-1] else int(np.searchsorted(key, key[-1], side="left"))
        if batch is None:
            last = len(key)
        if last:
            yield [c.to_numpy() for c in held.slice(0, last).columns], False
        held = held.slice(last)
        if held.num_rows > most:
            yield [c.to_numpy() for c in held.columns], True
            crowd, held = key[-1], held.slice(held.num_rows)
        held = held.combine_chunks()


def key_edges(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, row behind the last) of every run of rows that agree in all columns."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    at = np.flatnonzero(change) + 1
    return np.concatenate([[0], at]), np.concatenate([at, [len(columns[0])]])


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (already cut, fixed-width rows), marked for broadcast only if its row count allows it.

    Beyond ``BROADCAST_ROWS`` the frame comes back unmarked and the planner
    shuffles both sides of the join.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def text_slices(texts: Iterable[str | None], most: int) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) runs of at most ``most`` characters, but one text at least."""
    run: list[str] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``edges``; component is the smallest node.

    Alternates the large-star and small-star rewrites until the edge set stops
    changing.  Neighbour minima are grouped with map-side combine and joined
    back by key, so the hub of a giant component never becomes one unbounded
    group; each round is checkpointed.
    """
    e = cut(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def fingerprint(df: DataFrame):
        return tuple(df.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = fingerprint(e)
    if state[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ).distinct()
        # large has u > v again: every node hangs below smaller neighbours only
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small_star)
        new = fingerprint(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
