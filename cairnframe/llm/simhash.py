"""SimHash near-duplicates by multi-index hashing (operator 2).

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles.  Fingerprints within two bits are found without comparing pairs:

* the 64 bits are cut into two segments, each with a table.  Of two bits that
  differ one segment has at most one, so every pair meets in a table whose
  keys are the segment's values with the ball of radius one around them;
* of two values that differ in one bit exactly one has it set: a fingerprint is
  filed under its segment's value and under that value with each set bit
  cleared, half the ball, and the pair still meets;
* whatever meets in a table may differ anywhere in the other segment: complete
  distances are compared, and what lies within two bits is linked.

A key holds few fingerprints unless many texts are variants of each other.
Members of keys with more than ``CROWD`` go to a second index instead, exact and
bounded whatever they look like: a covering code of radius one over all 64
bits.  There two fingerprints within two bits of each other have a code in
common, and no code has more than 65 members.

Equal fingerprints are collapsed before the index is built.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; a null doc_id is carried through
(it never becomes a component id unless all its component has none);
repeated doc_ids give one row each; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import connected_components, cut, join_by_weight, key_edges, keys_and_crowds, shuffle_partitions, table

SEED = 42
SEGMENT_BITS = 32
#: Members of a key that are compared with each other in one task.
CROWD = 1024
_STEP = 1 << 16


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(s, SEED) for s in joined], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _STEP):
        ones += np.unpackbits(h[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _mask(bit: int):
    return F.lit((1 << bit) - (1 << 64) if bit == 63 else 1 << bit).cast("long")


def segment_codes(fp) -> list:
    """Table keys of a fingerprint (some null): the table's number above the segment's value or a neighbour of it."""
    codes = []
    for s in range(64 // SEGMENT_BITS):
        value = F.shiftrightunsigned(fp, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        table_ = F.lit(s << SEGMENT_BITS)
        codes.append(table_.bitwiseOR(value))
        for bit in range(SEGMENT_BITS):
            there = value.bitwiseAND(F.lit(1 << bit)) != 0
            codes.append(F.when(there, table_.bitwiseOR(value.bitwiseXOR(F.lit(1 << bit)))))
    return codes


def fingerprint_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of ``fps`` within two bits of each other.

    Every returned link is verified; chains of returned links join exactly the
    fingerprints that chains of distances <= 2 join.
    """
    n = shuffle_partitions(fps.sparkSession)
    # dealt to a fixed number of tasks: the rows are few before the balls are enumerated and many behind
    distinct = fps.select(F.col(fp).alias("f")).distinct().repartition(n, "f")
    filed = distinct.select(F.explode(F.array(*segment_codes(F.col("f")))).alias("code"), "f").where("code is not null")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (code, f), crowded in keys_and_crowds(batches, CROWD):
            start, stop = key_edges(code)
            size = stop - start if not crowded else np.full(len(start), CROWD + 1)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for k in np.unique(size[(size > 1) & (size <= 16)]):
                i, j = np.triu_indices(k, 1)
                at = start[size == k][:, None]
                found.append(_near(f[(at + i).ravel()], f[(at + j).ravel()]))
            for k in np.flatnonzero((size > 16) & (size <= CROWD)):
                found.append(_forest(f[start[k] : stop[k]]))
            rest = f if crowded else f[np.repeat(size > CROWD, size)]
            a = np.concatenate([*(x for x, _ in found), rest])
            b = [x for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *b])), pa.nulls(len(rest), pa.int64())])], names=["a", "b"])

    met = cut(filed.repartition(n, "code").sortWithinPartitions("code", "f").mapInArrow(meet, "a long, b long"))
    crowded = met.where("b is null").select(F.col("a").alias("f")).distinct()
    return met.where("b is not null").unionByName(covered_links(crowded.repartition(n, "f")))


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.bitwise_count((x ^ y).view(np.uint64)) <= 2
    return x[near], y[near]


def _forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members within two bits of each other, fewer than there are members."""
    left, queue = f, []
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count((left ^ at).view(np.uint64)) <= 2
        found = left[near]
        a.append(np.full(len(found), at))
        b.append(found)
        queue += list(found)
        left = left[~near]
    return np.concatenate(a or [f[:0]]), np.concatenate(b or [f[:0]])


def covered_links(distinct: DataFrame) -> DataFrame:
    """``fingerprint_links`` of distinct fingerprints ``f`` by a covering code of radius one over all bits.

    Each is filed under itself and its 64 neighbours; members of a code are linked to the smallest.
    """
    balls = [F.col("f"), *(F.col("f").bitwiseXOR(_mask(bit)) for bit in range(64))]
    entries = distinct.select("f", F.explode(F.array(*balls)).alias("code"))
    met = entries.groupBy("code").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.collect_set("f").alias("members")).where("low < high")
    pairs = met.select(F.col("low").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    fps = cut(fingerprints(docs, shingle))
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(groups))
    rooted = cut(groups.join(roots, groups.fp == roots.node, "left").select("fp", "low_id", "n", F.coalesce("component", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count("*").alias("fps")))
    by_fp = cut(join_by_weight(rooted, named, ["root"], "fps").select("fp", "component_id", "n"))
    return join_by_weight(fps, by_fp, ["fp"], "n").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
