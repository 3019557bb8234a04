"""SimHash near-duplicates at a similarity (operator 2 for longer distances).

At a Jaccard similarity of 0.8 two fingerprints differ in about 15 % of their
bits, too many for balls around 64 bits.  Here fingerprints are ``WORDS`` * 64
bits wide and the index has ``SEGMENTS`` tables, one per segment.  A small
Hamming ball is enumerated within each segment: the segment itself and its
variants in one of the ``FLIPS`` bits whose majority was closest (those are the
bits in which near copies differ).  Two documents meet if their balls touch in
any segment.

Matches are dismissed by 64 bits carried in the index and by complete
distances.  Keys with more than ``CROWD`` members leave the first pass as they
are: their fingerprints are fetched, the key is cut into chunks, and chunk
pairs are compared in separate tasks that return a spanning set of candidate
links.  No key emits all its pairs and no candidate is dropped.

Distances only find candidates.  What candidate links join is a group; within
each group the sets of shingle hashes are compared, again in chunks, and only
pairs whose Jaccard similarity reaches the asked one are links.

Equal sets are one node.  Null texts count as empty; texts without
words are equal; the kept document of a group is the one with the least doc_id
(nulls last), of repeated rows one stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.llm.common import connected_components, cut, join_by_weight, key_edges, key_runs, keys_and_crowds, release, shuffle_partitions, small
from cairnframe.llm.simhash import SEED

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 8
SEGMENTS = 16
#: Least certain bits of a segment that its ball may flip.
FLIPS = 5
CROWD = 8
CHUNK = 1024
#: Segments whose crowded keys are compared before it is known what is joined already.
FIRST_SEGMENTS = 4
#: Members of a group of candidates in a chunk: the least, and bytes of shingle hashes at most.
SET_CHUNK = 128
_SET_BYTES = 1 << 25
_STEP = 4096
_GATHER = 1 << 21
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, size=WORDS, dtype=np.uint64) | np.uint64(1)


def most_differing(similarity: float = SIMILARITY, bits: int = 64 * WORDS) -> int:
    """Bits in which candidates may differ: what ``similarity`` gives on average and four standard errors."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def segment_bits(n: int | None = None) -> int:
    """Bits of a segment, the same for any number n of fingerprints. The last word takes no part in keys."""
    return 28


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(s, SEED) for s in joined], dtype="<u8"))


def wide_simhash(text: str | None, shingle: int = SHINGLE, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint as WORDS uint64, least certain bits of each segment as SEGMENTS x FLIPS places).

    Every distinct shingle votes once, however often it is repeated.
    """
    return set_simhash(shingle_set(text, shingle), bits)


def set_simhash(h: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """``wide_simhash`` of a set of shingle hashes."""
    if not len(h):
        return np.zeros(WORDS, "<u8"), np.tile(np.arange(FLIPS, dtype=np.uint8), (SEGMENTS, 1))
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(h), _STEP):
        with np.errstate(over="ignore"):
            x = h[i : i + _STEP, None] * _MULTIPLIERS
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x7FB5D329728EA185)
            x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    margin = 2 * ones - len(h)
    fp = np.packbits(margin > 0, bitorder="little").view("<u8")
    segments = np.abs(margin[: SEGMENTS * bits]).reshape(SEGMENTS, bits)
    return fp, np.argsort(segments, axis=1, kind="stable")[:, :FLIPS].astype(np.uint8)


def segment_keys(fp: np.ndarray, low: np.ndarray, bits: int = 20) -> np.ndarray:
    """Index keys, a row for each fingerprint (rows x WORDS): every segment's ball over its least certain bits.

    The radius is one, and two for segments of more than 22 bits.
    """
    plain = np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    value = plain[:, : SEGMENTS * bits].reshape(len(fp), SEGMENTS, bits) @ (1 << np.arange(bits, dtype=np.int64))
    flip = np.int64(1) << low.reshape(len(fp), SEGMENTS, FLIPS).astype(np.int64)
    masks = [np.zeros_like(flip[..., :1]), flip]
    if bits > 22:
        i, j = np.triu_indices(FLIPS, 1)
        masks.append(flip[..., i] | flip[..., j])
    ball = value[..., None] ^ np.concatenate(masks, axis=2)
    return ((np.arange(SEGMENTS, dtype=np.int64)[:, None] << bits) + ball).reshape(len(fp), -1)


def _fingerprints(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(2):
                h = shingle_set(t.as_py(), shingle)
                found.append((hashlib.blake2b(h.tobytes(), digest_size=16).digest(), *(x.tobytes() for x in set_simhash(h, bits))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.binary()) for k in range(3))], names=["rid", "doc_id", "digest", "fp", "low"])

    return docs.select("rid", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "rid long, doc_id long, digest binary, fp binary, low binary")


def wide_links(nodes: DataFrame, bits: int, similarity: float = SIMILARITY) -> DataFrame:
    """Candidate links (a, b) that join all near fingerprints (node, fp, low) with segments of ``bits`` bits."""
    spark = nodes.sparkSession
    n = shuffle_partitions(spark)
    most = most_differing(similarity)
    # the last word decides first, with five standard errors
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most_of_64 = math.ceil(64 * p + 5 * math.sqrt(64 * p * (1 - p)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                b = batch.slice(s, 2000)
                fp = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
                low = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(fp), -1)
                keys = segment_keys(fp, low, bits)
                # the last word takes no part in the keys
                code = np.repeat(fp[:, -1].astype("<u8").view("<i8"), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1])), pa.array(code)], names=["key", "node", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node, code), crowded in keys_and_crowds(batches, CROWD):
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.nulls(len(key), pa.int64())], names=["key", "a", "b"])
                continue
            start, stop = key_edges(key)
            size = stop - start
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for k in np.unique(size[(size > 1) & (size <= CROWD)]):
                i, j = np.triu_indices(k, 1)
                at = start[size == k]
                for c in range(0, len(at), max(1, 1_000_000 // len(i))):
                    x = (at[c : c + max(1, 1_000_000 // len(i)), None] + i).ravel()
                    y = (at[c : c + max(1, 1_000_000 // len(i)), None] + j).ravel()
                    near = np.bitwise_count((code[x] ^ code[y]).view(np.uint64)) <= most_of_64  # of signed numbers it would count the absolute value
                    out.append((node[x[near]], node[y[near]]))
            if out:
                a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])
            crowd = np.repeat(size > CROWD, size)
            if crowd.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[crowd]), pa.array(node[crowd]), pa.nulls(int(crowd.sum()), pa.int64())], names=["key", "a", "b"])

    filed = nodes.select("node", "fp", "low").mapInArrow(index, "key long, node long, code long").repartition(n, "key").sortWithinPartitions("key", "node")
    met = cut(filed.mapInArrow(meet, "key long, a long, b long"))
    release(spark)
    pairs = met.where("key is null").select("a", "b").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, WORDS) for c in (2, 3))
            near = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    crowded = met.where("key is not null").select("key", F.col("a").alias("node"))
    chunks = cut(crowded.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    chunked = crowded.join(small(chunks), "key").withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    prints = nodes.select("node", "fp")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, other, node, group, fp in key_runs(batches, 3):
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(*key_edges(key, own, other)):
                x = np.frombuffer(b"".join(fp[s:e]), "<u8").reshape(-1, WORDS)
                alone = (group[s:e] == node[s:e]).all()
                out.append(_spanning(x, node[s:e], most) if alone else _joining(x, node[s:e], group[s:e], most))
            arrays = [pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    def spanned(placed: DataFrame) -> DataFrame:
        dealt = placed.join(prints, "node").select("key", "own", "other", "node", "group", "fp").repartition(n, "key", "own", "other")
        return dealt.sortWithinPartitions("key", "own", "other", "node").mapInArrow(span, "a long, b long")

    # first inside the chunks of crowded keys of some segments: members of one group share many keys, and each more would only repeat their links
    few = chunked.where(F.shiftright("key", bits) < FIRST_SEGMENTS)
    first = cut(connected_components(spanned(few.withColumn("other", F.lit(0)).withColumn("group", F.col("node")))))
    # then pairs of small keys that are not joined by that
    ca, cb = (first.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "b"))
    fa, fb = (nodes.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}")) for c in ("a", "b"))
    apart = pairs.join(ca, "a", "left").join(cb, "b", "left").where(~F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False)))
    plain = apart.join(fa, "a").join(fb, "b").select("a", "b", "fp_a", "fp_b").mapInArrow(verify, "a long, b long")
    release(spark)
    roots = cut(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(plain)))
    # then every key again, between and inside its chunks, but only what is not joined yet: members outside the key's largest component against all others
    known = cut(chunked.join(roots, "node", "left").select("key", "node", "chunks", "own", F.coalesce("component", "node").alias("component")))
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    open_keys = cut(sizes.select("key", F.col("most.component").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / CHUNK).cast("int").alias("rests")).where("rests > 0"))
    still = known.join(small(open_keys), "key")
    against = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    outside = still.where("component <> largest").withColumn("other", F.pmod(F.xxhash64("node", F.lit(1)), "rests").cast("int")).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ("key", "own", "other", "node", F.col("component").alias("group"))
    between = spanned(against.select(*columns).unionByName(outside.select(*columns)))
    return roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(between)


def _spanning(fp: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join everything within ``most`` bits in the rows: a breadth-first forest."""
    left = np.arange(len(fp))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        k = queue.pop()
        if not len(left):
            break
        near = np.bitwise_count(fp[left] ^ fp[k]).sum(axis=1) <= most
        found = left[near]
        a.append(np.full(len(found), node[k]))
        b.append(node[found])
        queue += found.tolist()
        left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _joining(fp: np.ndarray, node: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join everything within ``most`` bits in the rows, where rows of one ``group`` are joined already.

    Rows outside the largest group are compared with all that they are not joined with.
    """
    groups, label, size = np.unique(group, return_inverse=True, return_counts=True)
    a: list[int] = []
    b: list[int] = []
    for k in np.flatnonzero(label != size.argmax()):
        other = np.flatnonzero(label != label[k])
        near = other[np.bitwise_count(fp[other] ^ fp[k]).sum(axis=1) <= most]
        if len(near):
            found, first = np.unique(label[near], return_index=True)
            a += [int(node[k])] * len(found)
            b += node[near[first]].tolist()
            label[np.isin(label, found)] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _alike(node: np.ndarray, group: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], similarity: float, most: int) -> tuple[list[int], list[int]]:
    """Links that join all rows whose sets reach ``similarity``; rows of one ``group`` are joined already."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(flat) + 1, bool)
    label = group.copy()
    a: list[int] = []
    b: list[int] = []
    for k in range(len(sets) - 1):
        rest = np.arange(k + 1, len(sets))
        rest = rest[(label[k + 1 :] != label[k]) & (np.minimum(size[k], size[k + 1 :]) >= similarity * np.maximum(size[k], size[k + 1 :]) - 1e-9)]
        rest = rest[(np.bitwise_count(fp[rest] ^ fp[k]).sum(axis=1) <= most) & (size[rest] > 0)]
        if not len(rest):
            continue
        marked[flat[start[k] : start[k] + size[k]]] = True
        step = max(1, _GATHER // int(size[rest].max()))
        for c in range(0, len(rest), step):
            some = rest[c : c + step]
            first = np.cumsum(size[some]) - size[some]
            at = np.repeat(start[some] - first, size[some]) + np.arange(size[some].sum())
            common = np.add.reduceat(marked[flat[at]].astype(np.int64), first)
            for j in some[common * (1 + similarity) >= similarity * (size[some] + size[k]) - 1e-9]:
                if label[j] != label[k]:
                    a.append(int(node[k]))
                    b.append(int(node[j]))
                    label[label == label[j]] = label[k]
        marked[flat[start[k] : start[k] + size[k]]] = False
    return a, b


def similar_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) between nodes of one group of ``candidates`` (node, component) whose shingle sets reach ``similarity``.

    First inside the chunks of each group, then between chunks for what is not joined yet.
    """
    n = shuffle_partitions(docs.sparkSession)
    most = most_differing(similarity)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                b = batch.slice(s, 500)
                sets = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sets], names=["key", "node", "fp", "grams"])

    members = cut(nodes.join(candidates, "node").select(F.col("component").alias("key"), "node", "fp"))
    texts = docs.select(F.col("rid").alias("node"), F.col("text").cast("string").alias("text")).join(small(members), "node")
    sets = cut(texts.select("key", "node", "fp", "text").mapInArrow(grams, "key long, node long, fp binary, grams binary"))
    rows = F.least(F.lit(CHUNK), F.greatest(F.lit(SET_CHUNK), F.sqrt(8 * F.count("*"))))
    sizes = sets.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / rows, F.sum(F.length("grams")) / F.lit(_SET_BYTES))).cast("int").alias("chunks"))
    sizes = cut(sizes.withColumn("chunks", F.greatest("chunks", F.lit(1))))
    chunked = cut(sets.select("key", "node").join(small(sizes), "key").withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, other, node, group, fp, grams_ in key_runs(batches, 3):
            a: list[int] = []
            b: list[int] = []
            for s, e in zip(*key_edges(key, own, other)):
                x = np.frombuffer(b"".join(fp[s:e]), "<u8").reshape(-1, WORDS)
                found = _alike(node[s:e], group[s:e], x, [np.frombuffer(g, "<u8") for g in grams_[s:e]], similarity, most)
                a += found[0]
                b += found[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def compared(placed: DataFrame) -> DataFrame:
        columns = ("key", "own", "other", "node", "group", "fp", "grams")
        dealt = placed.join(sets.select("node", "fp", "grams"), "node").select(*columns).repartition(n, "key", "own", "other")
        return dealt.sortWithinPartitions("key", "own", "other", "node").mapInArrow(compare, "a long, b long")

    inside = compared(chunked.withColumn("other", F.lit(0)).withColumn("group", F.col("node")))
    roots = cut(connected_components(inside))
    known = cut(chunked.where("chunks > 1").join(roots, "node", "left").withColumn("group", F.coalesce("component", "node")).select("key", "node", "chunks", "own", "group"))
    counts = known.groupBy("key", "chunks", "group").agg(F.count("*").alias("n")).groupBy("key", "chunks").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("n"))
    # members outside the largest class of a group against all others
    rests = F.ceil((F.col("n") - F.col("most.n")) * F.col("chunks") / F.col("n")).cast("int")
    open_keys = cut(counts.select("key", F.col("most.group").alias("largest"), rests.alias("rests")).where("rests > 0"))
    still = known.join(small(open_keys), "key")
    against = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    outside = still.where("group <> largest").withColumn("other", F.pmod(F.xxhash64("node", F.lit(1)), "rests").cast("int"))
    outside = outside.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ("key", "own", "other", "node", "group")
    between = compared(against.select(*columns).unionByName(outside.select(*columns)).distinct())
    return roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(between)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, component, kept) of rows (rid, doc_id, text); rid is any unique long."""
    bits = segment_bits(None)
    rows = cut(_fingerprints(docs, shingle, bits))
    nodes = cut(rows.groupBy("digest").agg(F.min("rid").alias("node"), F.any_value("fp").alias("fp"), F.any_value("low").alias("low"), F.count("*").alias("n")))
    release(docs.sparkSession)
    candidates = cut(connected_components(wide_links(nodes, bits, similarity)))
    release(docs.sparkSession)
    roots = connected_components(similar_links(docs, nodes, candidates, similarity, shingle))
    rooted = cut(nodes.join(roots, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component")))
    grouped = cut(join_by_weight(rows.select("rid", "doc_id", "digest"), rooted, ["digest"], "n").select("rid", "doc_id", "component"))
    # one row of each component; joined by the row, which is unique, not by the component
    best = grouped.groupBy("component").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("rid"))
    kept = best.select("rid", F.lit(True).alias("kept"))
    return grouped.join(kept, "rid", "left").select("rid", "doc_id", "component", F.coalesce("kept", F.lit(False)).alias("kept"))
