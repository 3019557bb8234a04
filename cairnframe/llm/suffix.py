"""Repeated-substring removal over common-prefix interval trees (operator 9).

``maximal_repeats`` is the core: an enhanced suffix array (sorted suffixes and
their common-prefix lengths) is scanned with a stack; every interval of the
common-prefix tree knows whether the bytes to the left of its suffixes differ,
and those that do are output as maximal repeat groups with all occurrences.

One array over a whole corpus would fit no machine, so the tree is cut where
equal strings are sure to stay together:

1. Every string of ``LENGTH`` bytes has an anchor, the least-hashed ``ANCHOR``
   bytes in it; equal strings have equal anchors at equal places.  Neighbouring
   strings with one anchor form a block.  A text gives about one block in 37
   bytes; only (anchor hash, block hash, document, position) is shuffled.
2. Under an anchor, blocks are sorted by content hash: the upper levels of the
   tree.  An interval of equal blocks is a repeat group of the whole block; all
   its occurrences but the earliest are repeats.  Copies of a block within one
   slice of a task, and copies of what the task sent for earlier slices, are
   settled before the shuffle, so a passage that a third of all documents hold
   sends about one block per task, not one per document or slice.
3. Anchors under which blocks differ need the lower levels: the bytes of one
   block per content are fetched and ``maximal_repeats`` is run on them.  Under
   an anchor with more than ``BUSY`` contents, blocks are cut into pieces with
   their own longer anchors first and equal pieces of a task are settled; beyond
   ``CROWDED`` contents the pieces are smaller and their anchors longer.

Each byte of an occurrence that is not its group's earliest is removed; the
union over all groups is exactly the bytes covered by a string of ``LENGTH``
bytes that also starts earlier.

Defined results: a null text counts as empty; matches never cross documents;
documents are ordered by doc_id (nulls first), then by a hash of the text; rows
that repeat both doc_id and text are one document, and each gets its result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import cut, release, shuffle_partitions, table

LENGTH = 100
ANCHOR = 28
#: Contents of an anchor beyond which its blocks are cut into pieces of so many windows.
BUSY, BUSY_PIECE = 256, 37
CROWDED, PIECE = 8000, 4
#: Entries of earlier slices that a task remembers, twice.
KEPT = 200_000
_SUB = 16  # sub-buckets of a partition that are held one at a time
_SLICE = 4_000_000  # bytes
_TABLE = np.random.default_rng(41).integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            step = min(have, n - have)
            out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
            have += step
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of any substring of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            terms = _powers(_BASE, n)[:n]
            terms *= _TABLE[data]
            np.cumsum(terms, out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of_all(self, width: int, step: int = 1 << 18) -> np.ndarray:
        """Hashes of all substrings of ``width`` bytes, made in bounded steps."""
        n = len(self.sums) - width
        out = np.empty(n, dtype=np.uint64)
        for a in range(0, n, step):
            p = np.arange(a, min(n, a + step))
            out[a : a + step] = self.of(p, p + width)
        return out

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(start, number of windows, anchor position, anchor hash, block hash) of each block of the
    texts that end at ``ends`` in ``data``; a window is a string of ``length`` bytes in one text."""
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < length:
        return none
    h = Hasher(data)
    hashes = h.of_all(anchor)
    least = hashes & ~np.uint64(0xFFFFFF)
    least |= np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
    span, want = 1, length - anchor + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if want > span:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # anchor of the window that starts here
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    if not len(valid):
        return none
    first = np.ones(len(valid), dtype=bool)
    first[1:] = (np.diff(valid) != 1) | (np.diff(at[valid]) != 0)
    # windows of two texts never share an anchor: the anchor lies in both windows' text
    where = np.flatnonzero(first)
    start = valid[where]
    count = np.diff(np.concatenate([where, [len(valid)]]))
    spot = at[start]
    return start, count, spot, hashes[spot], h.of(start, start + count + length - 1)


def suffix_intervals(common: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the left-diverse intervals of a common-prefix tree, bottom up.

    ``common[i]`` is the common prefix length of suffixes i - 1 and i (common[0] = 0), ``left`` the
    byte before each suffix, negative where there is none (then it differs from all others).
    """
    diverse = -2
    stack = [[0, 0, diverse]]
    for i, depth in enumerate([*common.tolist(), 0]):
        if depth < least:
            depth = 0
        carried = None
        while stack[-1][0] > depth:
            d, lo, char = stack.pop()
            if char == diverse:
                yield d, lo, i - 1
            carried = (lo, char)
            if stack[-1][0] >= depth and stack[-1][0]:
                if stack[-1][2] != char:
                    stack[-1][2] = diverse
                carried = None if stack[-1][0] == depth else carried
        if i == len(common):
            break
        char = int(left[i])
        if stack[-1][0] < depth:
            lo, before = carried if carried is not None else (i - 1, int(left[i - 1]))
            stack.append([depth, lo, diverse if before < 0 else before])
        if stack[-1][0] and stack[-1][2] != char:
            stack[-1][2] = diverse


def maximal_repeats(strings: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string numbers, positions) of every maximal repeat of at least ``least`` bytes."""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    windows = np.maximum(size - least + 1, 0)
    if not windows.sum():
        return
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    owner = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(windows)])[:-1], windows)
    start = first[owner] + offset
    # suffixes whose first ``least`` bytes occur once are leaves of the root
    hashes = Hasher(data).of(start, start + least)
    _, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[inverse] > 1)
    if not len(again):
        return
    owner, offset, start = owner[again], offset[again], start[again]
    rest = size[owner] - offset
    width = int(rest.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    # the length, most significant byte first, stands behind the bytes: of suffixes that differ in NULs at the end only, the shorter goes first
    rows = np.empty((len(start), width + 4), np.uint8)
    rows[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    rows[:, :width][np.arange(width) >= rest[:, None]] = 0
    rows[:, width:] = rest.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(rows.view(f"S{width + 4}").ravel(), kind="stable")
    rows, owner, offset, rest, start = rows[order, :width], owner[order], offset[order], rest[order], start[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.concatenate([[0], np.minimum(common, np.minimum(rest[1:], rest[:-1]))])
    left = np.where(offset > 0, data[start - 1].astype(np.int64), -1)
    for depth, lo, hi in suffix_intervals(common, left, least):
        yield depth, owner[lo : hi + 1], offset[lo : hi + 1]


_ENTRY = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("uid", "<i8"), ("start", "<i8"), ("count", "<i4"), ("off", "<i4")])


def _later_copies(e: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """(entries that are the earliest with their values of ``names``, all others), sorted."""
    e = e[np.lexsort((e["start"], e["uid"], *(e[n] for n in reversed(names))))]
    first = np.ones(len(e), dtype=bool)
    if len(e):
        same = np.ones(len(e) - 1, dtype=bool)
        for n in names:
            same &= e[n][1:] == e[n][:-1]
        first[1:] = ~same
    return e[first], e[~first]


def _unsent(e: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries to send, repeats of what the task sent before, what to keep of both for its next slices).

    ``e`` and ``kept`` hold each content once.  An entry goes out if the task sent no earlier one with
    its content, so a passage that all documents hold leaves a task once (and once more for each
    earlier occurrence that comes later).  What is kept is bounded: forgetting sends an entry again.
    """
    both = np.concatenate([kept, e])
    order = np.lexsort((both["start"], both["uid"], both["content"], both["anchor"]))
    both, mine = both[order], order >= len(kept)
    second = np.flatnonzero((both["anchor"][1:] == both["anchor"][:-1]) & (both["content"][1:] == both["content"][:-1])) + 1
    alone = np.ones(len(both), bool)
    alone[second] = alone[second - 1] = False
    first = np.ones(len(both), bool)
    first[second] = False
    sent = both[mine & first]
    return sent, both[second[mine[second]]], np.concatenate([both[second - 1][:KEPT], both[mine & alone][:KEPT]])


def _slices(uids: list[int], texts: pa.Array) -> Iterator[tuple[list[int], list[bytes], int]]:
    """(uids, texts, first byte): runs of whole texts with about ``_SLICE`` bytes, or one part of a longer text.

    Parts of a text overlap so that every string of ``LENGTH`` bytes lies in one of them.
    """
    run: list[bytes] = []
    ids: list[int] = []
    size = 0
    for uid, text in zip(uids, texts):
        raw = (text.as_py() or "").encode()
        if run and size + len(raw) > _SLICE:
            yield ids, run, 0
            ids, run, size = [], [], 0
        if len(raw) > _SLICE:
            for at in range(0, len(raw) - LENGTH + 1, _SLICE):
                yield [uid], [raw[at : at + _SLICE + LENGTH - 1]], at
            continue
        ids.append(uid)
        run.append(raw)
        size += len(raw)
    if run:
        yield ids, run, 0


def _entries(uids: list[int], raws: list[bytes], at: int = 0) -> np.ndarray:
    ends = np.cumsum([len(r) for r in raws])
    found = blocks(np.frombuffer(b"".join(raws), np.uint8), ends)
    doc = np.searchsorted(ends, found[0], side="right")
    return _filled(found, np.array(uids, dtype=np.int64)[doc], np.concatenate([[0], ends])[doc] - at)


def _union_of_entries(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return union_of(e["uid"], e["start"], e["start"] + e["count"] + LENGTH - 1)


def _filled(found, uid: np.ndarray, begin: np.ndarray) -> np.ndarray:
    start, count, spot, anchor, content = found
    e = np.empty(len(start), dtype=_ENTRY)
    e["anchor"], e["content"], e["uid"], e["start"], e["count"], e["off"] = anchor, content, uid, start - begin, count, spot - start
    return e


_FOUND = "uid long, start long, stop long, off int, anchor long, piece int"


def _found(uid, start, stop, off, anchor, piece) -> pa.RecordBatch:
    n = len(uid)
    null = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(uid, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(stop, pa.int64()),
            null(pa.int32()) if off is None else pa.array(off, pa.int32()),
            null(pa.int64()) if anchor is None else pa.array(np.ascontiguousarray(anchor).view(np.int64)),
            null(pa.int32()) if piece is None else pa.array(piece, pa.int32()),
        ],
        names=["uid", "start", "stop", "off", "anchor", "piece"],
    )


def _upper_levels(docs: DataFrame, n: int) -> DataFrame:
    """Rows of ``_FOUND``: repeats (no anchor), and one block per content of anchors whose contents differ."""
    fields = ["bucket", "entries", "repeats"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, _ENTRY)
        for batch in batches:
            for uids, raws, at in _slices(batch.column(0).to_pylist(), batch.column(1)):
                e, again = _later_copies(_entries(uids, raws, at), "anchor", "content")
                e, known, kept = _unsent(e, kept)
                bucket = ((e["anchor"] >> np.uint64(24)) % np.uint64(n * _SUB)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(e)]])
                packed = [e[a:b].tobytes() for a, b in zip(edges, edges[1:]) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*bucket[edges[:-1]].tolist()] if len(e) else [], pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.nulls(len(packed), pa.binary()),
                    ],
                    names=fields,
                )
                again = np.concatenate([again, known])
                if len(again):
                    # the union of the repeats rides along to any bucket, dealt by the slice's first document
                    spans = np.stack(_union_of_entries(again)).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([(uids[0] * 7919) % (n * _SUB)], pa.int64()), pa.nulls(1, pa.binary()), pa.array([spans], pa.binary())], names=fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None
        for batch in batches:
            for bucket, entries, repeats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket != current:
                    yield from settle(held)
                    held, current = [], bucket
                if repeats.is_valid:
                    yield _found(*np.frombuffer(repeats.as_py(), "<i8").reshape(3, -1), None, None, None)
                if entries.is_valid:
                    held.append(entries.as_py())
        yield from settle(held)

    def settle(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        e, again = _later_copies(np.frombuffer(b"".join(held), _ENTRY), "anchor", "content")
        if len(again):
            yield _found(*_union_of_entries(again), None, None, None)
        _, inverse, contents = np.unique(e["anchor"], return_inverse=True, return_counts=True)
        contents = contents[inverse]
        some = e[contents > 1]
        if len(some):
            contents = contents[contents > 1]
            piece = np.where(contents > CROWDED, PIECE, np.where(contents > BUSY, BUSY_PIECE, 0))
            yield _found(some["uid"], some["start"], some["start"] + some["count"] + LENGTH - 1, some["off"], some["anchor"], piece)

    sent = docs.select("uid", "text").mapInArrow(send, "bucket long, entries binary, repeats binary")
    dealt = sent.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(judge, _FOUND)


def _structs(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields) of a list<struct> column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values
    return offsets, {values.type.field(i).name: values.field(i).to_numpy(zero_copy_only=False) for i in range(values.type.num_fields)}


def _lower_levels(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(uid, start, stop) of repeats among the asked blocks, by their bytes."""
    wanted = asked.groupBy("uid").agg(F.collect_list(F.struct("start", "stop", "off", "anchor", "piece")).alias("asked"))
    texts = docs.select("uid", "text").join(wanted, "uid").select("uid", "text", "asked")
    schema = "key long, uid long, start long, bytes binary, repeat_stop long"
    names = ["key", "uid", "start", "bytes", "repeat_stop"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, field = _structs(batch.column(2))
            uids = batch.column(0).to_pylist()
            plain: list[tuple] = []
            crowded: list[tuple] = []
            for r in range(batch.num_rows):
                raw = (batch.column(1)[r].as_py() or "").encode()
                for x in range(offsets[r], offsets[r + 1]):
                    a, b, key = int(field["start"][x]), int(field["stop"][x]), int(field["anchor"][x])
                    piece = int(field["piece"][x])
                    if not piece:
                        plain.append((key, uids[r], a, raw[a:b], None))
                        continue
                    spot, last = a + int(field["off"][x]), b - LENGTH
                    # windows by the distance of their start from the anchor, ``piece`` distances in one: equal
                    # windows share the bytes that all windows of their piece have in common
                    w = last
                    while w >= a:
                        d0 = (spot - w) // piece * piece
                        low = max(a, spot - d0 - piece + 1)
                        core = raw[spot - d0 : spot - d0 - piece + 1 + LENGTH]
                        k = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=d0.to_bytes(2, "little")).digest(), "little", signed=True)
                        crowded.append((k, uids[r], low, raw[low : w + LENGTH], None))
                        w = low - 1
                if len(plain) + len(crowded) > 20_000:
                    yield pack(plain, crowded)
                    plain, crowded = [], []
            yield pack(plain, crowded)

    def pack(plain: list[tuple], crowded: list[tuple]) -> pa.RecordBatch:
        """All plain rows; of equal crowded pieces the earliest, the others as repeats."""
        crowded.sort(key=lambda p: (p[0], p[3], p[1], p[2]))
        rows = plain
        for i, p in enumerate(crowded):
            copy = i > 0 and crowded[i - 1][0] == p[0] and crowded[i - 1][3] == p[3]
            rows.append((p[0], p[1], p[2], None, p[2] + len(p[3])) if copy else p)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            done = batch.filter(batch.column(4).is_valid())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), done.column(4)], names=["uid", "start", "stop"])
            open_ = batch.filter(batch.column(4).is_null())
            for row in zip(*(open_.column(c).to_pylist() for c in range(4)), strict=True):
                if size > 1_000_000 and row[0] != held[-1][0]:
                    yield scan(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield scan(held)

    def scan(held: list[tuple]) -> pa.RecordBatch:
        uid = np.array([h[1] for h in held], dtype=np.int64)
        begin = np.array([h[2] for h in held], dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length, owner, offset in maximal_repeats([h[3] for h in held]):
            u, s = uid[owner], begin[owner] + offset
            earliest = np.lexsort((s, u))[0]
            rest = np.arange(len(u)) != earliest
            out.append((u[rest], s[rest], s[rest] + length))
        # nested groups cover the same bytes again and again: what leaves the task is their union
        arrays = [pa.array(a, pa.int64()) for a in (union_of(*(np.concatenate([o[k] for o in out]) for k in range(3))) if out else ([], [], []))]
        return pa.RecordBatch.from_arrays(arrays, names=["uid", "start", "stop"])

    pieces = texts.mapInArrow(fetch, schema)
    return pieces.repartition(n, "key").sortWithinPartitions("key").mapInArrow(repeats, "uid long, start long, stop long")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, documents) as (uid, doc_id, text): uid orders documents; doc_id itself where it is unique and never null.

    Rows that repeat both doc_id and text have one uid and are one document.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, ids = d.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("doc_id")).first()
    if (rows or 0) == ids:
        same = d.select(F.col("doc_id").alias("uid"), "doc_id", "text")
        return same, same
    key = d.withColumn("__h", F.xxhash64("text"))
    order = key.select("doc_id", "__h").distinct().repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "__h")
    named = cut(order.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__h").withColumn("uid", F.monotonically_increasing_id()))
    named = named.select(F.col("doc_id").alias("__d"), F.col("__h").alias("__k"), "uid")
    rows = cut(key.join(named, key["doc_id"].eqNullSafe(named["__d"]) & (key["__h"] == named["__k"])).select("uid", "doc_id", "text"))
    return rows, rows.dropDuplicates(["uid"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(uid, start, stop): byte spans of ``docs`` (uid, text) that repeat earlier strings; they may overlap."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    docs = docs.select("uid", "text")
    upper = cut(_upper_levels(docs, n))
    release(spark)
    lower = cut(_lower_levels(docs, upper.where("anchor is not null").select("uid", "start", "stop", "off", "anchor", "piece"), n))
    release(spark)
    return upper.where("anchor is null").select("uid", "start", "stop").unionByName(lower)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) per row of (doc_id, text)."""
    return _removed(docs, lambda kept: kept, "kept binary", pa.binary())


def _removed(docs: DataFrame, of, column: str, kind: pa.DataType) -> DataFrame:
    d, once = numbered(docs)
    spans = repeated_spans(once).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    name = column.split()[0]
    none = F.array().cast("array<struct<start:long,stop:long>>")
    joined = d.join(spans, "uid", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, field = _structs(batch.column(2))
            columns: list[list] = [[], [], [], []]
            for r in range(batch.num_rows):
                raw = (batch.column(1)[r].as_py() or "").encode()
                runs = merge_spans(field["start"][offsets[r] : offsets[r + 1]], field["stop"][offsets[r] : offsets[r + 1]])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for c, v in zip(columns, (of(b"".join(kept)), len(raw), sum(b - a for a, b in runs), len(runs)), strict=True):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", name, "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(apply, f"doc_id long, {column}, n_bytes long, n_removed long, n_spans long")


def union_of(uid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, stop) of the maximal runs that the spans cover in each document."""
    order = np.lexsort((start, uid))
    uid, start, stop = uid[order], start[order], stop[order]
    rank = np.concatenate([[0], np.cumsum(np.diff(uid) != 0)]) << 40  # spans of documents never touch
    reach = np.maximum.accumulate(stop + rank)
    fresh = np.flatnonzero(np.concatenate([[True], (start + rank)[1:] > reach[:-1]]))
    last = np.concatenate([fresh[1:] - 1, [len(uid) - 1]])
    return uid[fresh], start[fresh], (reach - rank)[last]


def merge_spans(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return list(zip(start[fresh].tolist(), stop[np.concatenate([fresh[1:] - 1, [len(stop) - 1]])].tolist()))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = _removed(table(spark, sf_dir, "documents"), lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string", pa.string())
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
