"""Document fingerprints by a randomised edit embedding (operator 6).

All texts are walked by the same random functions: at step j the walk writes
the character under its pointer and moves on by 0 or 1 as a shared random bit
for (j, character) says.  Texts that differ by few edits meet again after an
edit and write the same characters from there on, so edit distance becomes
Hamming distance between the written strings.  Of each string the positions
with the least position hashes are kept (the sample of a longer text agrees
with that of a shorter one where both reach), hashed to a byte: that is the
fingerprint.  Likeness is the share of sampled positions on which two
fingerprints agree.

``band_keys`` groups sampled positions by their hash into bands for candidate
search; ``near_documents`` links candidates whose likeness is verified.  The
query itself compares neighbours only and uses neither.

Walks run side by side in numpy, one lane per text, ordered by length; the few
longest texts of a batch finish in a plain loop.  The functions repeat with a
period of ``PERIOD`` steps.

The query needs each document's successor.  Texts are shuffled once, straight
to ranges of doc_id; the first document of each range is also sent to the range
before it.  Only one doc_id per range reaches the driver.

Defined results: a null text counts as empty; documents are ordered by doc_id
(nulls first), rows that repeat a doc_id by text; a single document is its own
successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import connected_components, cut, join_by_weight, shuffle_partitions, small, table

SAMPLES = 128
PERIOD = 8192
SEED = 20_240_607
BANDS = 24
LIKENESS = 0.8
#: Fingerprints of a band key in a chunk.
CHUNK = 64
_LANES = 64
_GROUP_CHARS = 2_000_000


@functools.lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """PERIOD x 256 shared random bits; the character byte 0 (beyond the end) never moves."""
    bits = np.random.default_rng(SEED).integers(0, 2, size=(PERIOD, 256), dtype=np.uint8)
    bits[:, 0] = 0
    return bits


@functools.lru_cache(maxsize=1)
def _move_bytes() -> list[bytes]:
    return [row.tobytes() for row in _moves()]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _length(n: int) -> int:
    """Steps of the walk over n characters, in steps of 32: two a character are expected."""
    return (2 * n + n // 4 + 16 + 31) // 32 * 32


@functools.lru_cache(maxsize=8192)
def positions(steps: int) -> np.ndarray:
    """The sampled positions of a walk, ascending: those with the least hashes."""
    if steps <= SAMPLES:
        return np.arange(steps)
    h = _mix(np.arange(steps))
    return np.sort(np.argpartition(h, SAMPLES - 1)[:SAMPLES])


def walk(texts: list[str]) -> list[tuple[int, bytes]]:
    """(steps, sampled characters as bytes) of every text."""
    if not texts:
        return []
    code = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    with np.errstate(over="ignore"):
        byte = ((code.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    byte[byte == 0] = 1
    size = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    byte[first + size] = 0  # a walk stays here
    steps = np.array([_length(n) for n in size])
    order = np.argsort(-steps, kind="stable")
    length = steps[order]
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(start[-1], dtype=np.uint8)
    at = first[order].astype(np.int64)
    moves = _moves()
    live = len(order)
    # the first lane is the longest; ends are multiples of 32, so lanes leave between blocks of steps
    for j0 in range(0, int(length[0]), 32):
        while live and length[live - 1] <= j0:
            live -= 1
        if live < _LANES:
            break
        block = np.empty((32, live), dtype=np.uint8)
        p = at[:live]
        for k in range(32):
            c = byte[p]
            block[k] = c
            p += moves[(j0 + k) % PERIOD][c]
        out[start[:live, None] + np.arange(j0, j0 + 32)] = block.T
    else:
        live = 0
    table_ = _move_bytes()
    whole = byte.tobytes() if live else b""
    for lane in range(live):
        p, end = int(at[lane]), int(length[lane])
        done = bytearray()
        for j in range(j0, end):
            c = whole[p]
            done.append(c)
            p += table_[j % PERIOD][c]
        out[start[lane] + j0 : start[lane] + end] = np.frombuffer(done, np.uint8)
    found: list = [None] * len(texts)
    for lane, i in enumerate(order):
        found[i] = int(length[lane]), out[start[lane] + positions(int(length[lane]))].tobytes()
    return found


def fingerprint_string(fp: tuple[int, bytes]) -> str:
    return f"{fp[0]:x}:{fp[1].hex()}"


def parse(fp: str) -> tuple[int, bytes]:
    steps, _, rest = fp.partition(":")
    return int(steps, 16), bytes.fromhex(rest)


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """Share of the positions sampled by either on which both wrote the same character."""
    if a == b:
        return 1.0
    pa_, pb = positions(a[0]), positions(b[0])
    xa, xb = np.frombuffer(a[1], np.uint8), np.frombuffer(b[1], np.uint8)
    if a[0] == b[0]:
        return float((xa == xb).mean())
    common, ia, ib = np.intersect1d(pa_, pb, assume_unique=True, return_indices=True)
    return float((xa[ia] == xb[ib]).sum() / (len(pa_) + len(pb) - len(common)))


def band_keys(fp: tuple[int, bytes]) -> list[int]:
    """One 64-bit key per band of sampled positions."""
    p = positions(fp[0])
    band = (_mix(p) % np.uint64(BANDS)).astype(np.int64)
    x = np.frombuffer(fp[1], np.uint8)
    keys = []
    for b in range(BANDS):
        mine = band == b
        data = b"%d:" % b + p[mine].astype("<i8").tobytes() + x[mine].tobytes()
        keys.append(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True))
    return keys


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = [t.as_py() or "" for t in batch.column(1)]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= _GROUP_CHARS):
                    size += len(texts[j])
                    j += 1
                fps = [fingerprint_string(f) for f in walk(texts[i:j])]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(fps, pa.string())], names=["doc_id", "n_chars", "fingerprint"])
                i = j

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def band_links(banded: DataFrame, least: float = LIKENESS, chunk: int = CHUNK) -> DataFrame:
    """Verified links (a, b) that join all rows (node, fingerprint, key) of a key whose likeness reaches ``least``.

    A key is cut into chunks; every pair of chunks is compared in full by a task of its own, which
    returns a spanning forest of its links.
    """
    n = shuffle_partitions(banded.sparkSession)
    banded = cut(banded.select("key", "node", "fingerprint"))
    sizes = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    own = banded.join(small(sizes), "key").withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = own.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "fingerprint")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for _, group in itertools.groupby(rows(), key=lambda r: r[:3]):
            members = [(r[3], parse(r[4])) for r in group]
            label = list(range(len(members)))
            out: list[tuple[int, int]] = []
            for i, (a, x) in enumerate(members):
                for j in range(i):
                    if label[i] != label[j] and likeness(x, members[j][1]) >= least:
                        out.append((a, members[j][0]))
                        gone = label[i]
                        label = [label[j] if k == gone else k for k in label]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return placed.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q", "node").mapInArrow(verify, "a long, b long")


def near_documents(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(doc_id, component_id): documents joined by bands in common and verified likeness.

    Equal fingerprints are one node.
    """
    fps = cut(fingerprints(docs).select("doc_id", "fingerprint"))
    nodes = cut(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n")).withColumn("node", F.xxhash64("fingerprint")))

    def keys(batches):
        for batch in batches:
            k = [band_keys(parse(f.as_py())) for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k, pa.list_(pa.int64()))], names=["node", "fingerprint", "keys"])

    banded = nodes.select("node", "fingerprint").mapInArrow(keys, "node long, fingerprint string, keys array<long>").select("node", "fingerprint", F.explode("keys").alias("key"))
    links = band_links(banded, least)
    rooted = cut(nodes.join(connected_components(links), "node", "left").select("fingerprint", "low_id", "n", F.coalesce("component", "node").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count("*").alias("members")))
    known = cut(join_by_weight(rooted, named, ["root"], "members").select("fingerprint", "component_id", "n"))
    return join_by_weight(fps, known, ["fingerprint"], "n").select("doc_id", "component_id")


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ahead) laid out by ranges of doc_id, sorted within each.

    Rows with ``ahead`` close a range: the first of them is the document that follows the
    range's last one (after the last range: the first document of all).
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.select("doc_id")
    bounds = np.array(sorted({int(b) for b in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else [], dtype=np.int64)

    def parts_of(column: pa.Array) -> np.ndarray:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, np.searchsorted(bounds, column.fill_null(0).to_numpy(), side="right"), 0)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(parts_of(column), pa.int32()), column], names=["part", "doc_id"])

    parts = ids.mapInArrow(least, "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    firsts = parts.orderBy("part").collect()
    # first doc_id of a range (None: the rows without one) -> the range before it; before the first comes the last
    back = {None if k == 0 and row["nulls"] else row["first"]: firsts[k - 1]["part"] for k, row in enumerate(firsts)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([column, batch.column(1), pa.array(parts_of(column), pa.int32()), pa.array(np.zeros(len(column), bool))], names=["doc_id", "text", "part", "ahead"])
            at = [(i, back[d]) for i, d in enumerate(column.to_pylist()) if d in back]
            if at:
                some = batch.take(pa.array([i for i, _ in at]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([p for _, p in at], pa.int32()), pa.array(np.ones(len(at), bool))], names=["doc_id", "text", "part", "ahead"])

    placed = d.mapInArrow(place, "doc_id long, text string, part int, ahead boolean")
    return placed.repartitionById(n, F.col("part")).sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text", "ahead")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def successor_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last of them waits for its successor
        size = 0
        closed = False
        for batch in batches:
            for doc_id, text, ahead in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if closed:
                    continue
                held.append((doc_id, text.as_py()))
                closed = ahead
                size += len(held[-1][1])
                if size > _GROUP_CHARS and len(held) > 1 and not closed:
                    yield _compare(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield _compare(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).mapInArrow(run, schema)


def _compare(held: list[tuple]) -> pa.RecordBatch:
    """Rows of all but the last of ``held``."""
    texts = [t for _, t in held]
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    fps = walk(texts + new)
    own, changed = fps[: len(texts)], fps[len(texts) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in held[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
            pa.array([fingerprint_string(f) for f in own[:-1]]),
            pa.array([fingerprint_string(f) for f in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed)]),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])]),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, see ``successor_fingerprints``."""
    return successor_fingerprints(table(spark, sf_dir, "documents"))
