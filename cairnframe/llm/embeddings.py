"""Embedding near-duplicates with randomised-rotation binary codes (operator 1).

Every unit vector o is padded and rotated by one shared random rotation P; once, its code is made
and stored: the packed signs s of P o, the correction factor f = <s / sqrt(D), P o>, and P o in
four bits a component (randomised rounding, packed as bit planes).  For two vectors o and q
<s / sqrt(D), P q> / f, taken from o's signs and q's planes by bit counts, estimates <o, q> without
bias, and EPSILON standard deviations bound its error with confidence: the variance is
(1 - f^2) / f^2 / (D - 1) times 1 - <o, q>^2 for the signs, and a quarter of a step squared for the
rounding.  A pair whose estimate plus bound stays below the threshold is dismissed on the codes
alone; only for the others are the vectors themselves fetched and the cosine computed in double
precision.

Which pairs are estimated: codes are filed under bands.  A band is a few cross-polytope hashes:
each names the one of ``2 m`` random directions that is nearest.  Their number follows from the
number of vectors and the threshold: a pair at the threshold shares no band with probability
``MISS`` at most, at any size.  A pair counts in the first band it shares only, so links are summed
without ever emitting pairs: what leaves the comparison of codes are vectors that have an open
pair.  A band key with more than ``CHUNK`` vectors is cut into chunks, and chunk pairs go to
separate groups of rows, so no task ever holds more than two chunks of a key at once.

Equal vectors are collapsed first and counted by multiplicity.  Projections use
whole numbers below 2^53 in float64, so a band key never depends on batch shape.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, link with nothing and are their own
component (null id: null component, not kept); vectors of different lengths do
not link; rows that repeat an id count as different vectors; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import connected_components, cut, join_by_weight, key_edges, key_runs, shuffle_partitions, small, table

THRESHOLD = 0.95
EPSILON = 5.0
MISS = 1e-6
CHUNK = 512
SEED = 977
#: Unrelated vectors that a band key should hold.
PER_KEY = 64
PLANES = 4


def share_of_hash(m: int, threshold: float) -> float:
    """Chance that two vectors with this cosine have one cross-polytope hash over m directions.

    The directions are Gaussian, so it depends on nothing else; simulated, three standard errors off.
    """
    rng = np.random.default_rng([SEED, m])
    a = rng.standard_normal((40_000, m))
    b = threshold * a + math.sqrt(1 - threshold**2) * rng.standard_normal(a.shape)
    p = float((_nearest(a[:, None, :]) == _nearest(b[:, None, :])).mean())
    return p - 3 * math.sqrt(p * (1 - p) / len(a))


@functools.lru_cache(maxsize=16)
def bands(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(directions of a hash, hashes of a band, bands) for n vectors: about ``PER_KEY`` unrelated vectors a key."""
    bits = min(28, max(3, math.ceil(math.log2(max(2, n) / PER_KEY))))
    hashes = math.ceil(bits / 7)
    m = 1 << (math.ceil(bits / hashes) - 1)
    same = share_of_hash(m, threshold) ** hashes
    return m, hashes, math.ceil(math.log(miss) / math.log1p(-same))


@functools.lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """dim x D: the part of a random rotation of D dimensions (a multiple of 64) that meets a padded vector."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


@functools.lru_cache(maxsize=4)
def _directions(dim: int, columns: int) -> np.ndarray:
    return np.rint(np.random.default_rng([SEED, dim, columns]).standard_normal((dim, columns)) * 256)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray) -> np.ndarray:
    """Number of the nearest of the 2 m directions (last axis), the negative ones behind the positive."""
    at = np.abs(x).argmax(axis=-1)
    return at + np.where(np.take_along_axis(x, at[..., None], axis=-1)[..., 0] < 0, x.shape[-1], 0)


def band_keys(x: np.ndarray, m: int, hashes: int, count: int) -> np.ndarray:
    """rows x count keys of unit vectors; keys of other bands or dimensions differ."""
    dim = x.shape[1]
    near = _nearest((np.rint(x * 2**24) @ _directions(dim, m * hashes * count)).reshape(len(x), count, hashes, m))
    value = near @ ((2 * m) ** np.arange(hashes, dtype=np.int64))
    return (dim << 42) + (np.arange(count, dtype=np.int64) << 31) + value


class Codes:
    """Codes of unit vectors: made once from the vectors, or read back from their stored form."""

    def __init__(self, signs: np.ndarray, planes: np.ndarray, numbers: np.ndarray):
        self.signs, self.planes, self.numbers = signs, planes, numbers  # n x W, n x PLANES x W uint64, n x 4 float32
        self.width = 64 * signs.shape[1]
        self.factor, self.low, self.step, self.sum = numbers.astype(np.float64).T
        self.ones = np.bitwise_count(signs).sum(axis=1, dtype=np.int64)
        self.spread = np.maximum(0, 1 - self.factor**2) / self.factor**2 / (self.width - 1)
        self.rounding = (self.step / 2) ** 2

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        y = x @ rotation(x.shape[1])
        wide = y.shape[1]
        factor = np.abs(y).sum(axis=1) / math.sqrt(wide)
        low = y.min(axis=1).astype("<f4")
        step = np.maximum((y.max(axis=1) - low) / (2**PLANES - 1), 1e-12).astype("<f4")
        dither = np.random.default_rng([SEED, wide, 1]).random(wide)
        level = np.clip(np.floor((y - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
        word = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8")
        planes = np.stack([word(level >> k & 1) for k in range(PLANES)], axis=1)
        return cls(word(y >= 0), planes, np.stack([factor, low, step, level.sum(axis=1)], axis=1).astype("<f4"))

    def stored(self) -> list[bytes]:
        n = len(self.signs)
        parts = (self.signs.reshape(n, -1).view(np.uint8), self.planes.reshape(n, -1).view(np.uint8), np.ascontiguousarray(self.numbers).view(np.uint8))
        return [r.tobytes() for r in np.concatenate(parts, axis=1)]

    @classmethod
    def read(cls, stored: list[bytes]) -> Codes:
        raw = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), -1)
        words = (raw.shape[1] - 16) // 8 // (1 + PLANES)
        whole = np.ascontiguousarray(raw[:, : words * 8 * (1 + PLANES)]).view("<u8")
        return cls(whole[:, :words], whole[:, words:].reshape(len(raw), PLANES, words), np.ascontiguousarray(raw[:, -16:]).view("<f4"))

    def estimates(self, i, j, beside: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner product, its standard deviation) of vectors i (signs) and j (planes); i and j broadcast.

        ``beside`` is the length of j's part that is orthogonal to i, at most.
        """
        inner = 0
        for w in range(self.signs.shape[1]):
            mine = self.signs[i, w]
            for k in range(PLANES):
                inner = inner + (np.bitwise_count(mine & self.planes[j, k, w]).astype(np.int32) << k)
        rotated = self.low[j] * (2 * self.ones[i] - self.width) + self.step[j] * (2 * inner - self.sum[j])
        return rotated / (math.sqrt(self.width) * self.factor[i]), np.sqrt(self.spread[i] * beside**2 + self.rounding[j] / self.factor[i] ** 2)

    def may_reach(self, i, j, threshold: float) -> np.ndarray:
        """Pairs whose confidence bound reaches the threshold.

        The error of the signs lies in what the other vector has besides this one, which at the
        threshold or above is sqrt(1 - threshold^2) at most.
        """
        estimate, deviation = self.estimates(i, j, math.sqrt(1 - min(1.0, threshold) ** 2))
        return estimate + EPSILON * deviation >= threshold


def _matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    raw = b"".join(column.to_pylist() if isinstance(column, pa.Array) else column)
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(np.float64)


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length each."""
    size = np.array([len(v) for v in batch.column(at).to_pylist()])
    for s in np.unique(size):
        yield batch.filter(pa.array(size == s))


def _groups(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows with their vector's digests, distinct usable vectors with id, least vec_id and multiplicity, numpy's name of their type)."""
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    own = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    v = own.cast("array<double>")
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    seen = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(usable, F.xxhash64(F.lit(1), v)).alias("d1"),
        F.when(usable, F.xxhash64(F.lit(2), v, F.size(v))).alias("d2"),
        F.when(usable, own).alias("v"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = pa.array([np.array(x, kind).tobytes() for x in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], raw], names=["d1", "d2", "rep", "mult", "raw"])

    distinct = seen.where("d1 is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.any_value("v").alias("v"))
    packed = distinct.mapInArrow(pack, "d1 long, d2 long, rep long, mult long, raw binary")
    return seen.select("vec_id", "d1", "d2"), cut(packed.withColumn("g", F.monotonically_increasing_id())), kind


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs, by repeated minima."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs_of(start: np.ndarray, stop: np.ndarray, chunk: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in each group, many at a time: lists of pairs from small groups, and from large ones
    blocks of all pairs between some rows (a column of numbers) and others (a row of numbers)."""
    size = stop - start
    for k in np.unique(size[(size > 1) & (size <= 48)]):
        a, b = np.triu_indices(k, 1)
        at, over = start[size == k], cross[size == k]
        some = max(1, 200_000 // len(a))
        for c in range(0, len(at), some):
            i, j = (at[c : c + some, None] + a).ravel(), (at[c : c + some, None] + b).ravel()
            keep = ~np.repeat(over[c : c + some], len(a)) | (chunk[i] != chunk[j])
            yield i[keep], j[keep]
    for g in np.flatnonzero(size > 48):
        for r in range(start[g], stop[g], 512):
            for c in range(r, stop[g], 512):
                yield np.arange(r, min(r + 512, stop[g]))[:, None], np.arange(c, min(c + 512, stop[g]))[None]


def _chosen(i: np.ndarray, j: np.ndarray, test, chunk: np.ndarray, crossing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that pass ``test``, of a list or a block of them; of a block only i < j, and in groups of two chunks only pairs across."""
    ok = test(i, j)
    if i.ndim == 1:
        return i[ok], j[ok]
    rows, columns = np.nonzero(ok)
    x, y = i[rows, 0], j[0, columns]
    keep = (x < y) & (~crossing[x] | (chunk[x] != chunk[y]))
    return x[keep], y[keep]


def near_links(groups: DataFrame, threshold: float = THRESHOLD, kind: str = "<f8") -> tuple[DataFrame, DataFrame]:
    """(g, n_links) and links (a, b) that connect the same components, of distinct vectors (g, mult, raw)."""
    spark = groups.sparkSession
    m, hashes, count = bands(groups.count(), threshold)
    n = shuffle_partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch, 1) if batch.num_rows else ():
                for s in range(0, part.num_rows, 512):
                    b = part.slice(s, 512)
                    x = unit(_matrix(b.column(1), kind))
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), pa.array(band_keys(x, m, hashes, count).ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(Codes.of(x).stored(), pa.binary()), keys], names=["g", "code", "keys"])

    codes = cut(groups.select("g", "raw").mapInArrow(encode, "g long, code binary, keys array<long>"))
    counts = codes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    rows = codes.select("g", "code", F.explode("keys").alias("key"))
    own = F.pmod(F.xxhash64("g"), F.coalesce("chunks", F.lit(1))).cast("int")
    chunked = rows.join(small(hot), "key", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    placed = chunked.select("key", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "own", "g", "code")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(columns, pairs in groups, crossing) of whole groups whose vectors have one dimension."""
        for columns in key_runs(batches, 3):
            dim = columns[0] >> 42
            for d in np.unique(dim):
                key, ci, cj, chunk, *rest = (c[dim == d] for c in columns)
                start, stop = key_edges(key, ci, cj)
                crossing = ci != cj
                yield (key, ci, cj, chunk, *rest), _pairs_of(start, stop, chunk, crossing[start]), crossing

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, pairs, crossing in runs(batches):
            stored = Codes.read(list(columns[5]))
            open_ = np.zeros(len(crossing), bool)
            for i, j in pairs:
                i, j = _chosen(i, j, lambda a, b: stored.may_reach(a, b, threshold), columns[3], crossing)
                open_[i] = open_[j] = True
            if open_.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[open_]) for c in columns[:5]], names=["key", "ci", "cj", "own", "g"])

    names = "key long, ci int, cj int, own int, g long"
    order = ("key", "ci", "cj", "g")
    open_rows = cut(placed.repartition(n, "key", "ci", "cj").sortWithinPartitions(*order).mapInArrow(estimate, names))
    fetched = open_rows.join(groups.select("g", "mult", "raw"), "g").select("key", "ci", "cj", "own", "g", "mult", "raw")

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _, chunk, g, mult, raw), pairs, crossing in runs(batches):
            x = unit(_matrix(raw, kind))
            keys = band_keys(x, m, hashes, count)
            band = (key >> 31) & 0x7FF
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in pairs:
                block = lambda a, b: x[a[:, 0]] @ x[b[0]].T >= threshold - 1e-9 if a.ndim == 2 else np.ones(len(a), bool)
                i, j = _chosen(i, j, block, chunk, crossing)
                for c in range(0, len(i), 100_000):
                    a, b = i[c : c + 100_000], j[c : c + 100_000]
                    linked = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    a, b = a[linked], b[linked]
                    fresh = (keys[a] == keys[b]).argmax(axis=1) == band[a]  # the first band that the pair shares
                    found.append((a[fresh], b[fresh]))
            i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in range(2))
            if not len(i):
                continue
            weight = np.bincount(i, weights=mult[j], minlength=len(g)) + np.bincount(j, weights=mult[i], minlength=len(g))
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(g[some]), pa.array(weight[some].astype(np.int64)), pa.array(g[_roots(len(g), i, j)[some]])], names=["g", "n", "root"])

    dealt = fetched.repartition(n, "key", "ci", "cj").sortWithinPartitions(*order)
    found = cut(dealt.mapInArrow(recompute, "g long, n long, root long"))
    return found.groupBy("g").agg(F.sum("n").alias("n")), found.select(F.col("g").alias("a"), F.col("root").alias("b")).distinct()


def embedding_components(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) per row of (vec_id, embedding)."""
    seen, groups, kind = _groups(embeddings)
    links, edges = near_links(groups, threshold, kind)
    roots = connected_components(edges)
    g = groups.select("g", "d1", "d2", "rep", "mult").join(links, "g", "left").join(roots, F.col("g") == F.col("node"), "left")
    g = cut(g.select("d1", "d2", "rep", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "g").alias("root")))
    named = cut(g.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")))
    known = cut(join_by_weight(g, named, ["root"], "members").select("d1", "d2", "mult", "n_links", "component_id"))
    columns = ("vec_id", "n_links", "component_id")
    linked = join_by_weight(seen.where("d1 is not null"), known, ["d1", "d2"], "mult").select(*columns)
    return linked.unionByName(seen.where("d1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    out = embedding_components(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component USING (vec_id)
"""
