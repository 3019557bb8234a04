"""Byte-level BPE encoding and decoding over a segment tree (operator 8).

A text is cut by the vocabulary's pattern; each match is merged on its own.
For one match a segment tree over its byte positions holds, per live position,
the rank of the pair that starts there; the root gives the leftmost pair of
least rank.  A merge makes three point updates (the merged pair, its right
neighbour that dies, its left neighbour), so a match of n bytes costs
O(n log n) even if it is megabytes of one character.  The trees of short matches
are kept side by side in arrays and take their updates in step.

Encoded matches are remembered per Python worker up to ``CACHE_ENTRIES`` short
matches; the cache changes speed only.

Defined results: a null text is empty and encodes to no ids; lone surrogates
cannot occur in Spark strings; repeated rows and null doc_ids give one row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import table, text_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
#: Matches up to so many bytes are merged side by side, so many at a time.
LANE_BYTES = 32
LANES = 8192
SLICE_CHARS = 1_000_000
_NONE = 1 << 62


class PairTree:
    """Leftmost minimum over pair ranks at byte positions."""

    __slots__ = ("n", "tree")

    def __init__(self, ranks: list[int]):
        n = 1
        while n < len(ranks):
            n *= 2
        # a node is (rank << 32 | position), so the least number is the leftmost least rank
        leaves = [r if r == _NONE else (r << 32) | i for i, r in enumerate(ranks)]
        tree = [_NONE] * n + leaves + [_NONE] * (n - len(leaves))
        for i in range(n - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right
        self.n, self.tree = n, tree

    def least(self) -> int:
        """Position of the leftmost pair of least rank, -1 if none is left."""
        top = self.tree[1]
        return -1 if top == _NONE else top & 0xFFFFFFFF

    def put(self, at: int, rank: int) -> None:
        tree = self.tree
        i = at + self.n
        tree[i] = _NONE if rank == _NONE else (rank << 32) | at
        i >>= 1
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            best = left if left <= right else right
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1


def merge_match(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pattern match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    tree = PairTree([get(piece[i : i + 2], _NONE) for i in range(n - 1)] or [_NONE])
    while (i := tree.least()) >= 0:
        j = end[i]
        k = end[j]
        end[i], end[j] = k, 0
        if j < n - 1:
            tree.put(j, _NONE)
        if k < n:
            before[k] = i
            tree.put(i, get(piece[i : end[k]], _NONE))
        else:
            tree.put(i, _NONE)
        if (b := before[i]) >= 0:
            tree.put(b, get(piece[b : end[i]], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PairRanks:
    """Rank of every pair of tokens that spells a token: an open-addressed table looked up in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int64)
        left = np.array(list(pairs), dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int64)
        slot = self._slot(left)
        while len(left):
            # the first of each free slot's claimants settles, the others move on by one
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            take = free[one]
            self.keys[slot[take]], self.ranks[slot[take]] = left[take], value[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = self._slot(key)
        there = self.keys.take(slot)
        out = self.ranks.take(slot)
        wrong = np.flatnonzero(there != key)
        out[wrong] = _NONE
        wrong = wrong[there[wrong] >= 0]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[wrong]]
            hit = there == key[wrong]
            out[wrong[hit]] = self.ranks[slot[wrong[hit]]]
            wrong = wrong[~hit & (there >= 0)]
        return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.byte_id = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        self.pairs = PairRanks(self.ranks)

    def merge_side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of matches of 2 to ``width`` bytes: the same trees as ``PairTree``, one lane a match.

        A tree's node holds rank * 256 + position, so a lane's root is its leftmost least pair.
        All arrays are flat; a lane owns ``width`` + 1 places and 2 * ``width`` nodes.
        """
        m, places, nodes = len(pieces), width + 1, 2 * width
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        grid = np.zeros((m, places), dtype=np.int64)
        grid[:, :width] = self.byte_id[raw]
        place = np.arange(places)
        live = place < size[:, None]
        after = np.minimum(place + 1, size[:, None]).ravel()
        before = np.tile(place - 1, m)
        tree2 = np.full((m, nodes), _NONE, dtype=np.int64)
        rank = self.pairs.of(grid[:, : width - 1].ravel(), grid[:, 1:width].ravel()).reshape(m, width - 1)
        good = (rank != _NONE) & (place[1:width] < size[:, None])
        tree2[:, width : nodes - 1] = np.where(good, rank << 8 | place[: width - 1], _NONE)
        level = width // 2
        while level:
            tree2[:, level : 2 * level] = np.minimum(tree2[:, 2 * level : 4 * level : 2], tree2[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        tree, symbol, alive = tree2.reshape(-1), grid.reshape(-1), live.reshape(-1)
        levels = width.bit_length() - 1
        lane = np.flatnonzero(tree2[:, 1] != _NONE)
        while len(lane):
            at, root = lane * places, lane * nodes
            top = tree.take(root + 1)
            i, end = top & 255, size.take(lane)
            token = top >> 8
            j = after.take(at + i)
            k = after.take(at + j)
            symbol[at + i] = token
            alive[at + j] = False
            after[at + i] = k
            before[at + k] = i  # the place behind a lane's last byte stands for its end
            b = before.take(at + i)
            first = b < 0
            b = np.where(first, i, b)  # without a left neighbour the merged pair is put twice
            right = self.pairs.of(token, symbol.take(at + k))
            own = np.where((k >= end) | (right == _NONE), _NONE, right << 8 | i)
            left = self.pairs.of(symbol.take(at + b), token)
            left = np.where(first, own, np.where(left == _NONE, _NONE, left << 8 | b))
            tree[root + width + j] = _NONE
            tree[root + width + i] = own
            tree[root + width + b] = left
            node = np.concatenate([j, i, b]) + width
            base = np.concatenate([root, root, root])
            for _ in range(levels):
                child = base + (node & -2)
                node >>= 1
                tree[base + node] = np.minimum(tree.take(child), tree.take(child + 1))
            lane = lane[tree.take(root + 1) != _NONE]
        ids = grid[live].astype("<u4").tobytes()
        stop = np.cumsum(live.sum(axis=1) * 4).tolist()
        return [ids[x:y] for x, y in zip([0, *stop], stop)]

    def merge_all(self, matches: list[str]) -> dict[str, bytes]:
        """Ids of many matches (little-endian 32-bit): short ones side by side, long ones one by one."""
        found: dict[str, bytes] = {}
        short: dict[int, list[tuple[str, bytes]]] = {}
        for t in matches:
            piece = t.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                found[t] = whole.to_bytes(4, "little")
            elif len(piece) > LANE_BYTES:
                found[t] = np.array(merge_match(piece, self.ranks), dtype="<u4").tobytes()
            else:
                short.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append((t, piece))
        for width, some in short.items():
            for i in range(0, len(some), LANES):
                texts, pieces = zip(*some[i : i + LANES], strict=True)
                found.update(zip(texts, self.merge_side_by_side(list(pieces), width), strict=True))
        return found

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        matches = [self.find(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = self.merge_all(list(set().union(*matches).difference(cache)))
        long = {t: ids for t, ids in new.items() if len(t) > CACHE_CHARS}
        cache.update((t, ids) for t, ids in new.items() if t not in long)
        for ms in matches:
            parts = [long[t] if t in long else cache[t] for t in ms] if long else map(cache.__getitem__, ms)
            yield np.frombuffer(b"".join(parts), "<u4").tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digits(self, ids: list[int]) -> str:
        return ",".join(map(self.digits_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(path: str | None, pattern: str | None) -> ByteBpe:
    return ByteBpe(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; ``path`` and ``pattern`` default to the public vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for first, texts in text_slices((t.as_py() for t in batch.column(1)), SLICE_CHARS):
                ids = pa.array(list(codec.encode_batch(texts)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, None)
        for batch in batches:
            out = pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def roundtrip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode the ids, and digest both; ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for _, texts in text_slices((t.as_py() for t in batch.column(1)), SLICE_CHARS):
                for ids in codec.encode_batch(texts):
                    n.append(len(ids))
                    a.append(sha(codec.digits(ids).encode()).hexdigest())
                    b.append(sha(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return roundtrip_digests(table(spark, sf_dir, "documents"))
