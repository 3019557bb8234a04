"""Bounded-space online packing into fixed windows (operator 7).

Every input partition is packed by itself in one pass: a fixed number of
windows stays open; a document's ids go whole into the open window that they
fill best; if none fits, the fullest open window is topped up with the head of
the document and emitted.  Documents longer than a window give full windows
first.  When a partition ends, its open windows are its leftovers: at most
``OPEN_WINDOWS`` whatever the partition holds.  The leftovers of all partitions
are merged in groups of bounded size, fullest first, into full windows; what
remains of a group at the end is cut into lengths that are powers of two, which
need no padding.

The first pass is checkpointed (piece rows, plus the ids of leftovers only), so
documents are tokenised once even if an executor is lost later.

Defined results: a null or empty text is one end id; null and repeated doc_ids
are packed like others (a piece names its row's doc_id); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import cut, table, text_slices

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
OPEN_WINDOWS = 32
#: A window with so few free places is emitted with padding instead of cutting a document for them.
SLACK = 4
#: Windows that one task merges at most (8 KB of ids each).
MERGE_WINDOWS = 2048
#: Distinct parts in each half of a worker's memory; they change speed only.
CACHE_ENTRIES = 120_000
CACHE_CHARS = 64
SLICE_CHARS = 2_000_000
#: Pieces, and ids with them, that a task gathers before it passes them on.
_ROWS, _IDS = 4096, 500_000
#: Signs that close a word: one run of them is one word of the vocabulary's pattern (the apostrophe has rules of its own).
SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordTokenizer:
    """Ids by the ``tokenizers`` library, remembered per part between spaces.

    The vocabulary's rules never look across a space or line feed (its pattern drops white
    space, and composition treats the characters on both sides apart).  So texts are cut there,
    the parts of many texts are numbered by Arrow, and every distinct part is looked up once and
    given to the library once.  A run of letters before closing signs is cut from them, unless
    lower-casing ends it in something that is no letter and so would join the signs.

    ASCII letters are lower-cased before the cut: the library does so itself behind composition,
    and without combining marks in the text the order of the two makes no difference.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # ids that end a word of the library's
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[ends] = True

    def _ids(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, word: bytes) -> bytes:
        """Ids of a word of ASCII letters: normalised by lower-casing alone, it goes straight to the library's model."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.lower().decode())])

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: given to the library joined by spaces, cut where its words end."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words):  # a letter that lower-casing turns into more than letters
            return [self._ids(w) for w in words]
        raw = ids.tobytes()
        stops = stops.tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that are not remembered."""
        known: dict[bytes, bytes] = {}
        split: list[tuple[bytes, bytes, bytes]] = []
        letters: list[tuple[bytes, str]] = []
        heads: dict[bytes, bytes] = {}
        signs: dict[bytes, bytes] = {}
        for p in parts:
            h = p.rstrip(SIGNS)
            if len(h) == len(p):
                if p.isalpha():
                    known[p] = self._plain(p)
                    continue
            elif h.isalpha():
                ids = heads.get(h) or self.cache.get(h)
                if ids is None:
                    ids = heads[h] = self._plain(h)
                c = p[len(h) :]
                if c not in signs:
                    signs[c] = self._ids(c.decode())
                known[p] = ids + signs[c]
                continue
            word = h.decode()
            if word.isalpha() and word.lower().isalpha():
                letters.append((h, word))
                if len(h) < len(p):
                    split.append((p, h, p[len(h) :]))
            else:
                known[p] = self._ids(p.decode())
        for i in range(0, len(letters), 500):
            some = letters[i : i + 500]
            heads.update(zip((h for h, _ in some), self._many([w for _, w in some]), strict=True))
        apart = {p for p, _, _ in split}
        for p, h, c in split:
            if c not in signs:
                signs[c] = self._ids(c.decode())
            known[p] = heads[h] + signs[c]
        known.update((h, heads[h]) for h, _ in letters if h not in apart)
        return known

    def _lookup(self, parts: list[bytes]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            # what is asked for again moves over from the older half, the rest goes with the next change
            self.older, self.cache = cache, {}
            cache = self.cache
        found = list(map(cache.get, parts))
        missing = [p for p, ids in zip(parts, found) if ids is None]
        if missing:
            older = self.older
            again = {p: older[p] for p in missing if p in older} if older else {}
            known = self._learn([p for p in missing if p not in again]) | again
            cache.update((p, ids) for p, ids in known.items() if len(p) <= CACHE_CHARS)
            found = [known[p] if ids is None else ids for p, ids in zip(parts, found)]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text with the end id behind them."""
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
            return [self._long(texts[0])]
        flat = []
        for t in texts:
            raw = t.encode()
            # no combining mark (their first bytes) and no special token: letters may be lower-cased here
            if t.isascii() or (b"\xcc" not in raw and b"\xcd" not in raw):
                raw = raw.lower() if b"<|" not in raw else raw
            flat.append(raw.replace(b"\n", b" "))
        split = pc.split_pattern(pa.array(flat, pa.binary()), " ")
        off = split.offsets.to_numpy().astype(np.int64)
        numbered = split.values.dictionary_encode()
        blobs = self._lookup(numbered.dictionary.to_pylist())
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        store = np.frombuffer(b"".join(blobs), "<u4")
        part = numbered.indices.to_numpy()
        length = size[part]
        before = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat((np.cumsum(size) - size)[part] - before[:-1], length)
        at += np.arange(len(at))
        stop = before[off[1:]] + np.arange(len(texts))  # where each text's end id goes
        out = np.empty(len(at) + len(texts), "<u4")
        own = np.ones(len(out), bool)
        own[stop] = False
        out[own] = store[at]
        out[stop] = END_ID
        stop = (stop + 1).tolist()
        return [out[a:b] for a, b in zip([0, *stop], stop)]

    def _long(self, text: str) -> np.ndarray:
        """One text too long for a slice, cut at spaces or line feeds."""
        out, at = [], 0
        while at < len(text):
            stop = at + SLICE_CHARS
            if stop < len(text):
                back = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                ahead = [k for k in (text.find(" ", stop), text.find("\n", stop)) if k >= 0]
                stop = back if back > at else min(ahead, default=len(text))
            piece = text[at:stop]
            out.append(self.encode([piece])[0][:-1] if len(piece) <= SLICE_CHARS else np.frombuffer(self._ids(piece), "<u4"))
            at = stop + 1
        out.append(np.array([END_ID], "<u4"))
        return np.concatenate(out)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str | None) -> WordTokenizer:
    return WordTokenizer(path or public_tokenizers.path(VOCABULARY))


class OpenWindows:
    """A fixed number of open windows, least free room first; ``emit`` takes finished ones as lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, emit, size: int = WINDOW, most: int = OPEN_WINDOWS, slack: int = SLACK):
        self.emit, self.size, self.most, self.slack = emit, size, most, slack
        self.free: list[int] = []
        self.held: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at, size = len(ids), 0, self.size
        free, held = self.free, self.held
        while total - at >= size:
            self.emit([(doc_id, at, ids[at : at + size], total)])
            at += size
        while at < total:
            need = total - at
            best = bisect.bisect_left(free, need)  # the window that the rest fills best
            if best < len(free):
                room, pieces = free.pop(best), held.pop(best)
            elif len(free) < self.most:
                room, pieces = size, []
            else:
                room, pieces = free.pop(0), held.pop(0)
                if room > self.slack:
                    pieces.append((doc_id, at, ids[at : at + room], total))
                    at += room
                self.emit(pieces)
                continue
            pieces.append((doc_id, at, ids[at:].copy(), total))  # not a view: the texts' ids need not stay for it
            at = total
            if room == need:
                self.emit(pieces)
            else:
                k = bisect.bisect_left(free, room - need)
                free.insert(k, room - need)
                held.insert(k, pieces)

    def leftovers(self) -> list[list]:
        return [w for w in self.held if w]


def _rows(pieces: list, sequence: int, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in pieces:
        raw = ids.tobytes()
        yield doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep_ids else None
        offset += len(ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def pack(docs: DataFrame, path: str | None = None, keep_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """Pieces of packed sequences; with ``keep_ids`` each piece also carries its ids (little-endian 32-bit)."""

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        base = TaskContext.get().partitionId() << 36
        done: list[tuple] = []
        count = held = 0

        def emit(pieces: list) -> None:
            nonlocal count, held
            done.extend((*row, True) for row in _rows(pieces, base + count, keep_ids))
            count += 1
            held += window if keep_ids else 0

        windows = OpenWindows(emit, window)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, texts in text_slices((t.as_py() for t in batch.column(1)), SLICE_CHARS):
                for doc_id, ids in zip(ids_of[first:], tokenizer.encode(texts)):
                    windows.add(doc_id, ids)
                    if len(done) >= _ROWS or held >= _IDS:
                        yield _sealed(done)
                        done.clear()
                        held = 0
        for pieces in windows.leftovers():
            done.extend((*row, False) for row in _rows(pieces, base + count, True))
            count += 1
        yield _sealed(done)

    passed = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first_pass, _DDL + ", sealed boolean"))
    sealed = passed.where("sealed").drop("sealed")
    left = passed.where("not sealed").drop("sealed")
    n = left.select("sequence_id").distinct().count()
    groups = max(1, -(-n // MERGE_WINDOWS))
    grouped = left.repartition(groups, F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).sortWithinPartitions("sequence_id", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) + (TaskContext.get().partitionId() << 36)
        held: dict[int, list] = {}
        for batch in batches:
            for doc_id, start, _, _, total, sequence, _, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(sequence, []).append((doc_id, start, np.frombuffer(raw, "<u4"), total))
        done: list[tuple] = []
        for k, pieces in enumerate(merge_windows(list(held.values()), window)):
            done.extend(_rows(pieces, base + k, keep_ids))
        yield _batch(done)

    merged = grouped.mapInArrow(merge, _DDL)
    out = sealed.unionByName(merged)
    return out if keep_ids else out.drop("ids")


def _sealed(rows: list[tuple]) -> pa.RecordBatch:
    batch = _batch([r[:-1] for r in rows])
    return batch.append_column("sealed", pa.array([r[-1] for r in rows], pa.bool_()))


def merge_windows(held: list[list], window: int = WINDOW) -> Iterator[list]:
    """Full windows from partly filled ones, fullest first; the rest in powers of two."""
    size = lambda pieces: sum(len(p[2]) for p in pieces)
    pieces = [p for w in sorted(held, key=lambda w: (-size(w), w[0][0] or 0, w[0][1])) for p in w]
    total, left, at = sum(len(p[2]) for p in pieces), 0, 0
    k = 0
    while left < total:
        want = window if total - left >= window else 1 << ((total - left).bit_length() - 1)
        left += want
        out = []
        while want:
            doc_id, start, ids, doc_tokens = pieces[k]
            take = ids[at : at + want]
            out.append((doc_id, start + at, take, doc_tokens))
            want -= len(take)
            at += len(take)
            if at == len(ids):
                k, at = k + 1, 0
        yield out


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents"))
