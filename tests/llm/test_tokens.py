"""Byte-level BPE and packing against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from cairnframe.llm import bpe, packing
from tests.llm.helpers import clashing, documents, saved


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest_rows(tik, rows):
    out = []
    for d, t in rows:
        ids = tik.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_matches_the_library(spark, sf, tik):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in bpe.op8_byte_bpe(spark, sf).collect()), key=str) == digest_rows(tik, rows)


def test_bpe_odd_rows(spark, tik, tmp_path):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = bpe.op8_byte_bpe(spark, saved(clashing(docs), tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == digest_rows(tik, rows)
    assert bpe.roundtrip_digests(documents(spark, [])).collect() == []
    encoded = bpe.encode(docs)
    back = sorted((tuple(r) for r in bpe.decode(encoded).collect()), key=str)
    assert [bytes(b) for _, b in back] == [(t or "").encode() for _, t in sorted(((d, (t or "").encode()) for d, t in rows), key=str) for t in [t.decode()]]


def test_merges_of_single_matches(tik):
    codec = bpe.ByteBpe(P.path(bpe.VOCABULARY), P.PATTERN)
    rnd = random.Random(1)
    alphabets = ["ab", "aaaa", "the ing", "é漢🙂", "0123456789", "\n \t", "abcdefghijklmnopqrstuvwxyz"]
    for n in (1, 2, 3, 7, 20, 90, 400, 3000):
        for a in alphabets:
            t = "".join(rnd.choice(a) for _ in range(n))
            assert codec.encode(t) == tik.encode_ordinary(t)


def test_tokens_are_the_librarys(sf, spark):
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["É́ ö  x y\x1cz \r\n tab\tİstanbul ΣΑΣ it's we'LL 12 a<|endoftext|>b  <|startoftext|>", "", " ", "\n"]
    got = packing.WordTokenizer(P.path(packing.VOCABULARY)).encode(texts)
    for a, b in zip(got, texts):
        assert a.tolist() == t.encode(b, add_special_tokens=False).ids + [1]


def check_packing(rows, pieces, window=2048):
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    left = {}
    for d, x in rows:
        left.setdefault((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])), []).append(1)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= 0.02 * total
    for (d, ids), copies in left.items():
        mine = sorted((p for p in by_doc[d, len(ids)]), key=lambda p: p.start)
        raw = np.array(ids, "<u4")
        fits = [p for p in mine if zlib.crc32(raw[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
        assert sum(p.length for p in fits) >= len(ids) * len(copies)
    assert sum(p.length for p in pieces) == sum(len(ids) * len(c) for (_, ids), c in left.items())


def test_packing(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(rows, packing.op7_packing(spark, sf).collect())


def test_packing_odd_rows(spark, tmp_path):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_packing(rows, packing.op7_packing(spark, saved(clashing(docs), tmp_path)).collect())
    assert packing.pack(documents(spark, [])).collect() == []


def test_pieces_carry_their_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in packing.pack(docs, keep_ids=True).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_open_windows_stay_bounded():
    done = []
    w = packing.OpenWindows(done.append, size=64, most=4)
    rnd = random.Random(3)
    for i in range(500):
        w.add(i, np.arange(rnd.randrange(1, 150), dtype="<u4"))
        assert len(w.held) <= 4
    assert all(sum(len(p[2]) for p in x) >= 64 - packing.SLACK for x in done)


SIGNED = [*"abcXYZJjKİIıßẞſﬁǰÅÅKΣσςäÖÜéÉ'.,;:!?-_/<|>()0123 \n\t\r ́̌̇̀ͅ​漢字かが゙한글ᄒ🙂", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", "\n", "ŉ", "Ǆ", "İ,", "J̌", "H̱"]


def test_tokens_with_marks_and_signs():
    """Texts of combining marks, letters that change when lower-cased, and signs, against the library."""
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(SIGNED) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    tokenizer = packing.WordTokenizer(P.path(packing.VOCABULARY))
    for i in range(0, len(texts), 1000):
        for a, b in zip(tokenizer.encode(texts[i : i + 1000]), texts[i : i + 1000], strict=True):
            assert a.tolist() == t.encode(b, add_special_tokens=False).ids + [1], repr(b)


def test_long_texts_are_cut_at_spaces(monkeypatch):
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    monkeypatch.setattr(packing, "SLICE_CHARS", 50)
    rnd = random.Random(6)
    tokenizer = packing.WordTokenizer(P.path(packing.VOCABULARY))
    for text in ["one two, " * 300, "x" * 400, " " * 200, "é\n" * 120, "y" * 49 + " " + "z" * 200 + "\n, end", *("".join(rnd.choice(SIGNED) for _ in range(700)) for _ in range(50))]:
        assert tokenizer.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids + [1]


def test_remembered_parts_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    tokenizer, fresh = packing.WordTokenizer(P.path(packing.VOCABULARY)), packing.WordTokenizer(P.path(packing.VOCABULARY))
    rnd = random.Random(7)
    for _ in range(200):
        text = " ".join(rnd.choice(["alpha", "Beta,", "gamma.", "İ,", "12", "delta", "ä!", "x" * 80]) for _ in range(8))
        fresh.cache.clear()
        fresh.older.clear()
        assert tokenizer.encode([text])[0].tolist() == fresh.encode([text])[0].tolist()


def test_bpe_of_texts_beyond_a_slice(spark, tik, monkeypatch):
    """Slices of a batch and one text that is longer than a slice give what the library gives."""
    codec = bpe.ByteBpe(P.path(bpe.VOCABULARY), P.PATTERN)
    texts = ["short one", "many words of a longer text " * 60_000, "a" * 300_000, None, "é漢🙂 " * 20_000]
    for _, some in bpe.text_slices(texts, bpe.SLICE_CHARS):
        for t, ids in zip(some, codec.encode_batch(some), strict=True):
            assert ids == tik.encode_ordinary(t)
