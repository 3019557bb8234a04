"""Properties of the cores, without Spark."""

import base64

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnframe.llm import bpe, packing, pii, suffix
from cairnframe.llm.simhash_wide import segment_keys

CODEC = bpe.ByteBpe(P.path(bpe.VOCABULARY), P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
text = st.text(st.characters(exclude_categories=("Cs",)), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text)
def test_bpe_agrees_with_the_library(t):
    ids = CODEC.encode(t)
    assert ids == TIK.encode_ordinary(t) and CODEC.decode(ids) == t.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=2, max_size=40))
def test_trees_side_by_side_agree_with_one_tree(piece):
    width = max(4, 1 << (len(piece) - 1).bit_length())
    if piece in RANKS:
        return
    (got,) = CODEC.merge_side_by_side([piece], width)
    assert np.frombuffer(got, "<u4").tolist() == bpe.merge_match(piece, RANKS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=30), max_size=6), st.integers(1, 6))
def test_repeats_cover_what_starts_earlier(strings, least):
    raw = [s.encode() for s in strings]
    covered = [bytearray(len(s)) for s in raw]
    for length, owner, offset in suffix.maximal_repeats(raw, least):
        at = sorted(zip(owner.tolist(), offset.tolist()))
        assert len({raw[o][p : p + length] for o, p in at}) == 1
        for o, p in at[1:]:
            covered[o][p : p + length] = b"\1" * length
    seen = set()
    for s, c in zip(raw, covered):
        want = bytearray(len(s))
        for i in range(len(s) - least + 1):
            if s[i : i + least] in seen:
                want[i : i + least] = b"\1" * least
            seen.add(s[i : i + least])
        assert c == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=60), st.integers(1, 6))
def test_packing_loses_nothing(sizes, most):
    done = []
    w = packing.OpenWindows(done.append, size=64, most=most)
    for i, n in enumerate(sizes):
        w.add(i, np.arange(n, dtype="<u4"))
    merged = list(packing.merge_windows(w.leftovers(), 64))
    got = {}
    for window in [*done, *merged]:
        assert sum(len(p[2]) for p in window) <= 64
        for d, start, ids, total in window:
            got.setdefault(d, []).append((start, ids.tolist()))
            assert total == sizes[d]
    for i, n in enumerate(sizes):
        assert [x for _, ids in sorted(got[i]) for x in ids] == list(range(n))
    assert all((n := sum(len(p[2]) for p in window)) & (n - 1) == 0 for window in merged)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 10**12), st.data())
def test_permutation_inverts(size, data):
    n = data.draw(st.integers(0, size - 1))
    c = pii.PiiCipher(b"key")
    there = c.permute(n, size, "t")
    assert 0 <= there < size and c.permute(there, size, "t", back=True) == n


@settings(max_examples=200, deadline=None)
@given(text)
def test_pseudonyms_invert(t):
    c = pii.PiiCipher(b"key")
    assert c.reveal(c.replace(t)[0]) == t


def test_balls_touch_at_two_certain_flips():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, size=(1, 8), dtype=np.uint64)
    low = np.tile(np.arange(5, dtype=np.uint8), (1, 16, 1))
    other = fp ^ np.uint64(0b11)
    assert set(segment_keys(fp, low)[0]) & set(segment_keys(other, low)[0])
    assert segment_keys(fp, low, 24).shape == (1, 16 * 16)
