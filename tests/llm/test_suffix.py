import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.llm import suffix
from tests.llm.helpers import clashing, documents, saved


def brute(rows, length=100):
    """rows in order (text) -> (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), []
    for t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, path):
    return sorted((tuple(r) for r in suffix.op9_repeats(spark, path).collect()), key=str)


def test_table_against_brute_force(spark, sf):
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    want = sorted(((d, *w) for (d, _), w in zip(rows, brute([t for _, t in rows]))), key=str)
    assert run(spark, sf) == want


def made(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoin é漢") for _ in range(rnd.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randrange(8, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 60))) for _ in range(3)]
        parts[1:1] = [rnd.choice(passages)] * rnd.randrange(0, 3)
        t = rnd.choice(["", "\n", "x"]).join(parts)
        if rnd.random() < 0.2:
            t += "ab" * rnd.randrange(20, 200)
        if rnd.random() < 0.2 and texts:
            i = rnd.randrange(max(1, len(t)))
            t = rnd.choice(texts) + t[i:]
        texts.append(t)
    return texts


@pytest.mark.parametrize("busy, crowded", [(suffix.BUSY, suffix.CROWDED), (1, suffix.CROWDED), (1, 1), (2, 6)])
def test_made_texts(spark, tmp_path, monkeypatch, busy, crowded):
    monkeypatch.setattr(suffix, "BUSY", busy)
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    texts = made(3)
    rows = [(i * 5, t, "en", "s", 1) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    path = saved(documents(spark, rows).repartition(7), tmp_path)
    want = sorted(((i * 5, *w) for i, w in enumerate(brute(texts))), key=str)
    assert run(spark, path) == want


def test_odd_rows(spark, tmp_path):
    docs = documents(spark)
    path = saved(clashing(docs), tmp_path)
    got = run(spark, path)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in keyed})
    result = {(k[0] and k[1], k[3]): w for k, w in zip(order, brute([k[3] for k in order]))}
    want = sorted(((r.doc_id, *result[r.doc_id is not None and r.doc_id, r.text]) for r in keyed), key=str)
    assert got == want
    assert suffix.remove_repeats(documents(spark, [])).collect() == []


def test_maximal_repeats_have_all_occurrences():
    rnd = random.Random(8)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 40))).encode() for _ in range(12)]
    least = 6
    groups = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                groups.setdefault(s[a:b], []).append((i, a))
    want = set()
    for text, at in groups.items():
        lefts = {strings[i][a - 1] if a else (i, a) for i, a in at}
        rights = {strings[i][a + len(text)] if a + len(text) < len(strings[i]) else (i, a) for i, a in at}
        if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
            want.add((len(text), tuple(sorted(at))))
    got = {(int(n), tuple(sorted(zip(o.tolist(), p.tolist())))) for n, o, p in suffix.maximal_repeats(strings, least)}
    assert got == want


def test_blocks_cover_every_window_once():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc ") for _ in range(n)).encode() for n in (0, 99, 100, 101, 700, 5, 350)] + [b"aa" * 300]
    ends = np.cumsum([len(t) for t in texts])
    start, count, spot, anchor, content = suffix.blocks(np.frombuffer(b"".join(texts), np.uint8), ends)
    windows = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count)])
    begin = np.concatenate([[0], ends[:-1]])
    want = np.concatenate([np.arange(b, max(b, e - 99)) for b, e in zip(begin, ends)])
    assert windows.tolist() == want.tolist()


@pytest.mark.parametrize("alphabet", ["a\0", "\0\1", "ab\0é"])
def test_texts_with_nuls(spark, tmp_path, alphabet):
    """Suffixes that differ by NULs at their ends only; many short periods."""
    rnd = random.Random(len(alphabet))
    texts = []
    for _ in range(120):
        base = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 60)))
        t = base * rnd.randrange(1, 8) + "\0" * rnd.randrange(0, 130) * rnd.randrange(0, 2)
        texts.append(t + rnd.choice(texts)[rnd.randrange(0, 30) :] if texts and rnd.random() < 0.5 else t)
    path = saved(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(5), tmp_path)
    assert run(spark, path) == sorted(((i, *w) for i, w in enumerate(brute(texts))), key=str)


def test_maximal_repeats_with_nuls():
    rnd = random.Random(4)
    for _ in range(150):
        strings = [bytes(rnd.choice(b"\0\0a") for _ in range(rnd.randrange(0, 30))) for _ in range(6)]
        seen, want = set(), set()
        for i, s in enumerate(strings):
            for a in range(len(s) - 4):
                if s[a : a + 5] in seen:
                    want |= {(i, k) for k in range(a, a + 5)}
                seen.add(s[a : a + 5])
        got = set()
        for n, owner, at in suffix.maximal_repeats(strings, 5):
            for i, a in sorted(zip(owner.tolist(), at.tolist()))[1:]:
                got |= {(i, k) for k in range(a, a + int(n))}
        assert got == want


def test_rows_that_repeat_a_document(spark, tmp_path):
    """One document in two rows is no copy of itself; another document with its text is."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text + "!", "en", "s", 1), (None, "y" * 150, "en", "s", 1)]
    got = run(spark, saved(documents(spark, rows), tmp_path))
    order = [(None, "y" * 150), (1, text)]
    assert sum(r[2] for r in got if r[0] == 1) == 0 and sum(r[2] for r in got if r[0] == 2) >= 2 * len(text) - 1
    assert [r for r in got if r[0] is None][0][2] == brute([order[0][1]])[0][1]


def test_parts_of_long_texts(spark, tmp_path, monkeypatch):
    """Texts longer than a slice go in overlapping parts, and tasks forget what they sent; the result stays."""
    monkeypatch.setattr(suffix, "_SLICE", 700)
    monkeypatch.setattr(suffix, "KEPT", 3)
    texts = [*made(5, 25), "a" * 5000, "ab" * 1500, "x" * 99]
    path = saved(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(3), tmp_path)
    assert run(spark, path) == sorted(((i, *w) for i, w in enumerate(brute(texts))), key=str)


def test_entries_of_a_task_are_sent_once():
    e = suffix._later_copies(suffix._entries([5], [b"".join(b"%d " % i for i in range(300))]), "anchor", "content")[0]
    later = e.copy()
    later["uid"] = 9
    earlier = e.copy()
    earlier["uid"] = 2
    sent, known, kept = suffix._unsent(e, np.zeros(0, suffix._ENTRY))
    assert len(sent) == len(e) and not len(known)
    sent, known, kept = suffix._unsent(later, kept)
    assert not len(sent) and len(known) == len(e) and (known["uid"] == 9).all()
    sent, known, kept = suffix._unsent(earlier, kept)
    assert len(sent) == len(e) and not len(known) and (kept["uid"] == 2).all()
