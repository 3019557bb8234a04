import hashlib
import random

from cairnframe.llm import fingerprint as fpm
from tests.llm.helpers import clashing, documents, saved


def walk_one(text):
    """The embedding step by step."""
    moves = fpm._moves()
    b = [max(1, (ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 24) for c in text] + [0]
    p, out = 0, []
    for j in range(fpm._length(len(text))):
        out.append(b[p])
        p += int(moves[j % fpm.PERIOD][b[p]])
    return len(out), bytes(out[i] for i in fpm.positions(len(out)))


def test_lanes_agree_with_the_plain_walk():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc dé漢🙂") for _ in range(rnd.randrange(0, 300))) for _ in range(150)] + ["x" * 5000, "", "long " * 3000]
    assert fpm.walk(texts) == [walk_one(t) for t in texts]
    assert fpm.walk(texts[:3]) == [walk_one(t) for t in texts[:3]]


def test_likeness_follows_edit_distance():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    near, far = [], []
    for _ in range(40):
        words = [word() for _ in range(300)]
        a = " ".join(words)
        words[rnd.randrange(300)] = word()
        b = " ".join(words)
        c = " ".join(word() for _ in range(300))
        x, y, z = fpm.walk([a, b, c])
        near.append(fpm.likeness(x, y))
        far.append(fpm.likeness(x, z))
    assert min(near) > max(far) and sum(near) / 40 > 0.85 and max(far) < 0.4


def check(rows, got):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        e = fpm.edited(t, nxt)
        x, y, z = walk_one(t), walk_one(e), walk_one(nxt)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fpm.fingerprint_string(x), fpm.fingerprint_string(y), fpm.likeness(x, y), fpm.likeness(x, z)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_successors_on_a_table(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i * 3, " ".join(str(rnd.randrange(99)) for _ in range(rnd.randrange(0, 60))), "en", "s", 1) for i in range(90)]
    rnd.shuffle(rows)
    got = fpm.op6_fingerprint(spark, saved(documents(spark, rows), tmp_path)).collect()
    check([r[:2] for r in rows], got)


def test_odd_rows(spark, tmp_path):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, fpm.op6_fingerprint(spark, saved(clashing(docs), tmp_path)).collect())
    assert fpm.successor_fingerprints(documents(spark, [])).collect() == []
    one = documents(spark, [(5, "only one", "en", "s", 1)])
    check([(5, "only one")], fpm.successor_fingerprints(one).collect())


def test_quarter_edits_are_seen(spark, sf):
    rows = fpm.op6_fingerprint(spark, sf).collect()
    assert len(rows) == 200
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows)
    assert 0.65 < sum(r.near_edited for r in rows) / len(rows) < 0.9
    assert len({(r.fingerprint, r.n_chars) for r in rows}) > 150


def test_near_documents(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    base = [word() for _ in range(400)]
    rows = [(10, " ".join(base), "en", "s", 1), (4, " ".join(base), "en", "s", 1)]
    rows += [(20 + i, " ".join(base[:399] + [word()]), "en", "s", 1) for i in range(5)]
    rows += [(50 + i, " ".join(word() for _ in range(400)), "en", "s", 1) for i in range(5)]
    got = {r.doc_id: r.component_id for r in fpm.near_documents(documents(spark, rows)).collect()}
    assert {got[d] for d in (4, 10, 20, 21, 22, 23, 24)} == {4}
    assert all(got[50 + i] == 50 + i for i in range(5))


def test_all_pairs_of_a_band_key(spark):
    """Near to each other, but neither to the key's first nor to a predecessor in string order."""
    fps = ["00" * 32, "11" * 32, "80" * 32, "ff" * 6 + "11" * 26]
    rows = [(i, f"20:{x}", 7) for i, x in enumerate(fps)]
    for chunk in (1, 64):
        links = fpm.band_links(spark.createDataFrame(rows, "node long, fingerprint string, key long"), chunk=chunk).collect()
        assert {tuple(sorted(r)) for r in links} == {(1, 3)}


def test_groups_of_a_batch_change_nothing(spark, tmp_path, monkeypatch):
    """Texts beyond the size of a group, and groups within a batch."""
    monkeypatch.setattr(fpm, "_GROUP_CHARS", 150)
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abcd ") for _ in range(rnd.choice([0, 5, 60, 149, 150, 151, 700]))), "en", "s", 1) for i in range(70)]
    docs = documents(spark, rows).coalesce(2)
    check([r[:2] for r in rows], fpm.successor_fingerprints(docs).collect())
    assert {r.doc_id: r.fingerprint for r in fpm.fingerprints(docs).collect()} == {d: fpm.fingerprint_string(walk_one(t)) for d, t, *_ in rows}


def test_recall_of_bands_over_all_close_pairs(spark):
    """All pairs of a table whose likeness is 0.8 or more, found by brute force, against the bands."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    fps = {r.doc_id: fpm.parse(r.fingerprint) for r in fpm.fingerprints(docs).collect()}
    got = {r.doc_id: r.component_id for r in fpm.near_documents(docs).collect()}
    ids = sorted(fps)
    close = linked = 0
    for i, a in enumerate(ids):
        some = [b for b in ids[:i] if 0.75 < (fps[b][0] + 1) / (fps[a][0] + 1) < 1.34]
        for b in some:
            if fpm.likeness(fps[a], fps[b]) >= fpm.LIKENESS:
                close += 1
                linked += got[a] == got[b]
    assert close > 50 and linked >= 0.98 * close
    assert np.mean([got[d] == d for d in ids]) > 0.5
