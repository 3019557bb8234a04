import re

import xxhash

from cairnframe.llm import simhash
from tests.llm.helpers import clashing, documents, saved


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """[(id, fp)] -> {index: smallest id reachable}."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(pairs):
        out.setdefault(find(i), []).append(d)
    return {i: min((d for d in out[find(i)] if d is not None), default=None) for i in range(len(pairs))}


def test_fingerprints_and_components_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_fp(r.text)) for r in rows]
    want = {fps[i][0]: (f"{fps[i][1]:016x}", c) for i, c in brute_components(fps).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf).collect()}
    assert got == want


def test_links_cover_every_pair_within_two_bits(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    codes = list({b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(40)} | set(base))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    fps = spark.createDataFrame([(c,) for c in signed], "fp long")
    from cairnframe.llm.common import connected_components

    links = simhash.fingerprint_links(fps)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components([(c, c & (2**64 - 1)) for c in signed])
    for i, c in enumerate(signed):
        assert roots.get(c, c) == want[i]


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Hundreds of variants share a segment's value: small keys, forests, and the second index link alike."""
    import random

    from cairnframe.llm.common import connected_components

    rnd = random.Random(9)
    low = rnd.getrandbits(32)
    codes = {(rnd.getrandbits(7) << 40) | low for _ in range(90)} | {(1 << rnd.randrange(32, 64)) ^ low ^ (1 << rnd.randrange(32)) for _ in range(60)} | {0, 2**64 - 1, 3}
    signed = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    fps = spark.createDataFrame([(c,) for c in signed], "fp long")
    want = brute_components([(c, c & (2**64 - 1)) for c in signed])
    for crowd in (3, 40, 1024):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        links = simhash.fingerprint_links(fps)
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
        roots = {r.node: r.component for r in connected_components(links).collect()}
        assert [roots.get(c, c) for c in signed] == [want[i] for i in range(len(signed))]


def test_hot_keys_are_joined_by_broadcast(spark):
    from cairnframe.llm.common import join_by_weight

    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 1000)], "k long, v long")
    side = rows.groupBy("k").count().selectExpr("k", "count", "k + 1 AS name").cache()
    got = join_by_weight(rows, side, ["k"], "count")
    assert got.count() == 3998 and got.where("name <> k + 1").count() == 0 and got.columns == ["k", "v", "name"]


def test_crowds_pass_in_pieces():
    import random

    import numpy as np
    import pyarrow as pa

    from cairnframe.llm.common import keys_and_crowds

    rnd = random.Random(2)
    for case in range(60):
        keys = sorted(rnd.choice([rnd.randrange(40), 7, 19]) for _ in range(rnd.randrange(0, 400)))
        batches, at = [], 0
        while at < len(keys):
            n = rnd.randrange(0, 60)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(range(at, min(len(keys), at + n)), pa.int64())], names=["k", "v"]))
            at += n
        got, small = [], {}
        for (k, v), crowd in keys_and_crowds(iter(batches), 10, rows=rnd.choice([1, 20, 500])):
            assert len(k) == len(v) and (not crowd or len(np.unique(k)) == 1)
            got += v.tolist()
            for x in [] if crowd else np.unique(k).tolist():
                assert x not in small
                small[x] = int((k == x).sum())
        assert got == list(range(len(keys)))
        assert all(n == keys.count(x) for x, n in small.items()) and {x for x in keys if keys.count(x) <= 10} <= set(small)


def test_odd_rows(spark, tmp_path):
    rows = simhash.op2_simhash(spark, saved(clashing(documents(spark)), tmp_path)).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].fingerprint == by[1][0].fingerprint == by[7][0].fingerprint == "0" * 16
    assert by[7][0].component_id == 0
    assert [r.component_id for r in by[3]] == [2, 2]
    assert by[None][0].component_id is None


def test_empty_table(spark):
    assert simhash.simhash_components(documents(spark, [])).collect() == []
