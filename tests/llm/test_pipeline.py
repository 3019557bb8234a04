import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from cairnframe.llm import simhash_wide as wide
from tests.llm.helpers import clashing, documents
from tests.llm.test_line_dedup import key


def words(rnd, n):
    return [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(3, 10))) for _ in range(n)]


def corpus(seed=1, plain=60):
    """Rows, and the sets of doc_ids that are copies of each other."""
    rnd = random.Random(seed)
    rows, groups = [], []
    for i in range(plain):
        rows.append((i, " ".join(words(rnd, rnd.randrange(20, 400))), "en", "s", 1))
    nxt = plain
    for _ in range(6):
        base = words(rnd, 300)
        ids = []
        for k in range(5):
            w = list(base)
            for _ in range(0 if k < 2 else 4):
                w[rnd.randrange(len(w))] = "".join(rnd.choice("bcdfg") for _ in range(6))
            rows.append((nxt, " ".join(w), "en", "s", 1))
            ids.append(nxt)
            nxt += 1
        groups.append(ids)
    return rows, groups


def jaccard(a, b):
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def shingles(text):
    """Five words a shingle, A-Z lower-cased; of fewer words all of them."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("crowd,bits", [(8, 20), (2, 24)])
def test_near_copies_one_stays(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(wide, "CROWD", crowd)
    monkeypatch.setattr(wide, "segment_bits", lambda n: bits)
    monkeypatch.setattr(wide, "CHUNK", 3)
    rows, groups = corpus()
    kept = {r.doc_id for r in cp.near_copies(spark, documents(spark, rows), "").collect()}
    assert kept == {r[0] for r in rows} - {i for g in groups for i in g[1:]}


def test_recall_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text.lower() for r in docs.select("doc_id", "text").collect()}
    numbered = docs.select(docs.doc_id.alias("rid"), "doc_id", "text")
    component = {r.doc_id: r.component for r in wide.near_groups(numbered).collect()}
    by_shingle = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(max(1, len(w) - 4)):
            by_shingle.setdefault(tuple(w[i : i + 5]), set()).add(d)
    pairs = {(a, b) for ds in by_shingle.values() if len(ds) < 200 for a in ds for b in ds if a < b}
    close = [(a, b) for a, b in pairs if len(texts[a]) < 1.4 * len(texts[b]) + 9 and len(texts[b]) < 1.4 * len(texts[a]) + 9 and jaccard(texts[a], texts[b]) >= 0.8]
    assert len(close) > 20
    assert sum(component[a] == component[b] for a, b in close) >= 0.98 * len(close)
    # a class is joined by chains of close pairs; unrelated texts are never in one
    members = {}
    for d, c in component.items():
        members.setdefault(c, []).append(d)
    for ds in members.values():
        for d in ds[1:]:
            assert max(jaccard(texts[d], texts[e]) for e in ds if e != d) >= 0.6


def test_stages_on_odd_rows(spark):
    docs = clashing(documents(spark))
    h = "0123456789abcdef" * 3
    more = clashing(documents(spark, [(20 + i, f"own words number {'abcdefgh'[i]} of this text are here\nThis shared line is long enough to be dropped by the stage\nkey {h}", "en", "s", 1) for i in range(6)]))
    docs = docs.unionByName(more)
    columns = docs.columns
    out = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        out[name] = rows
        if name != "packing":
            assert docs.columns == columns
        docs = spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in out["language_id"]} >= {2, 3, 4, 5, None, 20, 25} and not {0, 1, 7} & {r.doc_id for r in out["language_id"]}
    shared = "This shared line is long enough to be dropped by the stage"
    assert [r.doc_id for r in out["line_dedup"] if shared in r.text] == [25]
    assert sum(r.doc_id in (2, 3) for r in out["near_dedup"]) == 1
    assert not any(h in r.text for r in out["secrets"]) and any("[secret]" in r.text for r in out["secrets"])
    assert all(r.n_chars == len(r.text) for r in out["secrets"] if "[secret]" in r.text)
    assert sum(r.length for r in out["packing"]) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in out["packing"]}.values())


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_run_against_brute_force(spark, sf):
    """The rows of run() hold exactly the tokens of the texts that the stages leave, found step by step."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
    holders = {}
    for r in rows:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == r["doc_id"])
    kept = sorted(rows, key=lambda r: r["doc_id"])
    sets = [shingles(r["text"]) for r in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    left = [kept[i] for i in range(len(kept)) if root[i] == i]
    tokens = {}
    from cairnframe.llm import secrets

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    model = secrets.train(secrets.labelled_samples(spark.createDataFrame([(r["doc_id"], r["text"]) for r in left], "doc_id long, text string")))
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in left], "doc_id long, text string")
    for r in secrets.scan(table, model).collect():
        text, at, out = r.text, 0, ""
        for s in r["__all"]:
            if s.start >= at:
                out += text[at : s.start] + "[secret]"
            at = max(at, s.stop)
        tokens[r.doc_id] = t.encode(out + text[at:], add_special_tokens=False).ids + [1]
    got = {}
    for p in cp.run(spark, sf).collect():
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32
        got.setdefault(p.doc_id, {})[p.start] = ids
    assert {d: [i for s in sorted(ps) for i in ps[s]] for d, ps in got.items()} == tokens


def test_a_repeated_line_does_not_make_copies(spark):
    rnd = random.Random(3)
    line = " ".join(words(rnd, 12))
    texts = ["\n".join([line] * 20 + [" ".join(words(rnd, 60))]) for _ in range(6)]
    assert max(jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]) < 0.3
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert {r.doc_id for r in cp.near_copies(spark, documents(spark, rows), "").collect()} == set(range(6))


def test_links_hold_the_similarity(spark):
    """Texts at 0.70 to 0.79 are near in bits but no copies; those at 0.8 and more are, in a long chain of chunks too."""
    rnd = random.Random(5)
    rows, want = [], set()
    for _ in range(30):
        base = words(rnd, 400)
        tail = words(rnd, 60)
        rows += [(len(rows), " ".join(base), "en", "s", 1), (len(rows) + 1, " ".join(base[:-60] + tail), "en", "s", 1), (len(rows) + 2, " ".join(base[:-30] + tail[:30]), "en", "s", 1)][: 2 if rnd.random() < 0.5 else 3]
    texts = {r[0]: r[1] for r in rows}
    near = [(a, b) for a in texts for b in texts if a < b < a + 3 and jaccard(texts[a], texts[b]) >= 0.8]
    root = {d: d for d in texts}
    for a, b in near:
        x, y = root[a], root[b]
        root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    want = {d for d, r in root.items() if r == d}
    assert 0 < len(near) and len(want) > 30
    assert {r.doc_id for r in cp.near_copies(spark, documents(spark, rows), "").collect()} == want


@pytest.mark.parametrize("chunk", [4, 128])
def test_similar_sets_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(wide, "SET_CHUNK", chunk)
    monkeypatch.setattr(wide, "CHUNK", chunk)
    rnd = random.Random(8)
    a, b = words(rnd, 300), words(rnd, 30)
    other = a[:-30] + b  # about 0.8 to a
    rows = [(i, " ".join([*(a if i < 20 else other)[: 300 - i % 3], f"n{i}"]), "en", "s", 1) for i in range(40)]
    texts = [r[1] for r in rows]
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    docs = documents(spark, rows)
    got = {r.doc_id: r.component for r in wide.near_groups(docs.select(docs.doc_id.alias("rid"), "doc_id", "text")).collect()}
    assert got == dict(enumerate(root))


def test_candidates_at_the_asked_similarity():
    """Pairs of sets at 0.80 meet in the index and pass both distances, with the same layout at any size."""
    assert len({wide.segment_bits(n) for n in (10, 10**6, 10**9)}) == 1
    rng = np.random.default_rng(4)
    bits = wide.segment_bits(10)
    found = 0
    for _ in range(400):
        h = rng.integers(0, 2**63, size=444, dtype=np.uint64)
        (x, low_x), (y, low_y) = wide.set_simhash(h[:400], bits), wide.set_simhash(np.concatenate([h[:356], h[400:]]), bits)
        met = np.intersect1d(wide.segment_keys(x[None], low_x[None], bits), wide.segment_keys(y[None], low_y[None], bits))
        found += bool(len(met)) and np.bitwise_count(x ^ y).sum() <= wide.most_differing()
    assert found >= 0.99 * 400
