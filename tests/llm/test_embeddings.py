import math

import numpy as np

from cairnframe.llm import embeddings as emb
from tests.llm.helpers import saved


def brute(rows, threshold=0.95):
    """rows of (vec_id, list) -> sorted (vec_id, n_links, component_id)."""
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(good):
        for j in good[:x]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, links[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = emb.op1_embeddings(spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def clusters(rng, groups, each, dim=32, noise=0.1):
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        out += [(c + noise * rng.standard_normal(dim) * np.linalg.norm(c) / math.sqrt(dim)).astype("f4") for _ in range(each)]
    return out


def test_large_groups_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(emb, "CHUNK", 64)
    rng = np.random.default_rng(0)
    vs = clusters(rng, 1, 300, noise=0.17) + clusters(rng, 20, 4, noise=0.15) + [v for v in rng.standard_normal((200, 32)).astype("f4")]
    vs += [vs[0]] * 40
    rows = [(i * 7 % 2003, [float(x) for x in v]) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = emb.embedding_components(df).collect()
    want = {d: (n, c) for d, n, c in brute(rows)}
    assert len(got) == len(rows)
    wrong = [r for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert not wrong


def test_group_that_ends_in_a_block_of_one(spark):
    rng = np.random.default_rng(1)
    vs = clusters(rng, 1, 513, noise=0.05)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in emb.embedding_components(df).collect()} == {(512, 0)}


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.0, 0.001]), (13, [1e-30, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, g string, key string")
    got = emb.op1_embeddings(spark, saved(df, tmp_path, "embeddings")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert [r.kept for r in got if r.vec_id is None] == [False]


def test_empty_table(spark):
    assert emb.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    for dim in (64, 40, 200):
        x = emb.unit(rng.standard_normal((400, dim)))
        c = emb.Codes.read(emb.Codes.of(x).stored())
        i = np.arange(400)
        estimate, deviation = c.estimates(i[:, None], i[None])
        error = (estimate - x @ x.T)[~np.eye(400, dtype=bool)]
        assert abs(error.mean()) < 0.002
        bound = (emb.EPSILON * deviation)[~np.eye(400, dtype=bool)]
        assert (np.abs(error) <= bound).mean() > 0.99999
        # the bound is of use: it dismisses nearly all unrelated pairs
        assert c.may_reach(i[:, None], i[None], 0.95)[~np.eye(400, dtype=bool)].mean() < 0.1


def test_estimates_dismiss_no_pair_at_the_threshold():
    a, b = at_cosine(20_000, 0.95, 64)
    c = emb.Codes.of(np.concatenate([a, b]))
    i = np.arange(20_000)
    assert c.may_reach(i, i + 20_000, 0.95).all()


def at_cosine(n, cosine, dim):
    rng = np.random.default_rng(5)
    a = emb.unit(rng.standard_normal((n, dim)))
    r = rng.standard_normal((n, dim))
    r = emb.unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(1 - cosine**2) * r


def test_recall_of_bands_at_the_threshold():
    for n, dim in ((500, 64), (20_000, 64), (20_000, 16), (5_000_000, 128), (10**9, 64)):
        m, hashes, count = emb.bands(n)
        a, b = at_cosine(3000, 0.95, dim)
        assert (emb.band_keys(a, m, hashes, count) == emb.band_keys(b, m, hashes, count)).any(axis=1).mean() > 0.999
