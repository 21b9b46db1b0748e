import numpy as np
import pytest

from tillwork.llm import multiindex
from tillwork.llm.common import table


def plain(rows, every, k):
    ids, x = [], []
    size = {}
    for _, v in rows:
        if v:
            size[len(v)] = size.get(len(v), 0) + 1
    dim = min(size, key=lambda n: (-size[n], n))
    for i, v in rows:
        if i is not None and v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ids.append(i)
            x.append(v)
    ids, x = np.array(ids), np.array(x, float)
    out = []
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def awkward_vectors(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1020, [0.0] * dim), (1040, [None] + [1.0] * (dim - 1)), (1060, [float("nan")] * dim),
             (1080, [1.0]), (1100, []), (None, [1.0] * dim), (1120, [float("inf")] * dim)]
    return rows


def as_table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string").repartition(3)


@pytest.mark.parametrize("block", [17, 8192])
def test_whole_probe_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "ENTRY_BLOCK", block)
    monkeypatch.setattr(multiindex, "QUERY_BLOCK", 5)
    rows = awkward_vectors()
    got = multiindex.search(as_table(spark, rows), every=20, k=7, centroids=6, probe=1.0).collect()
    want = plain(rows, 20, 7)
    key = lambda r: (r[0], r[1])
    got = sorted([tuple(r) for r in got], key=key)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want, key=key)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want, key=key)], rtol=0, atol=1e-12)


def test_recall_on_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = {(r.query_id, r.vec_id): r.score for r in multiindex.search(vectors).collect()}
    want = plain(rows, 20, 20)
    assert np.mean([(q, v) in got for q, _, v, _ in want]) >= 0.9
    x = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - (x[q] * x[v]).sum()) < 1e-12 for (q, v), s in got.items())
    assert len(got) == len(want)


@pytest.mark.parametrize("sigma", [0.3, 0.5, 1.0])
def test_recall_on_uneven_norms(spark, sigma):
    """Long vectors far from the query are nearest by product."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32))
    x *= np.exp(sigma * rng.normal(size=(2000, 1))) / np.sqrt((x**2).sum(1, keepdims=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.query_id, r.vec_id) for r in multiindex.search(as_table(spark, rows)).collect()}
    want = plain(rows, 20, 20)
    assert len(got) == len(want)
    assert np.mean([(q, v) in got for q, _, v, _ in want]) >= 0.9


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random(7), rng.random(5)
        size = rng.integers(0, 4, 35)
        wanted = int(rng.integers(0, size.sum() + 1))
        mask = multiindex.probed_cells(a, b, size, wanted)
        order = np.argsort((a[:, None] + b[None]).ravel(), kind="stable")
        upto = np.r_[0, np.cumsum(size[order])]
        assert set(np.flatnonzero(mask)) == set(order[:np.searchsorted(upto, wanted)])


def test_few_and_no_vectors(spark):
    assert multiindex.search(as_table(spark, [])).count() == 0
    assert multiindex.search(as_table(spark, [(0, None), (20, [0.0, 0.0])])).count() == 0
    assert multiindex.search(as_table(spark, [(0, [1.0, 2.0])])).count() == 0
    got = multiindex.search(as_table(spark, [(0, [1.0, 2.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 5, 2.0), (0, 2, 3, 1.0)]
    odd = multiindex.search(as_table(spark, [(0, [3.0]), (1, [2.0]), (2, [-1.0])])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(odd, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
