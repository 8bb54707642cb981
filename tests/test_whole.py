"""Registered queries that take every row of their tables, against brute force."""

import numpy as np
import pytest

from lodestat import queries
from lodestat.operators import cluster


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """(folder, matrix): 230 vectors, some of them equal."""
    r = np.random.default_rng(3)
    x = r.normal(0, 0.15, (230, 64)).astype(np.float32)
    x[200:215] = x[7]
    x[220] = x[0]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{sf}/embeddings.parquet")
    return sf, x.astype(float)


def medoid_step(d, medoids):
    near = np.array([min(medoids, key=lambda m: (row[m], m)) for row in d])
    new = {}
    for m in medoids:
        of = np.flatnonzero(near == m)
        if len(of):
            s = {int(i): round(d[i, of].sum(), 9) for i in of}
            new[m] = min(s, key=lambda i: (s[i], i))
    return near, new


def test_kmedoid_queries_take_every_row(spark, vectors, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    monkeypatch.setattr(cluster, "BLOCK_PARTS", 4)
    sf, x = vectors
    d = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2))
    near, new = medoid_step(d, [0, 1, 2])
    got = {r.i: (r.medoid, r.d) for r in queries.kmedoid_assign(spark, sf).collect()}
    assert {i: m for i, (m, _) in got.items()} == dict(enumerate(near.tolist())) and len(got) == len(x)
    assert np.allclose([got[i][1] for i in range(len(x))], d[np.arange(len(x)), near], atol=1e-8)
    assert {r.medoid: r.new for r in queries.kmedoid_recenter(spark, sf).collect()} == new
    best, now = None, [0, 1, 2]
    for _ in range(20):
        near, new = medoid_step(d, now)
        cost = d[np.arange(len(x)), near].sum()
        if best is not None and cost >= best[0] - 1e-9:
            break
        best, now = (cost, near), sorted(new.values())
    fit = {r.medoid: (r.n, r.cost) for r in queries.kmedoid_fit(spark, sf).collect()}
    assert {m: n for m, (n, _) in fit.items()} == {m: int((best[1] == m).sum()) for m in set(best[1].tolist())}
    assert np.isclose(sum(c for _, c in fit.values()), best[0])


def test_outer_product_has_every_pair_of_rows(spark, vectors):
    sf, x = vectors
    m = np.where(x > 0.1, x, 0)
    both = (m > 0).astype(int) @ (m > 0).astype(int).T
    got = {(r.i, r.j): r.v for r in queries.outer_product(spark, sf).collect()}
    assert set(got) == set(zip(*(a.tolist() for a in np.nonzero(both)), strict=True))
    assert max(abs(v - (m @ m.T)[k]) for k, v in got.items()) < 1e-6
