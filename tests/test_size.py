"""Operators on tables of several blocks, and figures that must not grow with the table."""

import numpy as np
from pyspark.sql import functions as F

from lodestat.functions import arrays, dist
from lodestat.operators import diagnostics, linalg
from lodestat.plans import penalties, selection, updaters
from lodestat.plans.fit import iterate
from lodestat.plans.objectives import BoundLinear


def test_outer_product_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BLOCK", 7)
    monkeypatch.setattr(linalg, "BLOCK_COLUMNS", 4)
    r = np.random.default_rng(5)
    a = np.where(r.random((40, 11)) < 0.3, r.normal(size=(40, 11)), 0)
    a[3, 2], a[9, 5] = np.inf, np.nan
    cells = [(f"r{i}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)] + [("r1", 0, 2.0), ("r1", 0, 3.0)]
    a[1, 0] = np.sum([v for i, j, v in cells if (i, j) == ("r1", 0)])
    out = linalg.outer(spark.createDataFrame(cells, "i string, j long, v double"))
    got = {(x.i, x.j): x.v for x in out.collect()}
    assert len(got) == out.count()
    for i in range(40):
        for j in range(40):
            both = np.flatnonzero((a[i] != 0) & (a[j] != 0))
            assert ((f"r{i}", f"r{j}") in got) == bool(len(both))
            if len(both):
                assert np.allclose(got[f"r{i}", f"r{j}"], (a[i, both] * a[j, both]).sum(), equal_nan=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[i" not in plan  # no partial sums of pairs


def test_svd_gathers_rows_and_keeps_them_in_place(spark, monkeypatch):
    monkeypatch.setattr(linalg, "ROW_ENTRIES", 24)
    r = np.random.default_rng(6)
    a = np.where(r.random((300, 6)) < 0.6, r.normal(size=(300, 6)), 0)
    a[0, 0] = 1.0
    cells = [(f"r{i}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)] + [("r0", 0, 2.0)]
    a[0, 0] += 2.0
    m = spark.createDataFrame(cells, "i string, j int, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = linalg.gathered(m, 6).collect()
        s, v, u = linalg.svd(m, 6, 6)
        back = {(x.i, x.j): x.v for x in u.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.i: x.x for x in rows} == {f"r{i}": a[i].tolist() for i in range(300) if a[i].any()} and len(rows) == a.any(1).sum()
    assert np.allclose(s, np.linalg.svd(a)[1]) and np.allclose(linalg.singular_values(m, 6, 6), s)
    assert all(np.allclose(np.array([back[x.i, k] for k in range(6)]) * s @ v.T, x.x) for x in rows)


def test_svd_reconstruct_shuffles_no_rows(spark, tmp_path):
    from lodestat import queries_parts

    x = np.random.default_rng(7).normal(size=(90, 64)).astype(np.float32)
    x[4] = 0  # a row of zeros has its cells too
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries_parts.svd_reconstruct(spark, str(tmp_path))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.v for r in out.collect()}
    assert len(got) == 90 * 64 and all(abs(got[i, j] - x[i, j]) < 2e-6 for i in range(90) for j in range(64))


def test_split_takes_the_decimal_share(spark):
    df = spark.range(90_000).withColumnRenamed("id", "k")
    assert selection.split(df, "k", 0.7).where("is_train").count() == 63_000
    assert [selection.share(n, r) for n, r in ((90_000, 0.7), (100, 0.29), (10, 0.1), (7, 0.7), (5, 1))] == [63_000, 29, 1, 4, 5]


def test_qq_uniform_has_every_row(spark):
    n = 30_500
    df = spark.range(n).select(F.col("id").alias("k"), ((F.col("id") + 0.5) / n).alias("p"))
    got = diagnostics.qq_uniform(df, "p", "k").select("rank", "observed").orderBy("rank").toPandas()
    assert got["rank"].tolist() == list(range(1, n + 1))
    assert np.allclose(got["observed"], -np.log10((np.arange(n) + 0.5) / n))
    k = np.array([1.0, 2, 150, 20_000, 30_490, n])
    for p in (0.95, 0.05):
        assert np.allclose(arrays.beta_quantile(p, k, n + 1 - k), [dist.beta_quantile(p, int(i), n + 1 - int(i)) for i in k], rtol=1e-9)


def test_fista_settles_at_the_optimum_of_many_rows():
    n, mean = 36e6, np.array([1.0, 1.77, 1.58, 1.55])
    xx = n * (np.outer(mean, mean) + np.diag([0.0, 1, 1, 1]))
    xy = xx @ np.array([5e4, 30.0, 30.0, 40.0])
    o = BoundLinear(None, np.block([[xx, xy[:, None]], [xy[None], np.array([[n * 4e9]])]]), int(n), np.array([0.0, 1, 1, 1]))
    best = np.zeros(4)
    for _ in range(3000):
        for i in range(4):
            r = xy[i] - xx[i] @ best + xx[i, i] * best[i]
            best[i] = np.sign(r) * max(0, abs(r) - (1e6 if i else 0)) / xx[i, i]
    for stop in (updaters.settled(1e-12), updaters.relative_stop(1e-14)):
        got, last = iterate(iter(lambda: o, None), None, 4, updaters.Fista(), penalties.L1(1e6), stop, 2, 3000, 50)
        assert np.abs(got - best).max() < 1e-3 and last.iteration < 1000
