"""Fits, k-means and kernels on feature vectors, sparse and wide; missing cells; folds by moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import arrays, dist
from lodestat.operators import cluster, diagnostics, kernels, linalg, prep
from lodestat.plans import penalties as P
from lodestat.plans import regression as R
from lodestat.plans import selection
from lodestat.plans import updaters as U
from lodestat.plans.fit import VectorFit, optimize, optimize_vectors
from lodestat.plans.objectives import Data, Linear, Logistic, Multinomial, VectorData
from lodestat.plans.rows import Vectors
from lodestat.sources import tables


def sparse_frame(spark, x, **more):
    rows = [(i, np.flatnonzero(r).astype(int).tolist(), r[r != 0].tolist(), *[float(v[i]) for v in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>" + "".join(f", {k} double" for k in more)).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(150, 12)) * (r.random((150, 12)) < 0.4)
    y = x @ np.r_[2.0, -1.5, np.zeros(10)] + 0.5 + r.normal(size=150) * 0.2
    z = (x[:, 0] - x[:, 1] + r.normal(size=150) > 0).astype(float)
    k = (x[:, 0] > 0.3).astype(int) + (x[:, 2] > 0.3)
    return x, y, z, k, sparse_frame(spark, x, y=y, z=z, k=k)


def bound(df, kind, label, at):
    return kind.on(VectorData(df, at, label, np.ones(at.size)))


@pytest.mark.parametrize("kind,label,width", [(Logistic(), "z", 1), (Multinomial(3), "k", 2)])
def test_sparse_objectives_are_the_dense_ones(small, kind, label, width):
    x, y, z, k, df = small
    dense = df.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.coalesce(F.try_element_at(F.map_from_arrays("indices", "values"), j), F.lit(0.0))))
    b = np.random.default_rng(1).normal(size=13 * width) * 0.3
    o = [bound(df, kind, label, Vectors(12, None, "indices", "values")), bound(dense, kind, label, Vectors(12, "v"))]
    design, target = np.c_[np.ones(150), x], z if width == 1 else k

    def value(b):
        eta = np.c_[np.zeros(150), design @ b.reshape(13, width)]
        return float((eta[np.arange(150), target.astype(int)] - np.log(np.exp(eta).sum(1))).sum())

    numeric = np.array([(value(b + d) - value(b - d)) / 2e-5 for d in np.eye(len(b)) * 1e-5])
    for one in o:
        assert one.value(b) == pytest.approx(value(b)) and np.allclose(one.gradient(b), numeric, atol=1e-5)
    h = o[0].hessian(b)
    assert np.allclose(h, o[1].hessian(b)) and np.allclose(np.diag(h), o[0].diagonal(b)) and o[0].hessian_1d(b, 3) == pytest.approx(h[3, 3])
    numeric = np.array([(o[0].gradient(b + d) - o[0].gradient(b - d)) / 2e-4 for d in np.eye(len(b))[:4] * 1e-4])
    assert np.allclose(h[:4], numeric, atol=1e-4)
    some = np.array([1, 4, 7])
    at = (some[:, None] * width + np.arange(width)).ravel()
    assert np.allclose(o[0].square(b, some), h[np.ix_(at, at)])
    for one in o:
        one.close()


@pytest.mark.parametrize("updater", [U.CoordinateDescent(), U.Fista(), U.Newton()])
def test_vector_fit_is_the_column_fit(small, updater, spark):
    x, y, *_, df = small
    columns = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row_id long, " + ", ".join(f"c{j} double" for j in range(12)) + ", y double")
    a = optimize(columns, "y", [f"c{j}" for j in range(12)], penalty=P.L2(2.0), updater=updater, normalize=False, stop=U.relative_stop(1e-12), tail=1, max_iterations=3000)
    b = optimize_vectors(df, "y", Vectors(12, None, "indices", "values"), penalty=P.L2(2.0), updater=updater, stop=U.relative_stop(1e-12), tail=1, max_iterations=3000)
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-4)
    p = VectorFit.from_json(b.to_json()).predict(df).orderBy("row_id").toPandas()["prediction"]
    assert np.allclose(p, np.c_[np.ones(150), x] @ b.coefficients) and b.evaluate(df, "y")["r2"] > 0.9


def test_missing_vectors_take_no_part(small, spark):
    x, y, *_, df = small
    odd = df.unionByName(spark.createDataFrame([(900, None, [1.0], 5.0, 1.0, 1.0), (901, [0], None, 5.0, 1.0, 1.0), (902, [0], [float("nan")], 5.0, 1.0, 1.0), (903, [0, 1], [1.0], 5.0, 1.0, 1.0), (904, [0], [1.0], None, None, None)], df.schema))
    at = Vectors(12, None, "indices", "values")
    fits = [optimize_vectors(d, "y", at, penalty=P.L2(1.0), updater=U.Newton(), tail=1) for d in (df, odd)]
    assert np.allclose(fits[0].coefficients, fits[1].coefficients)
    got = {r.row_id: r.prediction for r in fits[0].predict(odd).where("row_id >= 900").collect()}
    assert [got[i] is None for i in range(900, 905)] == [True] * 4 + [False]
    with pytest.raises(Exception, match="outside"):
        bound(df, Logistic(), "z", Vectors(3, None, "indices", "values"))


def test_sparse_logistic_l1_fit_of_10000_columns(spark):
    r = np.random.default_rng(3)
    n, p = 1000, 10_000
    weights = np.zeros(p)
    weights[:20] = r.choice([-4.0, 4.0], 20)
    at, values, label = [], [], []
    for _ in range(n):
        j = np.unique(np.r_[r.choice(20, 8, False), r.choice(p, 30)])
        v = r.normal(size=len(j))
        at.append(j.tolist())
        values.append(v.tolist())
        label.append(float(v @ weights[j] > 0))
    df = spark.createDataFrame([(i, a, v, y) for i, (a, v, y) in enumerate(zip(at, values, label))], "row_id long, at array<int>, v array<double>, y double").repartition(4)
    got = optimize_vectors(df, "y", Vectors(p, None, "at", "v"), Logistic(), P.L1(3.0), U.CoordinateDescent(), stop=U.relative_stop(1e-4), tail=1, max_iterations=12)
    found = np.flatnonzero(got.coefficients[1:])
    assert set(range(20)) <= set(found.tolist()) and len(found) < 400
    assert got.evaluate(df, "y")["accuracy"] > 0.9
    g = Logistic().on(VectorData(df, Vectors(p, None, "at", "v"), "y", np.ones(p + 1)))
    slope = g.gradient(got.coefficients)
    g.close()
    assert np.abs(slope[1:][got.coefficients[1:] == 0]).max() < 3.6 and abs(slope[0]) < 0.5


def test_wide_multinomial_and_linear_fits(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 1500))
    k = (x[:, 0] > 0.4).astype(int) + (x[:, 1] > 0.4)
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, k))], "row_id long, x array<double>, k double").repartition(4)
    m = optimize_vectors(df, "k", Vectors(1500, "x"), Multinomial(3), P.ElasticNet(8.0, 1.0), U.Fista(), stop=U.relative_stop(1e-3), tail=1, max_iterations=25)
    assert m.evaluate(df, "k")["accuracy"] > 0.7
    y = df.withColumn("y", F.element_at("x", 1) * 3 - F.element_at("x", 2) * 2)
    lasso = optimize_vectors(y, "y", Vectors(1500, "x"), Linear(), P.L1(20.0), U.CoordinateDescent(), stop=U.relative_stop(1e-6), tail=1, max_iterations=15)
    top = np.argsort(-np.abs(lasso.coefficients[1:]))[:2]
    assert set(top.tolist()) == {0, 1} and lasso.evaluate(y, "y")["r2"] > 0.95
    with pytest.raises(ValueError):
        optimize_vectors(df, "k", Vectors(1500, "x"), Multinomial(9), P.L2(1.0), U.Newton(), tail=1)


def test_sparse_mini_batches_and_validation(small):
    x, y, z, _, df = small
    at = Vectors(12, None, "indices", "values")
    r = optimize_vectors(df, "z", at, Logistic(), P.L2(0.1), U.AdaGrad(0.5), batch_size=40, key="row_id", max_iterations=30, tail=10)
    assert r.coefficients[1] > 0.3 and r.coefficients[2] < -0.3
    r = optimize_vectors(df, "y", at, penalty=P.L2(0.1), validation=F.col("row_id") % 5 == 0, tail=3, max_iterations=20)
    assert r.validation is not None and r.coefficients[1] == pytest.approx(2.0, abs=0.2)


def test_sparse_kmeans_is_dense_kmeans(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 3)) * (r.random((200, 3)) < 0.5)
    df = sparse_frame(spark, x)
    at = Vectors(3, None, "indices", "values")
    start = x[:4].copy()
    start[3] = 99.0
    got = cluster.kmeans_rows(df, at, start, 3)
    c = start
    for _ in range(4):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        near = d.argmin(1)
        live = [k for k in range(len(c)) if (near == k).any()]
        c = np.array([x[near == k].mean(0) for k in live])
        near = np.searchsorted(live, near)
    assert np.allclose(got.centres, c) and got.cost == pytest.approx(((x - c[near]) ** 2).sum())
    columns = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    assert np.allclose(cluster.kmeans(columns, ["a", "b", "c"], start, 3).centres, c)
    best = cluster.kmeans_rows_random(df, at, 3, 3, 5, "row_id")
    assert len(best.centres) <= 3 and best.cost > 0


def test_rbf_rows_keep_sparse_entries(spark):
    x = np.array([[0.0, 2.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    out, at = kernels.rbf_rows(sparse_frame(spark, x), Vectors(3, None, "indices", "values"), np.array([[0.0, 0, 0], [1.0, 0, 0]]), np.array([0.5, 2.0]))
    assert at.width == 5
    for r in out.collect():
        d = ((x[r.row_id] - np.array([[0.0, 0, 0], [1.0, 0, 0]])) ** 2).sum(1)
        assert np.allclose(r.rbf_values[:2], np.exp(-d / np.array([1.0, 4.0]))) and r.rbf_indices == [0, 1, *[int(j) + 2 for j in np.flatnonzero(x[r.row_id])]]


def test_libsvm_rows_can_be_fitted(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.normal(size=(120, 4))
    y = (x[:, 0] > 0).astype(int)
    for part in range(3):
        (tmp_path / f"p{part}.txt").write_text("\n".join(f"{y[i]} " + " ".join(f"{j + 1}:{x[i, j]}" for j in range(4)) for i in range(part * 40, part * 40 + 40)) + "\n")
    df = tables.read_libsvm(spark, str(tmp_path))
    assert sorted(r.row_id for r in df.collect()) == list(range(120))
    assert {r.row_id: r.label for r in df.collect()} == {i: float(v) for i, v in enumerate(y)}
    rows, at = tables.libsvm_vectors(df, 4)
    assert optimize_vectors(rows, "label", at, Logistic(), P.L2(1.0), U.Newton(), tail=1).evaluate(rows, "label")["accuracy"] > 0.95


# --- missing cells, tails, folds ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def holes(spark):
    """y = 2x + 1, with a null or NaN in every fourth row."""
    bad = {0: (None, 1.0), 1: (float("nan"), 1.0), 2: (1.0, None), 3: (1.0, float("nan"))}
    rows = [(i, *(bad[i // 4 % 4] if i % 4 == 0 else (i / 7.0, 2 * i / 7.0 + 1))) for i in range(80)]
    return spark.createDataFrame(rows, "id long, x double, y double").repartition(3)


def test_incomplete_rows_take_no_part(holes):
    r = R.linear_regression(holes, "y", ["x"])
    assert r.n == 60 and np.allclose(r.coefficients, [1, 2])
    assert np.allclose(optimize(holes, "y", ["x"], updater=U.Newton(), tail=1).coefficients, [1, 2])
    b = R.bayesian_regression(holes, "y", ["x"], 1e-9)
    assert b.dof == 60 and np.allclose(b.mean, [1, 2], atol=1e-6)
    p = cluster.pca(holes, ["x", "y"])
    assert len(p.sigma) == 1 and abs(p.loadings[1, 0] / p.loadings[0, 0]) == pytest.approx(2)
    d = cluster.column_distances(holes, ["x", "y"])
    x = np.array([i / 7 for i in range(80) if i % 4])
    assert d[0, 1] == pytest.approx(np.sqrt(((x + 1) ** 2).sum()))
    z = holes.withColumn("z", F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0))
    full = z.where("id % 4 <> 0")
    assert np.allclose(R.logistic_regression(z, "z", ["x", "y"][:1]).coefficients, R.logistic_regression(z.where("x is not null and not isnan(x)"), "z", ["x"]).coefficients)
    assert np.allclose(*[optimize(t, "z", ["x"], Logistic(), P.L2(1.0), U.Newton(), tail=1).coefficients for t in (z.where("y is not null and not isnan(y)"), full)], atol=0.2)
    cv = selection.linear_with_cv(holes, "y", "id", ["x"], P.L2, [1e-9, 10.0], U.Newton, inner=3)
    assert cv.best == 1e-9 and np.allclose(cv.coefficients, [1, 2], atol=1e-5) and cv.evaluation["r2"] == pytest.approx(1)


def test_default_tail_stays_at_the_optimum(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-(0.4 + 3 * x)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    best = R.logistic_regression(df, "y", ["x"]).coefficients
    assert np.allclose(optimize(df, "y", ["x"], Logistic(), updater=U.Newton()).coefficients, best, atol=1e-6)


def test_linear_folds_by_moments_are_the_general_search(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(90, 2)) * [1, 3] + [5, 0]
    y = x @ [1.0, -0.5] + r.normal(size=90)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    train = lambda d, c, start: optimize(d, "y", ["a", "b"], penalty=P.L2(c), updater=U.Newton(), start=start, tail=1)
    place = F.col("id")
    got = selection.linear_with_cv(df, "y", "id", ["a", "b"], P.L2, [0.5, 50.0], U.Newton, inner=4, place=place)
    inside, size = df.where("id < 81"), 81 // 4 + 1
    folds = [(inside.where(f"floor(id / {size}) <> {f}"), inside.where(f"floor(id / {size}) = {f}")) for f in range(4)]
    want = selection.search(folds, "y", [0.5, 50.0], train)
    assert np.allclose([s.score for s in got.scored], [s.score for s in want], rtol=1e-6)
    assert np.allclose(got.coefficients, train(inside, got.best, None).coefficients, rtol=1e-6)


def test_folds_stay_cached_while_they_are_read(spark):
    seen = []
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y"))

    def train(d, c, start):
        seen.append((len(spark.sparkContext._jsc.getPersistentRDDs()) > 0, start is None))
        return optimize(d, "y", ["x"], penalty=P.L2(c), updater=U.Newton(), start=start, tail=1)

    splits = selection.folds(df, 3, 1, lambda r: selection.k_fold(df, "k", 3))
    selection.search(splits, "y", [1.0, 2.0], train)
    assert all(cached for cached, _ in seen) and [first for _, first in seen] == [True, True, False, False, False, False]


def test_bootstrap_draws_as_many_rows(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    n = selection.bootstrap(df, "k", 3).groupBy("k").count().toPandas()["count"]
    assert n.sum() == 500 and 250 < len(n) < 380 and 1 < n.max() < 10
    assert selection.bootstrap(df.limit(0), "k", 3).count() == 0
    assert 400 < selection.bootstrap(df, "k", 3, exact=False).count() < 600


def test_ties_cost_nothing_in_ranks_and_qq(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "k long, x double")
    x = np.sort(np.arange(300) % 3).astype(float)
    assert diagnostics.qq_error(df, "x").first()[0] == pytest.approx(((x - np.arange(1, 301) / 300) ** 2).mean())
    got = diagnostics.qq_normal(df, "x", "k").orderBy("i").toPandas()
    assert np.allclose(got["observed"], x[1:]) and list(got["i"]) == list(range(1, 300))
    assert np.allclose(got["theoretical"], [dist.normal_quantile(i / 300, x.mean(), x.std(ddof=1)) for i in range(1, 300)])
    u = diagnostics.qq_uniform(df.select("k", ((F.col("k") + 0.5) / 300).alias("p")), "p", "k").orderBy("rank").toPandas()
    from math import comb

    for k in (1, 7, 150, 300):  # P(Beta(k, n + 1 - k) <= q) = P(Binomial(n, q) >= k)
        for name, p in (("low", 0.95), ("high", 0.05)):
            q = 10 ** -u[name][k - 1]
            assert sum(comb(300, i) * q**i * (1 - q) ** (300 - i) for i in range(k, 301)) == pytest.approx(p, abs=1e-6)


def test_array_distributions_are_the_scalar_ones():
    p = np.r_[1e-300, 1e-20, 1e-9, 0.01, 0.075, 0.3, 0.5, 0.925, 0.99, 1 - 1e-12]
    assert np.allclose(arrays.normal_quantile(p, 2, 3), [dist.normal_quantile(v, 2, 3) for v in p], rtol=1e-12)
    assert np.isneginf(arrays.normal_quantile(np.array([0.0]))[0]) and np.isposinf(arrays.normal_quantile(np.array([1.0]))[0])
    x = np.linspace(-30, 30, 101)
    for df in (1, 3, 10, 1e5):
        assert np.allclose(arrays.t_two_sided(x, df), [dist.t_two_sided(v, df) for v in x], atol=1e-11)
    assert np.isnan(arrays.t_two_sided(np.array([np.nan]), 3)[0])


def test_limits_are_errors(spark, monkeypatch):
    df = spark.range(50).select(F.col("id"), F.col("id").cast("string").alias("c"), (F.col("id") * 1.0).alias("x"))
    monkeypatch.setattr(prep, "MOST_LEVELS", 20)
    with pytest.raises(ValueError):
        prep.levels(df, "c")
    monkeypatch.setattr(cluster, "MOST_PAIRS", 100)
    with pytest.raises(ValueError):
        cluster.distances(df, "id", ["x"])
    with pytest.raises(ValueError):
        linalg.svd(df, 10_000, 2)
    r = R.bayesian_regression(df.withColumn("y", F.col("x") * 2), "y", ["x"], 1.0)
    with pytest.raises(ValueError):
        r.predictive_covariance(df, "id", most=10)


def test_eigen_by_power_and_deflation():
    r = np.random.default_rng(9)
    a = r.normal(size=(6, 6))
    a = a @ a.T + np.diag([9.0, 5, 3, 2, 1, 0.5]) * 4
    values, vectors = linalg.eigen_by_power(lambda x: a @ x, 6, 3, 20_000)
    want, basis = linalg.eigen_symmetric(a, 3)
    assert np.allclose(values, want) and np.allclose(np.abs(np.sum(vectors * basis, 0)), 1, atol=1e-6)
    assert linalg.power_error(lambda x: a @ x, basis[:, 0])[1] < 1e-9


def test_column_objectives_of_many_columns(spark):
    """Beyond a few columns the fold takes over, with the same sums."""
    r = np.random.default_rng(10)
    x = r.normal(size=(80, 10))
    z = (x[:, 0] + r.normal(size=80) > 0).astype(float)
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([(*map(float, v), float(y)) for v, y in zip(x, z)], ", ".join(f"{c} double" for c in names) + ", z double")
    b = r.normal(size=10) * 0.2
    o = Logistic().on(Data(df, names, "z", np.ones(10)))
    pi = 1 / (1 + np.exp(-x @ b))
    assert np.allclose(o.gradient(b), x.T @ (z - pi)) and np.allclose(o.hessian(b), -(x * (pi * (1 - pi))[:, None]).T @ x)
    o.close()
