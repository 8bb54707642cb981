import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.operators.kernels import Rbf, rbf_bandwidths
from lodestat.plans import penalties as P
from lodestat.plans import regression as R
from lodestat.plans import updaters as U
from lodestat.plans.fit import FitResult, optimize
from lodestat.plans.moments import moments
from lodestat.plans.objectives import Data, Linear, Logistic, Multinomial


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4)) * [1, 2, 0.5, 1]
    y = x @ [1.5, 0, -2, 0] + 3 + rng.normal(size=120) * 0.3
    k = (x[:, 0] > 0).astype(int) + (x[:, 2] > 0.2)
    df = spark.createDataFrame([(i, *map(float, r), float(v), int(c)) for i, (r, v, c) in enumerate(zip(x, y, k))], "row_id long, a double, b double, c double, d double, y double, k int").cache()
    return df, x, y, k


def test_cubic_golden(spark):
    t = np.linspace(-1, 1, 50)
    df = spark.createDataFrame([(float(v + 5), float(v**3)) for v in t], "y double, x1 double")
    r = R.linear_regression(df, "y", ["x1"])
    assert r.effect("intercept").slope == pytest.approx(5, abs=1e-10)
    assert r.effect("x1").slope == pytest.approx(1.34653453394437, abs=1e-7)


def test_ols_is_least_squares(wide, spark):
    df, x, y, _ = wide
    r = R.linear_regression(df, "y", list("abcd"))
    X = np.c_[np.ones(len(x)), x]
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert np.allclose(r.coefficients, b)
    e = y - X @ b
    s2 = e @ e / (len(y) - 5)
    assert np.allclose(r.covariance, s2 * np.linalg.inv(X.T @ X))
    inf = R.influence(r, df, "y", textbook=True).orderBy("row_id").toPandas()
    h = np.diag(X @ np.linalg.inv(X.T @ X) @ X.T)
    assert np.allclose(inf["leverage"], h) and np.allclose(inf["residual"], e)
    p = R.outlier_p_values(R.influence(r, df, "y"), r.n - 6).toPandas()["p_value"]
    assert ((p > 0) & (p <= 1)).all()
    assert r.table(spark).count() == 5 and "intercept" in r.lines()


def test_ridge_without_intercept(wide):
    df, x, y, _ = wide
    r = R.linear_regression(df, "y", list("abcd"), ridge=3.0, add_intercept=False, weights=dict.fromkeys("abcd", 1.0))
    assert np.allclose(r.coefficients, np.linalg.solve(x.T @ x + 3 * np.eye(4), x.T @ y))


def test_bayesian_predictive_and_marginal(wide):
    df, x, y, _ = wide
    X = np.c_[np.ones(len(x)), x[:, 0]]
    r = R.bayesian_regression(df, "y", ["a"], 2.0)
    assert np.allclose(r.mean, np.linalg.solve(X.T @ X + 2 * np.eye(2), X.T @ y))
    k = X @ X.T / 2 + 0.5 * np.eye(len(y))
    assert R.log_marginal_likelihood(df, "y", ["a"], 2.0, 0.5) == pytest.approx(-0.5 * np.linalg.slogdet(k)[1] - 0.5 * y @ np.linalg.solve(k, y))
    got = r.predictive(df, 1.0, 0.9).first()
    assert got["predictive_quantile"] > got["predictive_mean"]


def test_logistic_score_is_zero(wide):
    df, x, _, k = wide
    z = (k + np.random.default_rng(0).integers(0, 2, len(k)) > 1).astype(float)
    df2 = df.sparkSession.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, z)], "a double, b double, c double, d double, z double")
    r = R.logistic_regression(df2, "z", ["a", "c"])
    X = np.c_[np.ones(len(x)), x[:, [0, 2]]]
    pi = 1 / (1 + np.exp(-X @ r.coefficients))
    assert np.abs(X.T @ (z - pi)).max() < 1e-3
    assert np.allclose(r.covariance, np.linalg.inv((X * (pi * (1 - pi))[:, None]).T @ X), rtol=1e-3)
    assert r.predict(df2).where("prediction between 0 and 1").count() == len(x)


@pytest.mark.parametrize("penalty,updater", [(P.L1(8.0), U.Fista()), (P.L1(8.0), U.CoordinateDescent()), (P.ElasticNet(8.0, 3.0), U.CoordinateDescent(True)), (P.L2(5.0), U.Newton()), (P.L2(5.0), U.CoordinateDescent())])
def test_linear_kkt(wide, penalty, updater):
    df, x, y, _ = wide
    r = optimize(df, "y", list("abcd"), penalty=penalty, updater=updater, normalize=False, stop=U.relative_stop(1e-13), tail=1, max_iterations=5000)
    X, b = np.c_[np.ones(len(x)), x], r.coefficients
    g = X.T @ (y - X @ b)
    assert abs(g[0]) < 1e-4
    l1, l2 = {P.L1: lambda p: (p.strength, 0), P.L2: lambda p: (0, p.strength), P.ElasticNet: lambda p: (p.first, p.second)}[type(penalty)](penalty)
    for j in range(1, 5):
        if b[j]:
            assert g[j] == pytest.approx(l1 * np.sign(b[j]) + l2 * b[j], abs=1e-3)
        else:
            assert abs(g[j]) <= l1 + 1e-6


def test_logistic_l1_agrees_between_solvers(wide):
    df, x, _, k = wide
    df = df.withColumn("z", (F.col("k") + F.col("row_id") % 2 > 1).cast("double"))
    fits = [optimize(df, "z", ["a", "c", "d"], Logistic(), P.L1(2.0), u, normalize=False, stop=U.relative_stop(1e-9), tail=1, max_iterations=150).coefficients for u in (U.CoordinateDescent(), U.Fista())]
    assert np.allclose(*fits, atol=2e-2)


def test_multinomial_two_classes_is_logistic(wide):
    df, *_ = wide
    df = df.withColumn("z", (F.col("k") + F.col("row_id") % 2 > 1).cast("int"))
    a = optimize(df, "z", ["a", "c"], Multinomial(2), P.L2(1.0), U.Newton(), tail=1, max_iterations=20)
    b = optimize(df, "z", ["a", "c"], Logistic(), P.L2(1.0), U.Newton(), tail=1, max_iterations=20)
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-5)
    assert set(a.names) == {"intercept_1", "a_1", "c_1"}


def test_multinomial_gradient(wide):
    df, x, _, k = wide
    o = Multinomial(3).on(Data(df, ["a", "c"], "k", np.ones(2)))
    b = np.array([0.1, -0.2, 0.3, 0.4])
    num = [(o.value(b + d) - o.value(b - d)) / 2e-5 for d in np.eye(4) * 1e-5]
    assert np.allclose(o.gradient(b), num, atol=1e-4)
    num = [(o.gradient(b + d) - o.gradient(b - d)) / 2e-4 for d in np.eye(4) * 1e-4]
    assert np.allclose(o.hessian(b), num, atol=1e-3)
    o.close()


@pytest.mark.parametrize("updater", [U.FixedStep(0.005), U.AdaGrad(0.5), U.RmsProp(0.01), U.AdaDelta(), U.Adam(0.05), U.DecayingMomentum(0.2)])
def test_first_order_updaters_climb(wide, updater):
    df, *_ = wide
    o = Linear().on(Data(df, list("abcd"), "y", np.ones(4)))
    s, start = U.State(np.zeros(4)), o.value(np.zeros(4))
    for _ in range(50):
        s = updater.next(s, o, P.L2(0.1))
    assert o.value(s.point) > start


def test_sharp_penalties_refuse_gradients():
    with pytest.raises(TypeError):
        P.L1(1.0).gradient(np.ones(1), np.ones(1))
    assert P.ElasticNet(1, 1).prox(np.array([5.0]), np.array([np.inf]), 1.0)[0] == 0


def test_json_round_trip_and_missing_columns(wide):
    df, *_ = wide
    r = optimize(df, "y", ["a", "c"], penalty=P.L2(0.1), tail=1)
    again = FitResult.from_json(r.to_json())
    a, b = (m.predict(df).orderBy("row_id").toPandas()["prediction"] for m in (r, again))
    assert np.allclose(a, b)
    assert r.predict(df.drop("c")).count() == df.count()


def test_rbf_fit(spark):
    x = np.arange(200) / 100
    df = spark.createDataFrame([(float(v), float(v * v)) for v in x], "x double, y double")
    c = np.linspace(0, 2, 6)[:, None]
    r = optimize(df, "y", ["x"], penalty=P.L2(1e-3), updater=U.Newton(), map=Rbf(["x"], c, rbf_bandwidths(c), 2.0), tail=1)
    assert r.evaluate(df, "y")["r2"] > 0.99
    assert FitResult.from_json(r.to_json()).evaluate(df, "y")["r2"] > 0.99


def test_wide_moments_match_expressions(spark):
    x = np.random.default_rng(2).normal(size=(50, 45))
    names = [f"c{i}" for i in range(45)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    m = moments(df, names)
    assert m.n == 50 and np.allclose(m.cross, x.T @ x)


def test_distributions():
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_upper(dist.chi2_quantile(0.9, 7), 7) == pytest.approx(0.1)
    assert dist.beta_cdf(dist.beta_quantile(0.3, 2.5, 4), 2.5, 4) == pytest.approx(0.3)
    assert dist.normal_upper(10) == pytest.approx(7.619853e-24, rel=1e-5)
    assert dist.gamma_lower(1, 2) == pytest.approx(1 - math.exp(-2))


def test_validation_and_minibatch(wide):
    df, *_ = wide
    r = optimize(df, "y", ["a", "c"], validation=F.col("row_id") % 5 == 0, tail=3, max_iterations=20)
    assert r.validation is not None and r.coefficients[1] == pytest.approx(1.5, abs=0.2)
    r = optimize(df, "y", ["a", "c"], updater=U.AdaGrad(1.0), batch_size=40, key="row_id", max_iterations=60, tail=10)
    assert r.coefficients[1] == pytest.approx(1.5, abs=0.5)
