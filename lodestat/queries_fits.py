"""Queries of whole fits, with SQL that solves the same problems: normal equations, Newton steps and coordinate steps on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .operators.kernels import Rbf, feature_map
from .plans import penalties, regression, selection, updaters
from .plans.fit import FitResult, bagged, deviation_factors, iterate, optimize, optimize_vectors
from .plans.objectives import Data, Linear, Logistic, Multinomial
from .plans.rows import Vectors
from .queries import _CENTRES, _E4, _GRAM2, _SIMPLE, E4, X3, _part, _unrolled, e4, query, rounded, row, table
from .sqltext import gram, logistic_newton, logistic_sums, normal_tail, solved, t_quantile, t_tail, unit

_TERMS = ["intercept", *X3]
_XY = "(SELECT 1.0::double AS c, l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS y FROM lineitem)"
_SUMS = f"s AS MATERIALIZED (SELECT {gram(['c', 'q', 'd', 't', 'y'])}, count(*)::double AS n FROM {_XY})"
_RIGHT = [f"a{i}_4" for i in range(4)]


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


_OLS = f"""WITH {_SUMS}, {solved('b', 's', 4, [_RIGHT, *[unit(4, i) for i in range(4)]])},
 v AS (SELECT (a4_4 - {' - '.join(f'x0_{i} * a{i}_4' for i in range(4))}) / (n - 4) AS s2, n FROM s, b),
 r AS ({_union([f"SELECT '{t}' AS term, x0_{i} AS estimate, sqrt(s2 * x{i + 1}_{i}) AS std_error, n FROM b, v" for i, t in enumerate(_TERMS)])})
 SELECT term, round(estimate, 2) + 0 AS estimate, round(std_error, 3) + 0 AS std_error, round(estimate / std_error, 4) + 0 AS statistic, round({t_tail('estimate / std_error', '(n - 4)')}, 5) + 0 AS p_value FROM r"""


@query(_OLS)
def ols_multi_terms(spark, sf):
    r = regression.linear_regression(table(spark, sf, "lineitem"), "l_extendedprice", X3)
    return rounded(r.table(spark), estimate=2, std_error=3, statistic=4, p_value=5)


@query(f"""WITH {_SIMPLE}, e AS (SELECT p_partkey, y - a - b * x AS e, 1 / n + (x - mx) * (x - mx) / sxx AS h, rss, n FROM p, c), z AS (SELECT p_partkey, e / sqrt((rss - e * e) / (n - 3) * (1 - h)) AS t, n FROM e)
 SELECT p_partkey, round(t, 5) + 0 AS studentized, round({t_tail('t', '(n - 3)')}, 5) + 0 AS p_value FROM z""")
def outlier_p_values(spark, sf):
    df = _part(spark, sf)
    r = regression.linear_regression(df, "y", ["x"])
    out = regression.outlier_p_values(regression.influence(r, df, "y").select("p_partkey", "studentized"), r.n - len(r.terms) - 1)
    return rounded(out, studentized=5, p_value=5)


_LOGIT = "x AS (SELECT 1.0::double AS c, l_quantity AS q, l_discount AS d, l_tax AS t, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::double AS y FROM lineitem)"
_LOGIT_AT = f"{_LOGIT}, {logistic_newton('x', list('cqdt'), 8)}, {logistic_sums('z', 'x', list('cqdt'), 'b8')}"


def _returned(spark, sf):
    return table(spark, sf, "lineitem").select(*X3, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))


@query(f"""WITH {_LOGIT_AT}, {solved('v', 'z', 4, [unit(4, i) for i in range(4)])},
 r AS ({_union([f"SELECT '{t}' AS term, b8.x0_{i} AS estimate, sqrt(v.x{i}_{i}) AS std_error FROM b8, v" for i, t in enumerate(_TERMS)])})
 SELECT term, round(estimate, 5) + 0 AS estimate, round(std_error, 5) + 0 AS std_error, round(estimate / std_error, 3) + 0 AS statistic, round({normal_tail('estimate / std_error')}, 4) + 0 AS p_value FROM r""")
def logistic_fit(spark, sf):
    return rounded(regression.logistic_regression(_returned(spark, sf), "y", X3).table(spark), estimate=5, std_error=5, statistic=3, p_value=4)


@query(f"WITH {_LOGIT_AT} SELECT round(l, 3) AS loglik, round(-2 * l + 4 * ln((SELECT count(*) FROM x)), 3) AS bic FROM z")
def logistic_likelihood(spark, sf):
    from .functions.tests import bic

    r = regression.logistic_regression(_returned(spark, sf), "y", X3).likelihood
    return rounded(row(spark, loglik=r.value, bic=bic(r)), loglik=3, bic=3)


_Z95 = 1.6448536269514722
_BAYES = f"""WITH {_SUMS}, w AS (SELECT * REPLACE (a1_1 + 1 AS a1_1, a2_2 + 1 AS a2_2, a3_3 + 1 AS a3_3) FROM s), {solved('b', 'w', 4, [_RIGHT, *[unit(4, i) for i in range(4)]])},
 v AS (SELECT (a4_4 - {' - '.join(f'x0_{i} * a{i}_4' for i in range(4))}) / n AS scale, n FROM s, b),
 r AS ({_union([f"SELECT '{t}' AS term, x0_{i} AS mean, x{i + 1}_{i} * scale AS shape, n FROM b, v" for i, t in enumerate(_TERMS)])})
 SELECT term, round(mean, 2) + 0 AS mean, round(shape * n / (n - 2), 2) + 0 AS variance, round(mean - sqrt(shape) * {t_quantile(_Z95, 'n')}, 2) + 0 AS low, round(mean + sqrt(shape) * {t_quantile(_Z95, 'n')}, 2) + 0 AS high FROM r"""


@query(_BAYES)
def bayesian_posterior(spark, sf):
    r = regression.bayesian_regression(table(spark, sf, "lineitem"), "l_extendedprice", X3, 1.0, {"intercept": 0.0})
    lo, hi = r.quantile(0.05), r.quantile(0.95)
    out = spark.createDataFrame([(t, float(r.mean[i]), float(r.variances[i]), float(lo[i]), float(hi[i])) for i, t in enumerate(r.terms)], "term string, mean double, variance double, low double, high double")
    return rounded(out, mean=2, variance=2, low=2, high=2)


_BAYES_PART = """p AS (SELECT p_partkey, p_size::double AS x, p_retailprice AS y FROM part), s AS MATERIALIZED (SELECT count(*)::double + 2 AS a, sum(x) AS b, sum(x * x) + 2 AS c, sum(y) AS u, sum(x * y) AS v, sum(y * y) AS yy, count(*)::double AS n FROM p),
 i AS MATERIALIZED (SELECT c / (a * c - b * b) AS i00, -b / (a * c - b * b) AS i01, a / (a * c - b * b) AS i11, * FROM s), m AS MATERIALIZED (SELECT i00 * u + i01 * v AS m0, i01 * u + i11 * v AS m1, * FROM i),
 k AS MATERIALIZED (SELECT (yy - m0 * u - m1 * v) / n AS scale, * FROM m)"""


@query(f"""WITH {_BAYES_PART} SELECT p_partkey, round(m0 + m1 * p.x, 4) AS predictive_mean, round(scale * (1 + i00 + 2 * i01 * p.x + i11 * p.x * p.x) * n / (n - 2), 3) AS predictive_variance,
 round(m0 + m1 * p.x + sqrt(scale * (1 + i00 + 2 * i01 * p.x + i11 * p.x * p.x)) * {t_quantile(_Z95, 'n')}, 3) AS predictive_quantile FROM p, k""")
def bayes_predictive(spark, sf):
    df = _part(spark, sf)
    r = regression.bayesian_regression(df, "y", ["x"], 2.0)
    return rounded(r.predictive(df, p=0.95).drop("x", "y"), predictive_mean=4, predictive_variance=3, predictive_quantile=3)


@query(f"""WITH {_BAYES_PART}, q AS (SELECT n_nationkey AS key, n_nationkey::double AS x FROM nation)
 SELECT a.key AS i, b.key AS j, round(scale * (i00 + i01 * (a.x + b.x) + i11 * a.x * b.x + CASE WHEN a.key = b.key THEN 1 ELSE 0 END) * n / (n - 2), 4) AS v FROM q a, q b, k""")
def bayes_predictive_covariance(spark, sf):
    r = regression.bayesian_regression(_part(spark, sf), "y", ["x"], 2.0)
    points = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("double").alias("x"))
    return rounded(r.predictive_covariance(points, "key"), v=4)


# --- penalised fits ------------------------------------------------------------------------------------------

_CENTRED = f"""m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(t) AS mt, avg(y) AS my, stddev_samp(q) AS sq, stddev_samp(d) AS sd, stddev_samp(t) AS st FROM {_XY}),
 g AS MATERIALIZED (SELECT {', '.join(f'sum(({a} - m{a}) / s{a} * ({b} - m{b}) / s{b}) AS g{i}{j}' for i, a in enumerate('qdt') for j, b in enumerate('qdt') if i <= j)}, {', '.join(f'sum(({a} - m{a}) / s{a} * (y - my)) AS c{i}' for i, a in enumerate('qdt'))} FROM {_XY}, m)"""


def _sweeps(first: float, second: float, n: int = 60) -> str:
    """A recursive CTE of coordinate sweeps with a soft threshold on the centred, scaled cross products."""
    at = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    inner = "(SELECT k, b0, b1, b2 FROM t WHERE k < {n}) AS t0, g".format(n=n)
    for i in range(3):
        r = f"c{i} - " + " - ".join(f"{at(i, j)} * {'n' if j < i else 'b'}{j}" for j in range(3) if j != i)
        inner = f"(SELECT *, sign({r}) * greatest(0, abs({r}) - {first!r}) / ({at(i, i)} + {second!r}) AS n{i} FROM {inner})"
    return f"t AS (SELECT 0 AS k, 0.0::double AS b0, 0.0::double AS b1, 0.0::double AS b2 UNION ALL SELECT k + 1 AS k, n0 AS b0, n1 AS b1, n2 AS b2 FROM {inner})"


def _sparse_sql(first: float, second: float) -> str:
    last = "(SELECT * FROM t WHERE k = 60)"
    rows = [f"SELECT 'intercept' AS term, round(my - b0 / sq * mq - b1 / sd * md - b2 / st * mt, 1) + 0 AS estimate FROM {last}, m"]
    rows += [f"SELECT '{x}', round(b{i} / s{a}, 1) + 0 FROM {last}, m" for i, (x, a) in enumerate(zip(X3, "qdt", strict=True))]
    return f"WITH RECURSIVE {_CENTRED}, {_sweeps(first, second)} {_union(rows)}"


_TIGHT = {"stop": updaters.relative_stop(1e-14), "max_iterations": 3000}


@query(_sparse_sql(1e6, 0.0))
def lasso_fit(spark, sf):
    return rounded(optimize(table(spark, sf, "lineitem"), "l_extendedprice", X3, penalty=penalties.L1(1e6), updater=updaters.Fista(), stop=updaters.settled(1e-12), max_iterations=3000).table(spark), estimate=1)


@query(_sparse_sql(1e6, 1e3))
def elastic_net_fit(spark, sf):
    return rounded(optimize(table(spark, sf, "lineitem"), "l_extendedprice", X3, penalty=penalties.ElasticNet(1e6, 1e3), updater=updaters.CoordinateDescent(active=True), **_TIGHT).table(spark), estimate=1)


def _logit_l1_sql(strength: float, outer: int = 9, sweeps: int = 60) -> str:
    """Newton models of the log-likelihood, each solved by coordinate sweeps with a soft threshold; columns are scaled by their deviations."""
    p, cols = 4, ["c", "q", "d", "t"]
    out = ["u AS (SELECT stddev_samp(q) AS sq, stddev_samp(d) AS sd, stddev_samp(t) AS st FROM x0)", "x AS MATERIALIZED (SELECT c, q / sq AS q, d / sd AS d, t / st AS t, y FROM x0, u)", f"b0 AS MATERIALIZED (SELECT {', '.join(f'0.0::double AS x0_{i}' for i in range(p))})"]
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    for s in range(outer):
        out.append(logistic_sums(f"s{s}", "x", cols, f"b{s}"))
        inner = f"(SELECT * FROM t{s} WHERE k < {sweeps}) AS o, s{s}, b{s}"
        for i in range(p):  # the model's gradient at the new point, with entry i as it was at the start
            r = f"g{i} + {at(i, i)} * x0_{i} - " + " - ".join(f"{at(i, j)} * ({'n' if j < i else 'w'}{j} - x0_{j})" for j in range(p) if j != i)
            value = f"({r}) / {at(i, i)}" if i == 0 else f"sign({r}) * greatest(0, abs({r}) - {strength!r}) / {at(i, i)}"
            inner = f"(SELECT *, {value} AS n{i} FROM {inner})"
        names = ", ".join(f"n{i} AS w{i}" for i in range(p))
        out.append(f"t{s} AS (SELECT 0 AS k, {', '.join(f'x0_{i} AS w{i}' for i in range(p))} FROM b{s} UNION ALL SELECT k + 1 AS k, {names} FROM {inner})")
        out.append(f"b{s + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} AS x0_{i}' for i in range(p))} FROM t{s} WHERE k = {sweeps})")
    rows = [f"SELECT '{t}' AS term, round(x0_{i}{'' if i == 0 else f' / s{cols[i]}'}, 4) + 0 AS estimate FROM b{outer}, u" for i, t in enumerate(_TERMS)]
    return f"WITH RECURSIVE {_LOGIT.replace('x AS', 'x0 AS', 1)}, {', '.join(out)} {_union(rows)}"


@query(_logit_l1_sql(20.0))
def logistic_l1_fit(spark, sf):
    return rounded(optimize(_returned(spark, sf), "y", X3, Logistic(), penalties.L1(20.0), updaters.CoordinateDescent(active=True), stop=updaters.relative_stop(1e-12), max_iterations=40, tail=1).table(spark), estimate=4)


def _multinomial_sums(name: str, cols: list[str], at: str, ridge: list[float], k: int = 2) -> str:
    """Gradient g{u} and minus the Hessian a{u}_{v} of a multinomial fit (class 0 as baseline) at x0_{u}, u = column * k + logit."""
    eta = ", ".join(" + ".join(f"{c} * x0_{i * k + e}" for i, c in enumerate(cols)) + f" AS h{e}" for e in range(k))
    pis = ", ".join(f"exp(h{e}) / (1 + {' + '.join(f'exp(h{f})' for f in range(k))}) AS p{e}" for e in range(k))
    u = [(i, e) for i in range(len(cols)) for e in range(k)]
    g = [f"sum(((y = {e + 1})::int - p{e}) * {cols[i]}) - {ridge[i]!r} * any_value(x0_{i * k + e}) AS g{n}" for n, (i, e) in enumerate(u)]
    h = [f"sum({cols[i]} * {cols[j]} * p{e} * ({int(e == f)} - p{f})) + {ridge[i] if n == m else 0.0!r} AS a{n}_{m}" for n, (i, e) in enumerate(u) for m, (j, f) in enumerate(u) if n <= m]
    return f"{name} AS MATERIALIZED (SELECT {', '.join(g + h)} FROM (SELECT *, {pis} FROM (SELECT *, {eta} FROM x, {at})))"


def _multinomial_sql(steps: int = 7) -> str:
    cols, k = ["c", *E4], 2
    n = len(cols) * k
    ridge = [0.0, *[1.0] * 4]
    out = [f"u AS (SELECT {', '.join(f'stddev_samp({e}) AS s{e}' for e in E4)} FROM {_E4})", f"x AS MATERIALIZED (SELECT 1.0::double AS c, {', '.join(f'{e} / s{e} AS {e}' for e in E4)}, label % 3 AS y FROM {_E4}, u)"]
    out.append(f"b0 AS MATERIALIZED (SELECT {', '.join(f'0.0::double AS x0_{i}' for i in range(n))})")
    for s in range(steps):
        out += [_multinomial_sums(f"s{s}", cols, f"b{s}", ridge), solved(f"d{s}", f"s{s}", n, [[f"g{i}" for i in range(n)]])]
        out.append(f"b{s + 1} AS MATERIALIZED (SELECT {', '.join(f'b{s}.x0_{i} + d{s}.x0_{i} AS x0_{i}' for i in range(n))} FROM b{s}, d{s})")
    rows = [f"SELECT '{'intercept' if i == 0 else cols[i]}_{e + 1}' AS term, round(x0_{i * k + e}{'' if i == 0 else f' / s{cols[i]}'}, 5) + 0 AS estimate FROM b{steps}, u" for i in range(len(cols)) for e in range(k)]
    return f"WITH {', '.join(out)} {_union(rows)}"


@query(_multinomial_sql())
def multinomial_fit(spark, sf):
    df = e4(spark, sf).withColumn("k", F.col("label") % 3)
    return rounded(optimize(df, "k", E4, Multinomial(3), penalties.L2(1.0), updaters.Newton(), max_iterations=30, tail=2).table(spark), estimate=5)


_AT3 = [0.1, -0.2, 0.3, 0.4, -0.5, 0.6]


@query(f"""WITH x AS (SELECT 1.0::double AS c, e0, e1, label % 3 AS y FROM {_E4}), b AS (SELECT {', '.join(f'{v!r}::double AS x0_{i}' for i, v in enumerate(_AT3))}), {_multinomial_sums('s', ['c', 'e0', 'e1'], 'b', [0.0] * 3)}
 {_union([f"SELECT {i}::bigint AS i, -1::bigint AS j, round(g{i}, 6) + 0 AS v FROM s" for i in range(6)] + [f"SELECT {i}::bigint AS i, {j}::bigint AS j, round(-a{min(i, j)}_{max(i, j)}, 6) + 0 AS v FROM s" for i in range(6) for j in range(6)])}""")
def multinomial_gradient_hessian(spark, sf):
    """Gradient (j = -1) and Hessian at a point."""
    df = e4(spark, sf).select(F.lit(1.0).alias("c"), "e0", "e1", (F.col("label") % 3).alias("k"))
    o = Multinomial(3).on(Data(df, ["c", "e0", "e1"], "k", np.zeros(3)))
    b = np.array(_AT3)
    h = o.hessian(b)
    g = o.gradient(b)
    o.close()
    cells = [(i, -1, float(g[i])) for i in range(6)] + [(i, j, float(h[i, j])) for i in range(6) for j in range(6)]
    return rounded(spark.createDataFrame(cells, "i long, j long, v double"), v=6)


@query(f"""WITH x AS (SELECT vec_id, 0.1 + 0.3 * e0 - 0.5 * e1 AS h1, -0.2 + 0.4 * e0 + 0.6 * e1 AS h2 FROM {_E4}), p AS (SELECT vec_id, 1 / (1 + exp(h1) + exp(h2)) AS p0, exp(h1) / (1 + exp(h1) + exp(h2)) AS p1, exp(h2) / (1 + exp(h1) + exp(h2)) AS p2 FROM x)
 SELECT vec_id, round(p0, 7) AS prediction_0, round(p1, 7) AS prediction_1, round(p2, 7) AS prediction_2, (CASE WHEN p2 >= greatest(p0, p1) THEN 2 WHEN p1 >= p0 THEN 1 ELSE 0 END)::int AS prediction FROM p""")
def multinomial_predict(spark, sf):
    df = e4(spark, sf).withColumn("c", F.lit(1.0))
    out = Multinomial(3).predict(df, ["c", "e0", "e1"], np.array(_AT3))
    return rounded(out.select("vec_id", "prediction_0", "prediction_1", "prediction_2", "prediction"), prediction_0=7, prediction_1=7, prediction_2=7)


@query(f"SELECT round(0.5 * sum(1 + e0 * e0 + e1 * e1), 6) AS multinomial, round(0.25 * sum(1 + e0 * e0 + e1 * e1), 6) AS logistic FROM {_E4}")
def step_bound(spark, sf):
    """The bound of the curvature of wide fits: a share of the trace of X'X."""
    df = e4(spark, sf).select(F.lit(1.0).alias("c"), "e0", "e1", (F.col("label") % 3).alias("k"))
    d = Data(df, ["c", "e0", "e1"], "k", np.zeros(3))
    a, b = Multinomial(3).on(d), d.rows("logistic")
    out = row(spark, multinomial=float(a.curvature), logistic=float(b.curvature))
    a.close()
    b.close()
    return rounded(out, multinomial=6, logistic=6)


_WIDE64 = [f"embedding[{i + 1}]::double" for i in range(64)]


@query(f"""WITH x AS (SELECT vec_id, (label % 2)::double AS y, sum(embedding[k]::double * ((k * 7) % 5 - 2) * 0.1) AS eta FROM embeddings, range(1, 65) AS r(k) GROUP BY vec_id, label), r AS (SELECT vec_id, y - 1 / (1 + exp(-eta)) AS r FROM x)
 SELECT k - 1 AS j, round(sum(CASE WHEN embedding[k] > 0.1 THEN embedding[k]::double ELSE 0 END * r), 6) + 0 AS g FROM embeddings JOIN (SELECT vec_id, y - 1 / (1 + exp(-eta)) AS r FROM (SELECT vec_id, any_value((label % 2)::double) AS y, sum(CASE WHEN embedding[k] > 0.1 THEN embedding[k]::double ELSE 0 END * ((k * 7) % 5 - 2) * 0.1) AS eta FROM embeddings, range(1, 65) AS r(k) GROUP BY vec_id)) USING (vec_id), range(1, 65) AS r(k) GROUP BY k""")
def sparse_logistic_gradient(spark, sf):
    """Gradient of a logistic fit on sparse rows: the entries of all 64 components above 0.1."""
    df, at = _sparse(spark, sf)
    from .plans.objectives import VectorData

    o = Logistic().on(VectorData(df.withColumn("y", F.col("label") % 2), at, "y", np.zeros(64)))
    g = o.gradient(np.array([((k * 7) % 5 - 2) * 0.1 for k in range(1, 65)]))
    o.close()
    return rounded(spark.createDataFrame([(j, float(v)) for j, v in enumerate(g)], "j long, g double"), g=6)


def _sparse(spark, sf, intercept: bool = False):
    x = F.filter(F.transform("embedding", lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"), v.alias("f"))), lambda c: c["f"] > F.lit(0.1).cast("float"))
    df = table(spark, sf, "embeddings").select("vec_id", "label", x.alias("x")).select("vec_id", "label", F.col("x.i").alias("at"), F.col("x.v").alias("values"))
    return df, Vectors(64, None, "at", "values", intercept)


def _dense_ols(columns: list[str], source: str, digits: int, l2: float = 0.0) -> str:
    """Normal equations of y on a constant and columns, penalised by l2 in units of each column's deviation."""
    p = len(columns)
    names = ["one", *[f"x{i}" for i in range(p)], "y"]
    rows = f"(SELECT 1.0::double AS one, {', '.join(f'{c} AS x{i}' for i, c in enumerate(columns))}, y FROM {source})"
    scaled = f"(SELECT one, {', '.join(f'x{i} / s{i} AS x{i}' for i in range(p))}, y FROM rows, u)"
    sums = ", ".join(f"sum({a} * {b})::double + {l2 if i == j and 0 < i <= p else 0.0!r} AS a{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    out = f"""WITH rows AS MATERIALIZED {rows}, u AS MATERIALIZED (SELECT {', '.join(f'stddev_samp(x{i}) AS s{i}' for i in range(p))} FROM rows), s AS MATERIALIZED (SELECT {sums} FROM {scaled}), {solved('b', 's', p + 1, [[f'a{i}_{p + 1}' for i in range(p + 1)]])} """
    return out + _union([f"SELECT {i}::bigint AS i, round(x0_{i}{'' if i == 0 else f' / s{i - 1}'}, {digits}) + 0 AS b FROM b, u" for i in range(p + 1)])


@query(_dense_ols(_WIDE64[:16], "(SELECT embedding, label::double AS y FROM embeddings)", 6, 1.0))
def vector_ridge_fit(spark, sf):
    """Ridge on an array column (its first 16 entries, as the SQL eliminates one column a step)."""
    df = table(spark, sf, "embeddings").select(F.slice("embedding", 1, 16).alias("x"), F.col("label").cast("double").alias("y"))
    r = optimize_vectors(df, "y", Vectors(16, "x"), penalty=penalties.L2(1.0), updater=updaters.Newton(), tail=1)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.coefficients)], "i long, b double"), b=6)


# --- the iterative fit and its parts -----------------------------------------------------------------------


@query("SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 1) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def default_fit(spark, sf):
    """Defaults of the iterative fit (coordinate descent, no penalty, the mean of 50 iterates from the stop on) but for a tighter stop."""
    r = optimize(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], stop=updaters.relative_stop(1e-14))
    return rounded(r.table(spark).withColumn("estimate", F.when(F.col("term") == "intercept", F.round("estimate", 1)).otherwise(F.round("estimate", 3))), estimate=6)


@query(f"WITH {_LOGIT.replace('l_quantity AS q, l_discount AS d, l_tax AS t', 'l_discount AS d')}, {logistic_newton('x', list('cd'), 8)} SELECT 'intercept' AS term, round(x0_0, 6) + 0 AS estimate FROM b8 UNION ALL SELECT 'l_discount', round(x0_1, 6) + 0 FROM b8")
def logistic_default_tail(spark, sf):
    """A logistic Newton fit with the default tail: the mean is of iterates at the optimum only."""
    r = optimize(_returned(spark, sf), "y", ["l_discount"], Logistic(), updater=updaters.Newton(), stop=updaters.relative_stop(1e-12))
    return rounded(r.table(spark), estimate=6)


@query("WITH f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM (SELECT p_size::double AS x, p_retailprice AS y FROM part)) SELECT p_partkey, round(a + b * p_size, 4) AS prediction, round(a, 4) AS without FROM part, f")
def model_json(spark, sf):
    """A fit written as JSON, read again, and applied to all rows and to rows without the column."""
    df = _part(spark, sf)
    r = FitResult.from_json(optimize(df, "y", ["x"], updater=updaters.Newton(), tail=1).to_json())
    bare = r.predict(df.drop("x")).select("p_partkey", F.col("prediction").alias("without"))
    return rounded(r.predict(df).select("p_partkey", "prediction").join(bare, "p_partkey"), prediction=4, without=4)


@query("WITH f AS (SELECT p_partkey % 2 AS h, regr_intercept(p_retailprice, p_size::double) AS a, regr_slope(p_retailprice, p_size::double) AS b FROM part GROUP BY 1) SELECT 'intercept' AS term, round(avg(a), 4) AS estimate FROM f UNION ALL SELECT 'x', round(avg(b), 5) FROM f")
def bagged_fit(spark, sf):
    df = _part(spark, sf)
    r = bagged([optimize(df.where(F.col("p_partkey") % 2 == h), "y", ["x"], updater=updaters.Newton(), tail=1) for h in (0, 1)])
    return rounded(r.table(spark).withColumn("estimate", F.when(F.col("term") == "intercept", F.round("estimate", 4)).otherwise(F.round("estimate", 5))), estimate=6)


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 7) AS r2 FROM lineitem")
def fit_evaluate(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(row(spark, r2=float(optimize(df, "l_extendedprice", ["l_quantity"], updater=updaters.Newton(), tail=1).evaluate(df, "l_extendedprice")["r2"])), r2=7)


class _Halfway:
    """An updater of one's own: half a Newton step."""

    def next(self, state, objective, penalty):
        full = updaters.Newton().next(state, objective, penalty)
        return updaters.State((state.point + full.point) / 2)


_X1 = "SELECT sum(l_quantity * l_quantity) / 1e6 AS xx, sum(l_quantity * l_extendedprice) / 1e6 AS xy FROM lineitem"
query(f"WITH s AS ({_X1}) SELECT round(xy / xx * (1 - pow(0.5, 5)), 4) AS b FROM s")(_unrolled("custom_updater", _Halfway(), 5))


def _path(n: int) -> str:
    """Objective per row along half Newton steps, in SQL: b_k = b (1 - 1/2^k)."""
    return f"""s AS (SELECT sum(l_quantity * l_quantity) / 1e6 AS xx, sum(l_quantity * l_extendedprice) / 1e6 AS xy, sum(l_extendedprice * l_extendedprice) / 1e6 AS yy, count(*)::double AS n FROM lineitem),
 p AS MATERIALIZED (SELECT k, xy / xx * (1 - pow(0.5, k)) AS b, xx, xy, yy, n FROM s, range(1, {n}) AS r(k)), v AS MATERIALIZED (SELECT k, b, -(yy - 2 * b * xy + b * b * xx) / n AS v FROM p), w AS MATERIALIZED (SELECT *, lag(v) OVER (ORDER BY k) AS u FROM v)"""


def _stopped(spark, sf, stop) -> int:
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") / 1000).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    o = Linear().on(Data(df, ["x"], "y", np.ones(1)))
    return iterate(iter(lambda: o, None), None, 1, _Halfway(), penalties.NoPenalty(), stop, 0, 60, 1)[1].iteration


@query(f"""WITH {_path(60)}, a AS (SELECT min(k) AS k FROM w WHERE abs(v - u) < 1e-3), r AS (SELECT min(k) AS k FROM w WHERE abs((v - u) / v) < 1e-4), f AS (SELECT 7 AS k), m AS (SELECT *, max(v) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM w)
 SELECT 'absolute' AS rule, k::bigint AS iteration FROM a UNION ALL SELECT 'relative', k::bigint FROM r UNION ALL SELECT 'fixed', k::bigint FROM f UNION ALL SELECT 'stall', min(k)::bigint FROM m WHERE v - best < 1e-2""")
def stop_rules(spark, sf):
    """At which step each rule ends the same path. stall: the first step that is no better than the best by 0.01."""
    rules = {"absolute": updaters.absolute_stop(1e-3), "relative": updaters.relative_stop(1e-4), "fixed": updaters.fixed_iterations(7), "stall": updaters.stall(1, 1e-2)}
    return spark.createDataFrame([(n, _stopped(spark, sf, s)) for n, s in rules.items()], "rule string, iteration long")


@query(f"WITH {_path(9)} SELECT k::bigint AS iteration, round(b, 5) AS b, round(v, 7) AS train, round(coalesce((v - u) / v, -1), 7) AS train_change FROM w")
def step_record(spark, sf):
    """Iterates with objective per row and its relative change (-1 for the first)."""
    seen = []
    _stopped(spark, sf, lambda s: bool(seen.append(s)) or s.iteration >= 8)
    rows = [(s.iteration, float(s.point[0]), float(s.train), -1.0 if s.train_change != s.train_change else float(s.train_change)) for s in seen]
    return rounded(spark.createDataFrame(rows, "iteration long, b double, train double, train_change double"), b=5, train=7, train_change=7)


@query("""WITH RECURSIVE s AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy FROM (SELECT p_size / 10.0 AS x, p_retailprice / 1000 AS y FROM part)),
 t AS (SELECT 0 AS k, 0.0::double AS b, 0.0::double AS g, xx, xy FROM s UNION ALL SELECT k + 1, b + 0.05 * (xy - xx * b) / sqrt(g + (xy - xx * b) * (xy - xx * b) + 1e-8), g + (xy - xx * b) * (xy - xx * b), xx, xy FROM t WHERE k < 8)
 SELECT round(avg(b), 6) AS b FROM t WHERE k IN (5, 6, 7, 8)""")
def minibatch_whole(spark, sf):
    """Mini-batches as large as the table."""
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    r = optimize(df, "y", ["x"], updater=updaters.AdaGrad(0.05), add_intercept=False, normalize=False, batch_size=10**9, key="p_partkey", max_iterations=6, tail=4, stop=lambda s: False)
    return rounded(row(spark, b=float(r.coefficients[0])), b=6)


@query("""WITH RECURSIVE n AS (SELECT count(*) // 500 + 1 AS nb, stddev_samp(p_size::double) AS s FROM part),
 o AS MATERIALIZED (SELECT e, (row_number() OVER (PARTITION BY e ORDER BY md5(p_partkey || ':42:' || e), p_partkey) - 1) % nb AS batch, p_size / s AS x, p_retailprice AS y, nb FROM part, n, range(30) AS r(e)),
 g AS MATERIALIZED (SELECT e * any_value(nb) + batch AS k, count(*)::double AS c, sum(x) AS sx, sum(x * x) AS xx, sum(y) AS sy, sum(x * y) AS xy FROM o WHERE e * nb <= 24 GROUP BY e, batch),
 t AS (SELECT 0 AS k, 0.0::double AS a, 0.0::double AS b, 0.0::double AS u, 0.0::double AS v UNION ALL
  SELECT k + 1 AS k, a + 50 * ga / sqrt(u + ga * ga + 1e-8) AS a, b + 50 * gb / sqrt(v + gb * gb + 1e-8) AS b, u + ga * ga AS u, v + gb * gb AS v FROM (SELECT t.*, sy - c * a - sx * b AS ga, xy - sx * a - xx * b AS gb FROM t JOIN g ON g.k = t.k)),
 z AS (SELECT avg(a) AS a, avg(b / s) AS b FROM t, n WHERE k > nb + 1 + 8 AND k <= nb + 1 + 12)
 SELECT 'intercept' AS term, round(a, 4) AS estimate FROM z UNION ALL SELECT 'x', round(b, 4) FROM z""")
def minibatch_fit(spark, sf):
    """AdaGrad on mini-batches of some 500 rows, dealt by an MD5 of key, seed and epoch; the mean of the last 4 of 12 steps after the first epoch."""
    return rounded(optimize(_part(spark, sf), "y", ["x"], updater=updaters.AdaGrad(50.0), batch_size=500, key="p_partkey", max_iterations=12, tail=4, stop=lambda s: False).table(spark), estimate=4)


@query("WITH n AS (SELECT count(*) AS n, count(*) // 500 + 1 AS b FROM part) SELECT k AS batch, (n // b + CASE WHEN k < n % b THEN 1 ELSE 0 END)::bigint AS rows FROM n, range(1000) AS r(k) WHERE k < b")
def batch_sizes(spark, sf):
    from .plans.fit import batch_ids

    df = table(spark, sf, "part").select("p_partkey")
    return batch_ids(df, "p_partkey", df.count() // 500 + 1, 42, 0).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("rows"))


@query(f"SELECT vec_id, 1.0::double AS intercept, {', '.join(f'round(exp(-((e0 - {c[0]!r}) * (e0 - {c[0]!r}) + (e1 - {c[1]!r}) * (e1 - {c[1]!r})) / (2 * {v!r} * 2.0)), 8) AS rbf_{i}' for i, (c, v) in enumerate(zip(_CENTRES.tolist(), (0.02, 0.02, 0.025), strict=True)))} FROM {_E4}")
def feature_map_codec(spark, sf):
    """An RBF map (bandwidths times 2) from its JSON form, applied: constant, kernels; the columns it names are those it gives."""
    m = feature_map(Rbf(["e0", "e1"], _CENTRES, np.array([0.02, 0.02, 0.025]), 2.0).spec())
    out = m(e4(spark, sf)).select("vec_id", *[c for c in m.columns([]) if c])
    return rounded(out, rbf_0=8, rbf_1=8, rbf_2=8)


@query("SELECT * FROM (VALUES (1.0::double), (2.0::double)) AS t(p), (SELECT round(1 / stddev_samp(l_quantity), 8) AS f_quantity, 1.0::double AS f_one, count(*) AS n FROM lineitem) WHERE p = 1.0")
def design_factors(spark, sf):
    """Scale factors of a design matrix with a constant column: 1 / sd, and 1 for the constant."""
    df = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    f = deviation_factors(df, ["l_quantity", "one"])
    return rounded(row(spark, p=1.0, f_quantity=float(f[0]), f_one=float(f[1]), n=df.count()), f_quantity=8)


# --- selection ----------------------------------------------------------------------------------------------------


_CV = """d AS MATERIALIZED (SELECT p_size::double AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS n FROM part),
 f AS MATERIALIZED (SELECT x, y, CASE WHEN place >= floor(n * 0.9) THEN -1 ELSE floor(place / (floor(floor(n * 0.9) / 3) + 1)) END AS fold FROM d),
 c AS (SELECT unnest([1.0::double, 100.0::double]) AS l, unnest([1, 2]) AS o), h AS (SELECT DISTINCT fold FROM f WHERE fold >= 0)"""
_RIDGE1 = "regr_sxy(y, x) / any_value(s) / (regr_sxx(y, x) / (any_value(s) * any_value(s)) + any_value(l)) / any_value(s)"


@query(f"""WITH {_CV}, tr AS (SELECT l, h.fold AS out, f.x, f.y, stddev_samp(f.x) OVER (PARTITION BY l, h.fold) AS s FROM c, h, f WHERE f.fold >= 0 AND f.fold <> h.fold),
 b AS (SELECT l, out, {_RIDGE1} AS b, avg(y) AS my, avg(x) AS mx FROM tr GROUP BY l, out),
 e AS (SELECT b.l, b.out, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS e FROM b JOIN f ON f.fold = b.out GROUP BY b.l, b.out)
 SELECT l AS candidate, round(-avg(e), 3) AS score FROM e GROUP BY l""")
def nested_cv(spark, sf):
    """Inner search over ridge strengths; places by key, so that the SQL has the same folds."""
    return rounded(spark.createDataFrame([(float(s.candidate), float(s.score)) for s in _cv(spark, sf).scored], "candidate double, score double"), score=3)


@query(f"""WITH {_CV}, tr AS (SELECT l, o, h.fold AS out, f.x, f.y, stddev_samp(f.x) OVER (PARTITION BY l, h.fold) AS s FROM c, h, f WHERE f.fold >= 0 AND f.fold <> h.fold),
 b AS (SELECT l, any_value(o) AS o, out, {_RIDGE1} AS b, avg(y) AS my, avg(x) AS mx FROM tr GROUP BY l, out),
 e AS (SELECT b.l, any_value(o) AS o, avg(ee) AS e FROM (SELECT b.l, any_value(o) AS o, b.out, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS ee FROM b JOIN f ON f.fold = b.out GROUP BY b.l, b.out) AS b GROUP BY b.l),
 w AS (SELECT l FROM e ORDER BY e, o LIMIT 1), whole AS (SELECT l, x, y, stddev_samp(x) OVER () AS s FROM f, w WHERE fold >= 0), fit AS (SELECT {_RIDGE1} AS b, avg(y) AS my, avg(x) AS mx FROM whole)
 SELECT (SELECT l FROM w) AS best, round(any_value(b), 5) AS slope, round(any_value(my - b * mx), 3) AS intercept, round(-avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))), 3) AS objective,
 round(1 - sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) / regr_syy(y, y), 6) AS r2 FROM f, fit WHERE fold < 0""")
def fit_with_cv(spark, sf):
    """The refit on all inner rows and its evaluation on those held out."""
    r = _cv(spark, sf)
    out = row(spark, best=float(r.best), slope=float(r.coefficients[1]), intercept=float(r.coefficients[0]), objective=float(r.evaluation["objective"]), r2=float(r.evaluation["r2"]))
    return rounded(out, slope=5, intercept=3, objective=3, r2=6)


def _cv(spark, sf):
    placed = selection.position(_part(spark, sf), "p_partkey", order=F.col("p_partkey")).withColumnRenamed("position", "place")
    return selection.linear_with_cv(placed, "y", "p_partkey", ["x"], penalties.L2, [1.0, 100.0], updaters.Newton, inner=3, place=F.col("place"))


@query(f"""WITH {_CV}, tr AS (SELECT f.x, f.y, 100.0::double AS l, stddev_samp(x) OVER () AS s FROM f WHERE fold > 0), fit AS (SELECT {_RIDGE1} AS b, avg(y) AS my, avg(x) AS mx FROM tr)
 SELECT round(-avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))), 3) AS score FROM f, fit WHERE fold = 0""")
def fit_on_split(spark, sf):
    """A fit on given rows, judged on others, by the general search; a fit begun at its own result scores the same."""
    placed = selection.position(_part(spark, sf), "p_partkey", order=F.col("p_partkey")).withColumnRenamed("position", "place")
    n = placed.count()
    inner = selection.share(n, 0.9)
    fold = F.floor(F.col("place") / (inner // 3 + 1))
    rows = placed.where(F.col("place") < inner)
    train = lambda d, c, start: optimize(d, "y", ["x"], penalty=penalties.L2(c), updater=updaters.Newton(), start=start, tail=1)
    splits = [(rows.where(fold > 0), rows.where(fold == 0))] * 2
    return rounded(row(spark, score=selection.search(splits, "y", [100.0], train)[0].score), score=3)


@query("SELECT k AS i, round(exp(-2 + k * 1.0), 8) AS penalty, 1.0::double AS kernel FROM range(5) AS r(k)")
def search_presets(spark, sf):
    return rounded(spark.createDataFrame([(i, float(p), float(k)) for i, (p, k) in enumerate(selection.Presets.grid_1d(-2, 2, 5))], "i long, penalty double, kernel double"), penalty=8)


@query("SELECT count(*) AS draws, 0::bigint AS strangers FROM customer")
def bootstrap_sample(spark, sf):
    """As many draws as rows, all of them rows of the table."""
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    drawn = selection.bootstrap(df, "c_custkey", 42)
    strange = drawn.join(df, ["c_custkey", "c_acctbal"], "left_anti").agg(F.count("*").alias("strangers"))
    return drawn.agg(F.count("*").alias("draws")).join(strange, F.lit(True))


@query("SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS is_train FROM customer")
def split_by_keys(spark, sf):
    keys = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return selection.split_by(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), keys, "c_nationkey").select("c_custkey", "is_train")
