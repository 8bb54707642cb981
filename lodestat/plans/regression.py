"""Closed-form linear models, logistic regression by Newton steps, and Bayesian linear regression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, dist
from ..functions.tests import LogLikelihood, TestResult, student_test, z_test
from ..operators.frames import complete, dot, nan_to_null, reindex, sigmoid
from .moments import moments

INTERCEPT = "intercept"


@dataclass(frozen=True)
class Effect:
    slope: float
    sd: float

    @property
    def ratio(self) -> float:
        return self.slope / self.sd


def with_ones(df: DataFrame, add_intercept: bool) -> DataFrame:
    return df.withColumn(INTERCEPT, F.lit(1.0)) if add_intercept else df


@dataclass
class RegressionResult:
    """Named coefficients and what tests and predictions need."""

    terms: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    n: int
    likelihood: LogLikelihood
    family: str = "linear"
    fit: dict[str, float] = field(default_factory=dict)
    test_df: float = math.nan

    def effect(self, term: str) -> Effect:
        i = self.terms.index(term)
        return Effect(float(self.coefficients[i]), float(math.sqrt(max(self.covariance[i, i], 0))))

    def test(self, term: str) -> TestResult:
        e = self.effect(term)
        return student_test(e.slope, e.sd, self.test_df) if self.family == "linear" else z_test(e.slope, e.sd)

    def rows(self) -> list[tuple]:
        out = []
        for t in self.terms:
            e, r = self.effect(t), self.test(t)
            out.append((t, e.slope, e.sd, r.statistic, r.p_value))
        return out

    def table(self, spark) -> DataFrame:
        """term, estimate, std_error, statistic, p_value"""
        return spark.createDataFrame(self.rows(), "term string, estimate double, std_error double, statistic double, p_value double")

    def lines(self, digits: int = 4) -> str:
        """The coefficients as text."""
        return "\n".join("  ".join([t.ljust(24), *(f"{x:.{digits}g}".rjust(12) for x in v)]) for t, *v in self.rows())

    def linear_predictor(self) -> Column:
        slopes = [t for t in self.terms if t != INTERCEPT]
        at = {t: float(b) for t, b in zip(self.terms, self.coefficients, strict=True)}
        return dot(slopes, [at[t] for t in slopes], at.get(INTERCEPT, 0.0))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df with the prediction, as one projection; columns that df lacks, and missing values, count as 0."""
        names = [t for t in self.terms if t != INTERCEPT]
        missing = [c for c in names if c not in df.columns]
        filled = df.withColumns({c: F.lit(0.0) for c in missing} | {f"__{c}": F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)) for c in names if c in df.columns})
        at = {t: float(b) for t, b in zip(self.terms, self.coefficients, strict=True)}
        eta = dot([c if c in missing else f"__{c}" for c in names], [at[c] for c in names], at.get(INTERCEPT, 0.0))
        return filled.withColumn(out, sigmoid(eta) if self.family == "logistic" else eta).drop(*missing, *[f"__{c}" for c in names])


def design(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    return reindex(df, columns, fill)


def linear_regression(df: DataFrame, label: str, features: list[str], ridge: float = 0.0, add_intercept: bool = True, weights: dict[str, float] | None = None, df_rule: str = "n-p") -> RegressionResult:
    """Least squares, or ridge with penalty weights 1/sd (0 for the intercept): two aggregations, whatever the number of rows.

    Rows with a null or NaN feature or label take no part. df_rule: 'n-p' for the t tests' degrees of freedom, or 'n-2'.
    """
    df = complete(df, [*features, label])
    means = df.agg(*[F.avg(c).alias(c) for c in [*features, label]], F.count("*").alias("n")).first()
    shift = {c: means[c] or 0.0 for c in [*features, label]} if add_intercept else {}
    m = moments(df.select(*features, label), [*features, label], shift=shift)
    n, p = m.n, len(features) + add_intercept
    xx, xy, yy = m.block(features, features), m.block(features, [label])[:, 0], float(m.block([label], [label])[0, 0])
    center = np.array([shift.get(c, 0.0) for c in features])
    if ridge and weights is None:
        var = np.diag(xx) / max(n - 1, 1) if add_intercept else (np.diag(xx) - _sum(df, features) ** 2 / n) / max(n - 1, 1)
        weights = {c: 1 / math.sqrt(v) if v > 0 else 0.0 for c, v in zip(features, var, strict=True)}
    w = np.array([(weights or {}).get(c, 1.0) for c in features]) * ridge
    inverse = np.linalg.pinv(xx + np.diag(w)) if len(features) else np.zeros((0, 0))
    slopes = inverse @ xy
    rss = float(yy - 2 * slopes @ xy + slopes @ xx @ slopes)
    base = yy if add_intercept else yy - float(means[label] or 0.0) ** 2 * n
    sandwich = inverse @ xx @ inverse
    if add_intercept:
        terms = [INTERCEPT, *features]
        coefficients = np.r_[shift[label] - center @ slopes, slopes]
        cov = np.zeros((p, p))
        cov[1:, 1:] = sandwich
        cov[0, 1:] = cov[1:, 0] = -center @ sandwich
        cov[0, 0] = 1 / n + center @ sandwich @ center
    else:
        terms, coefficients, cov = list(features), slopes, sandwich
    sigma2 = rss / (n - p) if n > p else math.nan
    leverage_sum = float(np.trace(inverse @ xx)) + add_intercept
    r2 = 1 - rss / base if base else math.nan
    loglik = -n / 2 * (math.log(2 * math.pi) + 1 - math.log(n) + math.log(rss)) if rss > 0 else math.inf
    fit = {"rss": rss, "sigma2": sigma2, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - (p - 1) - 1) if n > p else math.nan, "n": n, "df": n - p, "leverage_sum": leverage_sum}
    out = RegressionResult(terms, coefficients, sigma2 * cov, n, LogLikelihood(loglik, leverage_sum if ridge else p + 1, n), "linear", fit, n - p if df_rule == "n-p" else n - 2)
    out.unscaled = cov  # type: ignore[attr-defined]
    out.inverse, out.center, out.features, out.add_intercept = inverse, center, list(features), add_intercept  # type: ignore[attr-defined]
    return out


def _sum(df: DataFrame, features: list[str]) -> np.ndarray:
    row = df.agg(*[F.sum(c).alias(c) for c in features]).first()
    return np.array([row[c] or 0.0 for c in features])


def influence(result: RegressionResult, df: DataFrame, label: str, textbook: bool = False) -> DataFrame:
    """df with residual, leverage and studentized residual, as expressions.

    The studentized residual divides by sqrt((RSS - e^2) / (n - p - 1) * (1 - h)); textbook: by RSS - e^2 / (1 - h).
    """
    a, names = result.inverse, result.features  # type: ignore[attr-defined]
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(names, result.center, strict=True)]  # type: ignore[attr-defined]
    h = F.lit(1.0 / result.n if result.add_intercept else 0.0)  # type: ignore[attr-defined]
    for i in range(len(names)):
        h = h + x[i] * x[i] * F.lit(float(a[i, i]))
        for j in range(i):
            h = h + x[i] * x[j] * F.lit(float(2 * a[i, j]))
    rss, p = result.fit["rss"], len(result.terms)
    out = df.withColumn("residual", F.col(label) - result.linear_predictor()).withColumn("leverage", h)
    e, one = F.col("residual"), 1 - F.col("leverage")
    rest = F.lit(rss) - (e * e / one if textbook else e * e)
    return out.withColumn("studentized", F.try_divide(e, F.sqrt(F.greatest(rest / F.lit(float(result.n - p - 1)) * one, F.lit(0.0)))))


def outlier_p_values(studentized: DataFrame, df: float, out: str = "p_value") -> DataFrame:
    """Two-sided t tail of each studentized residual."""

    @F.pandas_udf("double")
    def tail(s):
        import pandas as pd

        return pd.Series(arrays.t_two_sided(s.to_numpy(float), df), index=s.index)

    return studentized.withColumn(out, F.when(F.col("studentized").isNotNull(), tail("studentized")))


def logistic_regression(df: DataFrame, label: str, features: list[str], add_intercept: bool = True, iterations: int = 100, eps: float = 1e-6) -> RegressionResult:
    """Maximum likelihood by Newton steps from 0; labels above 0 are 1. One aggregation a step; df is cached meanwhile.

    Rows with a null or NaN feature or label take no part.

    Standard errors come from the Fisher information X'WX at the optimum.
    """
    names = ([INTERCEPT] if add_intercept else []) + list(features)
    base = with_ones(complete(df, [*features, label]), add_intercept).select(*[F.col(c).cast("double").alias(c) for c in names], F.when(F.col(label) > 0, 1.0).otherwise(0.0).alias("__y")).cache()
    try:
        b = np.zeros(len(names))
        for _ in range(iterations):
            g, information, loglik, n = _newton_sums(base, names, b)
            if np.abs(g).sum() <= eps * max(1.0, 1e-6 * n):  # sums of very many rows are not exact
                break
            b = b + np.linalg.solve(information, g)
        g, information, loglik, n = _newton_sums(base, names, b)
    finally:
        base.unpersist()
    return RegressionResult(names, b, np.linalg.inv(information), n, LogLikelihood(loglik, len(names), n), "logistic")


def _newton_sums(base: DataFrame, names: list[str], b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    eta = dot(names, list(b))
    x = base.withColumn("__eta", eta).withColumn("__pi", sigmoid(F.col("__eta")))
    w = F.col("__pi") * (1 - F.col("__pi"))
    p = len(names)
    value = F.col("__y") * F.col("__eta") - (F.greatest(F.col("__eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("__eta"))))
    row = x.agg(
        F.count("*").alias("n"), F.sum(value).alias("l"), *[F.sum((F.col("__y") - F.col("__pi")) * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)],
        *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)],
    ).first()
    h = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
    return np.array([row[f"g{i}"] or 0.0 for i in range(p)]), h, row["l"] or 0.0, row["n"]


@dataclass
class BayesianResult:
    """Posterior of a normal-inverse-gamma regression with prior mean 0: a multivariate t."""

    terms: list[str]
    dof: float
    mean: np.ndarray
    shape: np.ndarray
    scale: float = math.nan  # b_N / a_N

    @property
    def variances(self) -> np.ndarray:
        return np.diag(self.shape) * self.dof / (self.dof - 2)

    def quantile(self, p: float) -> np.ndarray:
        return self.mean + np.sqrt(np.diag(self.shape)) * dist.t_quantile(p, self.dof)

    def predictive(self, df: DataFrame, scale: float | None = None, p: float | None = None) -> DataFrame:
        """df with predicted mean and variance (and quantile p), row by row; scale: of the noise, b_N / a_N by default. No n x n matrix is formed."""
        scale = self.scale if scale is None else scale
        x = [F.lit(1.0) if t == INTERCEPT else F.col(t) for t in self.terms]
        mean, spread = F.lit(0.0), F.lit(float(scale))
        for i in range(len(x)):
            mean = mean + x[i] * F.lit(float(self.mean[i]))
            for j in range(len(x)):
                spread = spread + x[i] * x[j] * F.lit(float(self.shape[i, j]))
        out = df.withColumn("predictive_mean", mean).withColumn("predictive_variance", spread * F.lit(self.dof / (self.dof - 2)))
        if p is not None:
            out = out.withColumn("predictive_quantile", F.col("predictive_mean") + F.sqrt(spread) * F.lit(dist.t_quantile(p, self.dof)))
        return out

    def predictive_covariance(self, df: DataFrame, key: str, scale: float | None = None, most: int = 5000) -> DataFrame:
        """(i, j, v): covariance of the predictions of rows i and j, the noise (scale, as in predictive()) included where i = j.

        A square of the rows by nature, so a table of more than ``most`` rows is refused.
        """
        n, scale = df.count(), self.scale if scale is None else scale
        if n > most:
            raise ValueError(f"{n} rows have {n * n} covariances; {most} rows are the most")
        x = F.array(*[F.lit(1.0) if t == INTERCEPT else F.col(t).cast("double") for t in self.terms])
        spread = self.dof / (self.dof - 2)
        shaped = [reduce(lambda a, b: a + b, [F.element_at("x", i + 1) * F.lit(float(self.shape[i, j])) for i in range(len(self.terms))]) for j in range(len(self.terms))]
        left = df.select(F.col(key).alias("i"), x.alias("x")).select("i", F.array(*shaped).alias("sx"))
        right = df.select(F.col(key).alias("j"), x.alias("y"))
        v = F.aggregate(F.zip_with("sx", "y", lambda a, b: a * b), F.lit(0.0), lambda t, u: t + u)
        return left.join(F.broadcast(right), F.lit(True)).select("i", "j", ((v + F.when(F.col("i") == F.col("j"), F.lit(float(scale))).otherwise(0.0)) * spread).alias("v"))


def bayesian_regression(df: DataFrame, label: str, features: list[str], ridge: float, weights: dict[str, float] | None = None, add_intercept: bool = True) -> BayesianResult:
    terms = ([INTERCEPT] if add_intercept else []) + list(features)
    m = moments(with_ones(df, add_intercept).select(*terms, label), [*terms, label])
    a = m.block(terms, terms) + ridge * np.diag([(weights or {}).get(t, 1.0) for t in terms])
    mean = np.linalg.solve(a, m.block(terms, [label])[:, 0])
    b = (float(m.block([label], [label])[0, 0]) - mean @ a @ mean) / 2
    return BayesianResult(terms, float(m.n), mean, np.linalg.inv(a) * (b / (m.n / 2)), b / (m.n / 2))


def log_marginal_likelihood(df: DataFrame, label: str, features: list[str], ridge: float, sigma2: float, weights: dict[str, float] | None = None, add_intercept: bool = True) -> float:
    """-1/2 log det K - 1/2 y' K^-1 y with K = X diag(1 / (ridge w)) X' + sigma2 I, by the p x p Gram matrix only."""
    terms = ([INTERCEPT] if add_intercept else []) + list(features)
    m = moments(with_ones(df, add_intercept).select(*terms, label), [*terms, label])
    prior = ridge * np.array([(weights or {}).get(t, 1.0) for t in terms])
    g, xy, yy = m.block(terms, terms), m.block(terms, [label])[:, 0], float(m.block([label], [label])[0, 0])
    inner = np.diag(prior) + g / sigma2
    log_det = m.n * math.log(sigma2) + np.linalg.slogdet(inner)[1] - np.log(prior).sum()
    quad = yy / sigma2 - xy @ np.linalg.solve(inner, xy) / sigma2**2
    return float(-0.5 * log_det - 0.5 * quad)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of the rows where both are present; NaN counts as missing."""
    a, b = nan_to_null(a.cast("double")), nan_to_null(b.cast("double"))
    return F.corr(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))
