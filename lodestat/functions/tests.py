"""Hypothesis tests and information criteria on fitted values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from . import dist


@dataclass(frozen=True)
class TestResult:
    statistic: float
    p_value: float
    df: float = math.nan

    __test__ = False


@dataclass(frozen=True)
class LogLikelihood:
    value: float
    df: float
    n: int


def z_test(estimate: float, sd: float) -> TestResult:
    """Two-sided."""
    z = estimate / sd
    return TestResult(z, 2 * dist.normal_upper(abs(z)))


def student_test(estimate: float, sd: float, df: float, location: float = 0.0) -> TestResult:
    """Two-sided; a degenerate standard deviation or no degrees of freedom give NaN instead of an error."""
    if not df > 0 or math.isnan(estimate) or math.isnan(sd) or not 0 < sd <= 1e7:
        return TestResult(math.nan, math.nan, df)
    t = (estimate - location) / sd
    return TestResult(t, dist.t_two_sided(t, df), df)


def likelihood_ratio_test(null: LogLikelihood, alternative: LogLikelihood, df: float | None = None, scale: float = 1.0) -> TestResult:
    df = alternative.df - null.df if df is None else df
    if df < 1:
        if abs(df - 1) > 1e-6:
            raise ValueError("the alternative needs at least one more degree of freedom")
        df = 1.0
    statistic = 2 * (alternative.value - null.value) / scale
    return TestResult(statistic, dist.chi2_upper(statistic, df), df)


def bic(likelihood: LogLikelihood) -> float:
    return -2 * likelihood.value + likelihood.df * math.log(likelihood.n)
