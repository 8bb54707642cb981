"""Splits, folds, candidates and nested cross-validation. Splits depend on row keys only, not on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import complete, numbered
from .fit import FitResult, bagged, close, iterate
from .moments import Moments, added, moments_by
from .objectives import BoundLinear, Data, Linear
from .penalties import NoPenalty
from .updaters import CoordinateDescent, relative_stop


def position(df: DataFrame, key: str, seed: int = 42, out: str = "position", strata: str | None = None, order: Column | None = None) -> DataFrame:
    """0-based place of each row in a shuffled order (or in order, a number), for each stratum if given.

    Without strata the place is computed range by range of the hash, so the window never spans the table.
    """
    h = F.xxhash64(key, F.lit(seed)) if order is None else order
    if strata:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(strata).orderBy(h, key)) - 1).cast("long"))
    if order is not None:
        return numbered(df.withColumn("__o", order), "__o", key, out).withColumn(out, F.col(out) - 1).drop("__o")
    at = df.withColumn("__h", h).withColumn("__r", F.shiftright("__h", 54).cast("int"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("__r").agg(F.count("*").alias("__n")).select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    place = F.row_number().over(Window.partitionBy("__r").orderBy("__h", key)) - 1 + F.col("__s")
    return at.join(F.broadcast(starts), "__r").withColumn(out, place.cast("long")).drop("__h", "__r", "__s")


def share(n: int, ratio: float) -> int:
    """floor(n * ratio) of the decimal number that ratio is written as: 0.7 of 90,000 is 63,000, though the product of doubles is less."""
    return int(n * Fraction(str(ratio)))


def split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with is_train: exactly floor(n * ratio) rows are."""
    n = df.count()
    return position(df, key, seed).withColumn("is_train", F.col("position") < share(n, ratio)).drop("position")


def split_by(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """is_train: rows whose key is among keys."""
    marked = keys.select(key).distinct().withColumn("__in", F.lit(True))
    return df.join(marked, key, "left").withColumn("is_train", F.coalesce("__in", F.lit(False))).drop("__in")


def k_fold(df: DataFrame, key: str, k: int, seed: int = 42, place: Column | None = None) -> DataFrame:
    """df with fold: groups of floor(n / k) + 1 rows, so small tables can have fewer than k folds. place: a given 0-based order."""
    n = df.count()
    at = position(df, key, seed) if place is None else df.withColumn("position", place)
    return at.withColumn("fold", F.floor(F.col("position") / (n // k + 1)).cast("int")).drop("position")


def k_fold_stratified(df: DataFrame, key: str, k: int, strata: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Folds with each stratum spread evenly."""
    return position(df, key, seed, strata=strata, order=order).withColumn("fold", F.pmod("position", F.lit(k)).cast("int")).drop("position")


def folds(df: DataFrame, k: int, replicas: int, make: Callable[[int], DataFrame]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(training rows, held-out rows) of each fold of each replica; a replica is cached while its folds are read, so read them as they come."""
    for r in range(replicas):
        df = make(r).cache()
        try:
            for f in sorted(x["fold"] for x in df.select("fold").distinct().collect()):  # k at most
                yield df.where(F.col("fold") != f).drop("fold"), df.where(F.col("fold") == f).drop("fold")
        finally:
            df.unpersist()


def bootstrap(df: DataFrame, key: str, seed: int, exact: bool = True) -> DataFrame:
    """A resample with replacement: as many draws as rows, from a hash of the draw's number and the seed.

    Draws are summed to counts by place in the shuffled order, then joined, so no row moves more than once and a row drawn often is repeated where it is.
    exact=False: each row a Poisson(1) number of times, without a shuffle; the size then varies by about the root of the rows.
    """
    if exact:
        n = df.count()
        if not n:
            return df
        draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("__p")).groupBy("__p").agg(F.count("*").cast("int").alias("__t"))
        times = position(df, key, seed, "__p").join(draws, "__p").drop("__p")
    else:
        u = (F.xxhash64(key, F.lit(seed)).cast("double") / F.lit(2.0**64)) + 0.5
        count, total, term = F.lit(0), 0.0, float(np.exp(-1))
        for n in range(1, 12):
            total += term
            count = F.when(u >= total, n).otherwise(count)
            term /= n
        times = df.withColumn("__t", count).where("__t > 0")
    return times.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__t", "__i")


def grid(low: float, high: float, n: int) -> list[float]:
    """exp of evenly spaced values."""
    return list(np.exp(np.linspace(low, high, n)))


def random_candidates(low: float, high: float, n: int, seed: int = 42) -> list[float]:
    return list(np.exp(np.random.default_rng(seed).random(n) * (high - low) + low))


def random_pairs(first: tuple[float, float], second: tuple[float, float], n: int, seed: int = 42) -> list[tuple[float, float]]:
    return list(zip(random_candidates(*first, n, seed), random_candidates(*second, n, seed + 1), strict=True))


@dataclass(frozen=True)
class Presets:
    """Lists of (penalty, kernel) candidates; the kernel strength is exp(0) unless it is searched too."""

    @staticmethod
    def grid_1d(low: float, high: float, n: int) -> list[tuple[float, float]]:
        return [(v, 1.0) for v in grid(low, high, n)]

    @staticmethod
    def random_2d(first: tuple[float, float], second: tuple[float, float], n: int, seed: int = 42) -> list[tuple[tuple[float, float], float]]:
        """Pairs of penalty strengths, as elastic net takes them."""
        return [(v, 1.0) for v in random_pairs(first, second, n, seed)]


def zipped(*generators: Iterable) -> list[tuple]:
    """Candidates side by side, not their product."""
    return list(zip(*generators, strict=False))


@dataclass
class Scored:
    candidate: object
    score: float


def held_out_score(result: FitResult, df: DataFrame, label: str) -> float:
    """The unpenalised objective for each held-out row."""
    from .fit import _inputs

    rows = _inputs(result.map(result._prepared(df)), result.features).withColumn("__label", F.col(label).cast("double"))
    bound = result.objective.on(Data(rows, result.features, "__label", np.zeros(len(result.features))))
    try:
        return bound.value(result.coefficients) / max(bound.n, 1)
    finally:
        close(bound)


def search(splits: Iterable[tuple[DataFrame, DataFrame]], label: str, candidates: list, train: Callable[[DataFrame, object, np.ndarray | None], FitResult], start: np.ndarray | None = None) -> list[Scored]:
    """Mean held-out score of each candidate, in their order.

    Splits are read one after the other, with all candidates on each. A candidate's fit on the first split begins at start; its
    other fits begin at its coefficients from the first.
    """
    if not candidates:
        raise ValueError("a search needs at least one split and one candidate")
    scores: list[list[float]] = [[] for _ in candidates]
    first: list[np.ndarray | None] = [None for _ in candidates]
    for inside, outside in splits:
        for i, c in enumerate(candidates):
            r = train(inside, c, start if first[i] is None else first[i])
            first[i] = r.coefficients if first[i] is None else first[i]
            scores[i].append(held_out_score(r, outside, label))
    if not scores[0]:
        raise ValueError("a search needs at least one split and one candidate")
    return [Scored(c, float(np.mean(s))) for c, s in zip(candidates, scores, strict=True)]


def best_of(scored: list[Scored]) -> object:
    """The candidate with the largest score, the first of equal ones; scores that are not finite lose."""
    return max(scored, key=lambda s: s.score if np.isfinite(s.score) else -np.inf).candidate


def fit_with_cv(df: DataFrame, label: str, key: str, train: Callable[[DataFrame, object, np.ndarray | None], FitResult], candidates: list, inner: int = 5, holdout: float = 0.1, bags: int = 0, seed: int = 42, warm: bool = False) -> tuple[dict, FitResult, list[Scored]]:
    """Outer split, inner search on its training rows, refit (bagged if asked), evaluation on the rows held out.

    Scales found by ``train`` come from its rows only. warm: the first split's fits begin at those of the first candidate on all training rows.
    """
    cut = split(df, key, 1 - holdout, seed).cache()
    inside, outside = cut.where("is_train").drop("is_train"), cut.where("not is_train").drop("is_train")
    start = train(inside, candidates[0], None).coefficients if warm and candidates else None
    scored = search(folds(inside, inner, 1, lambda r: k_fold(inside, key, inner, seed + r)), label, candidates, train, start)
    best = best_of(scored)
    result = train(inside, best, None) if not bags else bagged([train(bootstrap(inside, key, seed + b), best, None) for b in range(bags)])
    evaluation = {"objective": held_out_score(result, outside, label), **result.evaluate(outside, label)}
    cut.unpersist()
    return evaluation, result, scored


@dataclass
class LinearCv:
    """features: with the intercept first; coefficients: of the refit; evaluation: objective per row and R2 of the rows held out."""

    features: list[str]
    coefficients: np.ndarray
    best: object
    scored: list[Scored]
    evaluation: dict


def linear_with_cv(df: DataFrame, label: str, key: str, features: list[str], penalty: Callable[[object], NoPenalty], candidates: list, updater: Callable[[], object] = CoordinateDescent, inner: int = 5, holdout: float = 0.1, seed: int = 42, place: Column | None = None, stop: Callable | None = None) -> LinearCv:
    """fit_with_cv() of linear objectives without a Spark job for each fit: one aggregation gives the moments of every fold.

    Training moments are those of all folds less the one held out; scales, fits, held-out scores and the evaluation follow from moments alone.
    place: a given 0-based order of the rows, for the outer split and the folds; by default both are drawn from the key. Rows with a
    null or NaN feature or label take no part.
    """
    rows = complete(df, [*features, label])
    n = rows.count()
    n_train = share(n, 1 - Fraction(str(holdout)))
    size = n_train // inner + 1
    at = position(rows, key, seed, "__place") if place is None else rows.withColumn("__place", place)
    again = F.col("__place")
    fold = F.when(again >= n_train, -1).otherwise(F.floor(again / size)).cast("int")
    columns = [*features, label]
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    shift = {c: means[c] or 0.0 for c in columns}
    by = moments_by(at.withColumn("__fold", fold).withColumn("__one", F.lit(1.0)), "__fold", ["__one", *columns], shift | {"__one": 0.0})
    centre = np.array([shift[c] for c in features])
    inside = {f: m for f, m in by.items() if f >= 0}

    def fitted(m: Moments, c) -> np.ndarray:
        """Coefficients around the shift, the intercept first."""
        x = m.cross
        var = (np.diag(x)[1:-1] - x[0, 1:-1] ** 2 / m.n) / max(m.n - 1, 1)
        f = np.r_[1.0, np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 1.0)]
        scale = np.r_[f, 1.0]
        bound = BoundLinear(None, x * np.outer(scale, scale), m.n, np.r_[0.0, np.ones(len(features))])
        mean, _ = iterate(iter(lambda: bound, None), None, len(f), updater(), penalty(c), stop or relative_stop(1e-6), 2, 100_000, 50)
        return mean * f

    def score(m: Moments, b: np.ndarray) -> float:
        v = np.r_[-b, 1.0]
        return -float(v @ m.cross @ v) / max(m.n, 1)

    whole = added(list(inside.values()))
    scored = [Scored(c, float(np.mean([score(m, fitted(added([o for g, o in inside.items() if g != f]), c)) for f, m in sorted(inside.items())]))) for c in candidates]
    best = best_of(scored)
    b = fitted(whole, best)
    out = by.get(-1)
    evaluation = {"objective": float("nan"), "r2": float("nan")}
    if out is not None:
        total = out.cross[-1, -1] - out.cross[0, -1] ** 2 / out.n
        evaluation = {"objective": score(out, b), "r2": 1 + score(out, b) * out.n / total if total else float("nan")}
    return LinearCv(["intercept", *features], np.r_[b[0] + shift[label] - centre @ b[1:], b[1:]], best, scored, evaluation)


def r2(kind: Linear, df: DataFrame, label: str, prediction: str = "prediction") -> float:
    return kind.evaluate(df, label, prediction)["r2"]
