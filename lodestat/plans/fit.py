"""The iterative fit: normalise, map features, iterate, stop, average, and return coefficients in original units."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import complete, drawn, nan_to_null
from ..operators.kernels import FeatureMap, Identity, feature_map
from .objectives import Data, Linear, Logistic, Multinomial, VectorData, objective, objective_spec
from .penalties import L2, NoPenalty
from .regression import INTERCEPT
from .rows import Block, Vectors
from .updaters import CoordinateDescent, State, Step, Updater, relative_stop


def batch_ids(df: DataFrame, key: str, batches: int, seed: int, epoch: int, out: str = "batch") -> DataFrame:
    """Disjoint, complete, equally large batches in an order that depends on the key, seed and epoch only.

    Each row's batch is its rank by hash, modulo batches: ranks come from hash ranges that are counted once and offset, so
    no window spans the table.
    """
    at = df.withColumn("__h", drawn(key, seed, epoch)).withColumn("__r", F.substring("__h", 1, 3))
    sizes = at.groupBy("__r").agg(F.count("*").alias("__n"))  # 4096 rows at most
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__r").orderBy("__h", key))
    return at.join(F.broadcast(sizes), "__r").withColumn(out, F.pmod(F.col("__start") + within - 1, F.lit(batches)).cast("int")).drop("__h", "__r", "__start")


@dataclass
class FitResult:
    """Coefficients by name, in original units, with the map and objective that they belong to."""

    objective: Linear
    features: list[str]
    names: list[str]
    coefficients: np.ndarray
    map: FeatureMap = field(default_factory=Identity)
    inputs: list[str] = field(default_factory=list)
    train: float = float("nan")
    validation: float | None = None
    iterations: int = 0
    normalized: np.ndarray | None = None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df with predictions; input columns that are missing or null count as 0."""
        return self.objective.predict(_inputs(self.map(self._prepared(df)), self.features), self.features, self.coefficients, out).drop(*[c for c in self.features if c not in df.columns])

    def _prepared(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.withColumns({c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)) if c in have else F.lit(0.0) for c in self.inputs})

    def evaluate(self, df: DataFrame, label: str) -> dict:
        return self.objective.evaluate(self.predict(df), label)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, float(b)) for n, b in zip(self.names, self.coefficients, strict=True)], "term string, estimate double")

    def to_json(self) -> str:
        return json.dumps({"objective": objective_spec(self.objective), "features": self.features, "names": self.names, "coefficients": list(map(float, self.coefficients)), "map": self.map.spec(), "inputs": self.inputs})

    @classmethod
    def from_json(cls, text: str) -> FitResult:
        d = json.loads(text)
        return cls(objective(d["objective"]), d["features"], d["names"], np.array(d["coefficients"]), feature_map(d["map"]), d["inputs"])


def _inputs(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(1.0) for c in features if c == INTERCEPT and c not in df.columns})


def deviation_factors(df: DataFrame, columns: list[str]) -> np.ndarray:
    """1 / sample standard deviation, and 1 for constant columns."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return np.array([1 / row[c] if row[c] and np.isfinite(row[c]) else 1.0 for c in columns])


def close(bound) -> None:
    if hasattr(bound, "close"):
        bound.close()


def iterate(batches: Iterator, held, width: int, updater: Updater, penalty: NoPenalty, stop: Callable[[Step], bool], skip: int, most: int, tail: int, start: np.ndarray | None = None) -> tuple[np.ndarray, Step]:
    """(mean of the chosen iterates, the last step) of steps on batches, each an objective bound to data.

    The first ``skip`` steps don't count. From the step on at which the stop rule holds, ``tail`` iterates are averaged; at a fixed point the
    rest of them are that point. If ``most`` steps don't suffice, the last ``tail`` are averaged. With held-out rows, the iterates with the
    largest held-out objective are averaged instead. A step that is not finite ends the fit. Objectives count per row.
    """
    state = State(np.zeros(width) if start is None else np.asarray(start, float))
    last, before, after, best, count = None, [], [], [], 0
    for part in batches:
        state = updater.next(state, part, penalty)
        value = (part.value(state.point) - penalty.value(state.point, part.mask)) / max(part.n, 1)
        if not np.isfinite(value) or not np.isfinite(state.point).all():
            break
        count += 1
        now = Step(state.point.copy(), value, held.value(state.point) / max(held.n, 1) if held else None, count).after(last)
        fixed = last is not None and np.abs(now.point - last.point).max(initial=0) <= 1e-13 * max(1.0, np.abs(now.point).max(initial=0)) and getattr(part, "whole", True)
        last = now
        if count <= skip:
            continue
        if held:
            best = sorted([*best, now], key=lambda s: -s.validation)[:tail]
        if after or stop(now):
            after.append(now)
            if fixed:
                after += [now] * (tail - len(after))
        else:
            before = [*before, now][-tail:]
        if len(after) >= tail or count - skip >= most:
            break
    chosen = best if held else (before[-(tail - len(after)) :] if tail > len(after) else []) + after
    if not chosen:
        raise ArithmeticError("the fit has no finite step")
    return np.mean([s.point for s in chosen], axis=0), last


def mini_batches(rows: DataFrame, key: str, size: int, n: int, seed: int, bind: Callable[[DataFrame], object]) -> Iterator:
    """Objectives on the batches of one epoch after the other. An epoch is cached sorted by batch, so a step reads the blocks of its batch, not the table."""
    parts, epoch = n // size + 1, 0
    while True:
        cut = batch_ids(rows, key, parts, seed, epoch).repartitionByRange("batch").sortWithinPartitions("batch").cache()
        try:
            for k in range(parts):
                bound = bind(cut.where(F.col("batch") == k))
                bound.whole = False
                try:
                    if bound.n:
                        yield bound
                finally:
                    close(bound)
        finally:
            cut.unpersist()
        epoch += 1


def optimize(
    df: DataFrame, label: str, features: list[str], kind: Linear | None = None, penalty: NoPenalty | None = None, updater: Updater | None = None, stop: Callable[[Step], bool] | None = None,
    add_intercept: bool = True, normalize: bool = True, max_iterations: int = 100_000, min_epochs: float = 1.0, tail: int = 50, seed: int = 42, batch_size: int | None = None, key: str | None = None,
    validation: Column | None = None, start: np.ndarray | None = None, map: FeatureMap | None = None, mask: dict[str, float] | None = None,
) -> FitResult:
    """Fits kind (linear by default) under penalty (no L2 strength by default).

    The intercept alone is free of the penalty unless mask gives weights. Which iterates are averaged says iterate(); min_epochs worth of steps and one
    more are dropped. batch_size with a row key gives mini-batches, whose own objective the stop rule sees. Rows with a null or NaN feature or label take no
    part.
    """
    kind, penalty, updater = kind or Linear(), penalty or L2(0.0), updater or CoordinateDescent()
    stop, map = stop or relative_stop(1e-6), map or Identity()
    mapped = map(df)
    names = ([INTERCEPT] if add_intercept and INTERCEPT not in map.columns(features) else []) + map.columns(features)
    wide = complete(_inputs(mapped, names), [*names, label])
    factors = deviation_factors(wide, names) if normalize else np.ones(len(names))
    weights = np.array([(mask or {}).get(c, 0.0 if c == INTERCEPT and not map.penalize_all else 1.0) for c in names])
    scaled = wide.select(*[(F.col(c).cast("double") * F.lit(float(f))).alias(c) for c, f in zip(names, factors, strict=True)], F.col(label).cast("double").alias("__label"), *([F.col(key).alias("__key")] if key else []), (validation if validation is not None else F.lit(False)).alias("__val"))
    rows = scaled.where(~F.col("__val"))
    held = kind.on(Data(scaled.where("__val"), names, "__label", weights)) if validation is not None else None
    width = kind.width(len(names))
    repeat = np.repeat(factors, width // len(names))
    got = _fitted(rows, lambda d: kind.on(Data(d, names, "__label", weights)), held, width, penalty, updater, stop, max_iterations, min_epochs, tail, seed, batch_size, None if start is None else np.asarray(start, float) / repeat)
    mean, last = got
    return FitResult(kind, names, kind.names(names), mean * repeat, map, list(features), last.train, last.validation, last.iteration, mean)


def _fitted(rows: DataFrame, bind, held, width: int, penalty, updater, stop, max_iterations: int, min_epochs: float, tail: int, seed: int, batch_size: int | None, start) -> tuple[np.ndarray, Step]:
    if batch_size:
        n = rows.count()
        batches, per_epoch = mini_batches(rows, "__key", batch_size, n, seed, bind), n // batch_size + 1
    else:
        whole, per_epoch = bind(rows), 1
        batches = iter(lambda: whole, None)
    try:
        return iterate(batches, held, width, updater, penalty, stop, int(min_epochs * per_epoch) + 1, max_iterations, tail, start)
    finally:
        if batch_size:
            batches.close()
        else:
            close(whole)
        close(held)


@dataclass
class VectorFit:
    """Coefficients (p x logits, row by row, the constant first if there is one) of a fit on feature vectors, in original units."""

    objective: Linear
    at: Vectors
    coefficients: np.ndarray
    train: float = float("nan")
    validation: float | None = None
    iterations: int = 0

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df with predictions (probabilities of class 1 for logistic; the class and out_k for multinomial); null where a vector has missing entries."""
        at, many = self.at, isinstance(self.objective, Multinomial)
        logits = self.objective.classes - 1 if many else 1
        b, kind = self.coefficients.reshape(at.size, logits), self.objective.name
        names = [out] + ([f"{out}_{c}" for c in range(logits + 1)] if many else [])
        own = [c for c in df.columns if c not in names]
        tidy = df.select(*[F.col(f"`{c}`") for c in own], *at.columns())
        ok = F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull() | F.isnan(x)) & (F.col("__i").isNotNull() & (F.size("__i") == F.size("__v")) if at.sparse else F.size("__v") == at.width)
        blank = F.array().cast("array<double>") if at.sparse else F.array_repeat(F.lit(0.0), at.width)
        tidy = tidy.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("__v", F.when(F.col("__ok"), F.col("__v")).otherwise(blank))
        if at.sparse:
            tidy = tidy.withColumn("__i", F.when(F.col("__ok"), F.col("__i")).otherwise(F.array().cast("array<int>")))

        def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                eta = Block(batch, at).dot(b)
                gone = ~batch.column(batch.schema.get_field_index("__ok")).to_numpy(zero_copy_only=False)
                if many:
                    top = np.maximum(eta.max(1), 0)
                    w = np.c_[np.exp(-top), np.exp(eta - top[:, None])]
                    p = w / w.sum(1, keepdims=True)
                    cols = [(p.shape[1] - 1 - p[:, ::-1].argmax(1)).astype(np.int32), *p.T]
                else:
                    e = eta[:, 0]
                    cols = [e if kind == "linear" else np.where(e >= 0, 1, np.exp(-np.abs(e))) / (1 + np.exp(-np.abs(e)))]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in own] + [pa.array(c, mask=gone) for c in cols], own + names)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in own)
        return tidy.mapInArrow(of, f"{kinds}, `{out}` {'int' if many else 'double'}" + "".join(f", `{n}` double" for n in names[1:]))

    def evaluate(self, df: DataFrame, label: str) -> dict:
        return self.objective.evaluate(self.predict(df).where("prediction is not null"), label)

    def to_json(self) -> str:
        return json.dumps({"objective": objective_spec(self.objective), "vectors": asdict(self.at), "coefficients": [float(v) for v in self.coefficients]})

    @classmethod
    def from_json(cls, text: str) -> VectorFit:
        d = json.loads(text)
        return cls(objective(d["objective"]), Vectors(**d["vectors"]), np.array(d["coefficients"]))


def vector_factors(df: DataFrame, at: Vectors) -> np.ndarray:
    """1 / sample standard deviation of each coordinate, 1 for constant ones; all 1 for sparse rows, which are not scaled."""
    if at.sparse:
        return np.ones(at.size)
    from .rows import folded

    rows = at.complete(df.select(*at.columns()))
    none = Vectors(at.width, at.dense, intercept=False)
    first = folded(rows, at.width + 1, lambda b: np.r_[len(b), Block(b, none).x.sum(0)])
    n, mean = first[0], first[1:] / max(first[0], 1)
    square = folded(rows, at.width, lambda b: ((Block(b, none).x - mean) ** 2).sum(0))
    sd = np.sqrt(square / max(n - 1, 1))
    return np.r_[np.ones(int(at.intercept)), np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 1.0)]


def optimize_vectors(
    df: DataFrame, label: str, at: Vectors, kind: Linear | Logistic | Multinomial | None = None, penalty: NoPenalty | None = None, updater: Updater | None = None, stop: Callable[[Step], bool] | None = None,
    normalize: bool = True, max_iterations: int = 100_000, min_epochs: float = 1.0, tail: int = 50, seed: int = 42, batch_size: int | None = None, key: str | None = None,
    validation: Column | None = None, start: np.ndarray | None = None,
) -> VectorFit:
    """optimize() on feature vectors, dense or sparse, of any width. Sparse rows are not scaled. The constant alone is free of the penalty."""
    kind, penalty, updater, stop = kind or Linear(), penalty or L2(0.0), updater or CoordinateDescent(), stop or relative_stop(1e-6)
    scaled = df.withColumn("__label", F.col(label).cast("double")).withColumn("__val", validation if validation is not None else F.lit(False))
    if key:
        scaled = scaled.withColumn("__key", F.col(key))
    factors = vector_factors(df, at) if normalize else np.ones(at.size)
    mask = np.r_[np.zeros(int(at.intercept)), np.ones(at.width)]
    logits = kind.classes - 1 if isinstance(kind, Multinomial) else 1
    bind = lambda d: kind.on(VectorData(d, at, "__label", mask, factors))
    held = bind(scaled.where("__val")) if validation is not None else None
    repeat = np.repeat(factors, logits)
    mean, last = _fitted(scaled.where("not __val"), bind, held, at.size * logits, penalty, updater, stop, max_iterations, min_epochs, tail, seed, batch_size, None if start is None else np.asarray(start, float) / repeat)
    return VectorFit(kind, at, mean * repeat, last.train, last.validation, last.iteration)


def bagged(results: list[FitResult]) -> FitResult:
    """The mean of the coefficients."""
    first = results[0]
    return FitResult(first.objective, first.features, first.names, np.mean([r.coefficients for r in results], axis=0), first.map, first.inputs)
