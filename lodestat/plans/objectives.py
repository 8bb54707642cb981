"""Objectives of the iterative fits. All are maximised; gradients point uphill.

An objective is bound to data once (``on``). The linear one then needs no further Spark job: it lives on the Gram matrix. The others run one job for
each evaluation, over a cached DataFrame: logistic fits of few columns as built-in aggregates with the parameters as literals, all others as numpy
folds over feature vectors (``rows``), whose plans don't grow with the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import dot, sigmoid
from .moments import moments
from .rows import BoundRows, Vectors, of_columns

#: Logistic fits of more columns are folded as vectors.
FEW = 8
#: Linear fits of wider vectors work on rows instead of the Gram matrix.
WIDEST_GRAM = 1024


@dataclass
class Data:
    """Rows with double feature columns and a label; mask: penalty weight of each feature."""

    df: DataFrame
    features: list[str]
    label: str
    mask: np.ndarray

    def where(self, condition: Column) -> Data:
        return Data(self.df.where(condition), self.features, self.label, self.mask)

    def rows(self, family: str, logits: int = 1) -> BoundRows:
        """Bound as vectors."""
        at = Vectors(len(self.features), "__x", intercept=False)
        return BoundRows(of_columns(self.df, self.features, "__x"), self.label, at, self.mask, logits, family)


@dataclass
class VectorData:
    """Rows with a feature vector and a label; factors: of each coordinate (the constant included)."""

    df: DataFrame
    at: Vectors
    label: str
    mask: np.ndarray
    factors: np.ndarray | None = None

    def rows(self, family: str, logits: int = 1) -> BoundRows:
        return BoundRows(self.df, self.label, self.at, self.mask, logits, family, self.factors)


class Linear:
    name, classes = "linear", 1

    def on(self, data: Data | VectorData) -> BoundLinear | BoundRows:
        if isinstance(data, VectorData) and data.at.size > WIDEST_GRAM:
            return data.rows("linear")
        return BoundLinear(data)

    def width(self, p: int) -> int:
        return p

    def names(self, features: list[str]) -> list[str]:
        return list(features)

    def predict(self, df: DataFrame, features: list[str], b: np.ndarray, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, dot(features, list(b)))

    def evaluate(self, df: DataFrame, label: str, prediction: str = "prediction") -> dict[str, float]:
        return r_squared(df, label, prediction)

    def generate(self, df: DataFrame, features: list[str], b: np.ndarray, out: str, seed: int = 42) -> DataFrame:
        return df.withColumn(out, dot(features, list(b)))


class BoundLinear:
    """Value -RSS, gradient X'(y - Xb), Hessian -X'X: on cross products of the data, or on given ones (the label last)."""

    def __init__(self, data: Data | VectorData | None, cross: np.ndarray | None = None, n: int = 0, mask: np.ndarray | None = None):
        if isinstance(data, VectorData):
            n, cross = gram(data)
        elif data is not None:
            m = moments(data.df.select(*data.features, data.label), [*data.features, data.label])
            n, cross = m.n, m.cross
        self.n, self.xx, self.xy, self.yy = n, cross[:-1, :-1], cross[:-1, -1], float(cross[-1, -1])
        self.mask = data.mask if data is not None else mask
        self.curvature = float(np.linalg.eigvalsh(self.xx)[-1]) if len(self.xx) else 0.0

    def value(self, b: np.ndarray) -> float:
        return -float(self.yy - 2 * b @ self.xy + b @ self.xx @ b)

    def smooth(self, b: np.ndarray) -> float:
        """The function of which gradient() is the gradient: half of value()."""
        return self.value(b) / 2

    def gradient(self, b: np.ndarray) -> np.ndarray:
        return self.xy - self.xx @ b

    def hessian(self, b: np.ndarray) -> np.ndarray:
        return -self.xx

    def gradient_1d(self, b: np.ndarray, i: int) -> float:
        return float(self.xy[i] - self.xx[i] @ b)

    def hessian_1d(self, b: np.ndarray, i: int) -> float:
        return -float(self.xx[i, i])


class Logistic(Linear):
    name, classes = "logistic", 1

    def on(self, data: Data | VectorData) -> BoundLogistic | BoundRows:
        if isinstance(data, VectorData) or len(data.features) > FEW:
            return data.rows("logistic")
        return BoundLogistic(data)

    def predict(self, df, features, b, out="prediction"):
        return df.withColumn(out, sigmoid(dot(features, list(b))))

    def evaluate(self, df, label, prediction="prediction"):
        return binary_metrics(df, label, prediction)

    def generate(self, df, features, b, out, seed=42):
        return df.withColumn(out, F.when(F.rand(seed) < sigmoid(dot(features, list(b))), 1.0).otherwise(0.0))


class BoundLogistic:
    """Value sum(y * eta - log(1 + exp(eta))), gradient X'(y - pi), Hessian -X'WX."""

    def __init__(self, data: Data):
        self.features, self.mask = data.features, data.mask
        self.df = data.df.select(*data.features, F.col(data.label).cast("double").alias("__y")).cache()
        m = moments(self.df, data.features)
        self.n, self.curvature = m.n, float(np.linalg.eigvalsh(m.cross)[-1]) / 4
        self._at: tuple[bytes, tuple] | None = None

    def close(self) -> None:
        self.df.unpersist()

    def _sums(self, b: np.ndarray, second: bool):
        key = b.tobytes() + bytes([second])
        if self._at and self._at[0] == key:
            return self._at[1]
        p = len(self.features)
        x = self.df.withColumn("__eta", dot(self.features, list(b))).withColumn("__pi", sigmoid(F.col("__eta")))
        w, eta = F.col("__pi") * (1 - F.col("__pi")), F.col("__eta")
        pairs = [(i, j) for i in range(p) for j in range(i, p)] if second else []
        row = x.agg(
            F.sum(F.col("__y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))).alias("l"),
            *[F.sum((F.col("__y") - F.col("__pi")) * F.col(c)).alias(f"g{i}") for i, c in enumerate(self.features)],
            *[F.sum(w * F.col(self.features[i]) * F.col(self.features[j])).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        h = np.zeros((p, p))
        for i, j in pairs:
            h[i, j] = h[j, i] = -(row[f"h{i}_{j}"] or 0.0)
        self._at = key, (row["l"] or 0.0, np.array([row[f"g{i}"] or 0.0 for i in range(p)]), h)
        return self._at[1]

    def value(self, b):
        return self._sums(b, False)[0]

    smooth = value

    def gradient(self, b):
        return self._sums(b, False)[1]

    def hessian(self, b):
        return self._sums(b, True)[2]

    def gradient_1d(self, b, i):
        return float(self._sums(b, True)[1][i])

    def hessian_1d(self, b, i):
        return float(self._sums(b, True)[2][i, i])


@dataclass
class Multinomial:
    """Classes 0..k-1 with class 0 as baseline; parameters are p x (k-1), row by row, named feature_class."""

    classes: int

    @property
    def name(self) -> str:
        return "multinomial"

    def on(self, data: Data | VectorData) -> BoundRows:
        return data.rows("multinomial", self.classes - 1)

    def width(self, p: int) -> int:
        return p * (self.classes - 1)

    def names(self, features: list[str]) -> list[str]:
        return [f"{f}_{c}" for f in features for c in range(1, self.classes)]

    def probabilities(self, features: list[str], b: np.ndarray) -> list[Column]:
        """Of classes 1..k-1; a shift by the largest logit keeps exp finite."""
        etas = [dot(features, list(b.reshape(len(features), -1)[:, c])) for c in range(self.classes - 1)]
        top = F.greatest(F.lit(0.0), *etas)
        total = reduce(lambda s, e: s + F.exp(e - top), etas, F.exp(-top))
        return [F.exp(e - top) / total for e in etas]

    def predict(self, df: DataFrame, features: list[str], b: np.ndarray, out: str = "prediction") -> DataFrame:
        """prediction: the class with the largest probability, ties to the higher class; prediction_k: probabilities of all classes."""
        ps = self.probabilities(features, b)
        df = df.withColumns({f"{out}_{c + 1}": p for c, p in enumerate(ps)})
        rest = 1 - reduce(lambda s, c: s + c, [F.col(f"{out}_{c + 1}") for c in range(len(ps))])
        df = df.withColumn(f"{out}_0", rest)
        best = F.greatest(*[F.struct(F.col(f"{out}_{c}").alias("p"), F.lit(c).alias("c")) for c in range(self.classes)])
        return df.withColumn(out, best["c"])

    def evaluate(self, df: DataFrame, label: str, prediction: str = "prediction") -> dict[str, float]:
        return multiclass_metrics(df, label, prediction)


def gram(data: VectorData) -> tuple[int, np.ndarray]:
    """(rows, cross products of all coordinates and, last, the label): one job."""
    from .rows import Block, folded

    at, factors, p = data.at, data.factors, data.at.size
    rows = at.complete(data.df.select(*at.columns(), F.col(data.label).cast("double").alias("__y"))).where("__y is not null and not isnan(__y)")
    every = np.arange(p)

    def of(batch) -> np.ndarray:
        block, y = Block(batch, at, factors), batch.column(batch.schema.get_field_index("__y")).to_numpy()
        total = np.zeros((p + 1, p + 1))
        for lo in range(0, block.n, 1024):
            hi = min(lo + 1024, block.n)
            x = np.c_[block.some(every, lo, hi), y[lo:hi]]
            total += x.T @ x
        return np.r_[len(batch), total.ravel()]

    got = folded(rows, 1 + (p + 1) ** 2, of)
    return int(got[0]), got[1:].reshape(p + 1, p + 1)


def r_squared(df: DataFrame, label: str, prediction: str) -> dict[str, float]:
    y = df.agg(F.avg(label).alias("m")).first()["m"]
    row = df.agg(F.sum(F.pow(F.col(label) - F.col(prediction), 2)).alias("rss"), F.sum(F.pow(F.col(label) - F.lit(y), 2)).alias("tss")).first()
    return {"r2": 1 - row["rss"] / row["tss"] if row["tss"] else float("nan")}


def binary_metrics_frame(df: DataFrame, label: str, prediction: str, cut: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, n in one row; a ratio without cases is null."""
    p, y = F.col(prediction) > cut, F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(
        F.try_divide(count(p == y), F.count("*")).alias("accuracy"), F.try_divide(count(p & y), count(p)).alias("precision"), F.try_divide(count(p & y), count(y)).alias("recall"), F.count("*").alias("n"),
    )


def binary_metrics(df: DataFrame, label: str, prediction: str) -> dict[str, float]:
    return binary_metrics_frame(df, label, prediction).first().asDict()


def multiclass_frame(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """class, precision, recall, support for each class, from the confusion counts."""
    n = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    rows = n.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.cast("long").alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("r")).select("r.*")
    s = rows.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    return s.select("class", F.try_divide("hit", "called").alias("precision"), F.try_divide("hit", "support").alias("recall"), "support")


def multiclass_metrics(df: DataFrame, label: str, prediction: str) -> dict:
    rows = multiclass_frame(df, label, prediction).orderBy("class").collect()
    n = sum(r["support"] for r in rows)
    return {"accuracy": sum((r["recall"] or 0) * r["support"] for r in rows) / n if n else float("nan"), "classes": [(r["class"], r["precision"], r["recall"]) for r in rows], "n": n}


def objective(spec: dict) -> Linear | Logistic | Multinomial:
    """From its JSON form."""
    kind = spec["obj"] if isinstance(spec, dict) else spec
    return {"linear": Linear, "logistic": Logistic}[kind]() if kind != "multinomial" else Multinomial(int(spec["c"]))


def objective_spec(o) -> dict | str:
    return {"obj": "multinomial", "c": o.classes} if isinstance(o, Multinomial) else o.name
