"""Objectives over feature vectors: one array column, or sparse rows of indices and values, of any width.

Each task folds its Arrow batches with numpy into one block (value, gradient, and a square of the Hessian for the coordinates asked for), and
blocks are added in two rounds, so the driver gets a bounded number of parameter-sized sums however many tasks there are. Value, gradient
and Hessian of one point are one job. No p x p table is formed unless it is asked for.

Rows with a null label or vector, or with null or NaN entries, take no part; sparse indices count from 0, those of one row are distinct, and indices outside of
the width are an error of the caller that shows as an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that reach the driver at most, and their bytes (one block may be larger).
LAST, LAST_BYTES = 16, 32 << 20
#: Coordinates for which a square of the Hessian is formed at most.
MOST_SQUARE = 4096


@dataclass(frozen=True)
class Vectors:
    """Where a table has its feature vectors: an array column (dense), or two array columns (indices, values).

    intercept: a constant 1 is put before them, as coordinate 0.
    """

    width: int
    dense: str | None = None
    indices: str | None = None
    values: str | None = None
    intercept: bool = True

    @property
    def sparse(self) -> bool:
        return self.dense is None

    @property
    def size(self) -> int:
        return self.width + self.intercept

    def columns(self) -> list[Column]:
        if self.sparse:
            return [F.col(self.indices).cast("array<int>").alias("__i"), F.col(self.values).cast("array<double>").alias("__v")]
        return [F.col(self.dense).cast("array<double>").alias("__v")]

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows of df (with __v, and __i if sparse) without missing entries."""
        ok = F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull() | F.isnan(x))
        return df.where(ok & (F.col("__i").isNotNull() & (F.size("__i") == F.size("__v")) if self.sparse else F.size("__v") == self.width))


def of_columns(df: DataFrame, columns: list[str], out: str = "__v") -> DataFrame:
    """df with named columns as one array column."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


class Block:
    """The vectors of one Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, at: Vectors, factors: np.ndarray | None = None):
        v = batch.column(batch.schema.get_field_index("__v"))
        self.n, self.at = len(batch), at
        if at.sparse:
            lengths = np.asarray(v.value_lengths()).astype(np.int64)
            self.row = np.repeat(np.arange(self.n), lengths)
            self.index = batch.column(batch.schema.get_field_index("__i")).flatten().to_numpy().astype(np.int64)
            self.value = v.flatten().to_numpy()
            if len(self.index) and (self.index.min() < 0 or self.index.max() >= at.width):
                raise IndexError(f"an index is outside of 0..{at.width - 1}")
            if at.intercept:
                self.row, self.index, self.value = np.r_[self.row, np.arange(self.n)], np.r_[self.index + 1, np.zeros(self.n, np.int64)], np.r_[self.value, np.ones(self.n)]
            if factors is not None:
                self.value = self.value * factors[self.index]
        else:
            x = v.flatten().to_numpy().reshape(self.n, at.width)
            self.x = np.c_[np.ones(self.n), x] if at.intercept else x
            if factors is not None:
                self.x = self.x * factors

    def dot(self, b: np.ndarray) -> np.ndarray:
        """n x k products with the columns of b (p x k)."""
        if not self.at.sparse:
            return self.x @ b
        return np.column_stack([np.bincount(self.row, self.value * b[self.index, c], self.n) for c in range(b.shape[1])])

    def back(self, r: np.ndarray) -> np.ndarray:
        """p x k sums of vectors weighted by the columns of r (n x k)."""
        if not self.at.sparse:
            return self.x.T @ r
        return np.column_stack([np.bincount(self.index, self.value * r[self.row, c], self.at.size) for c in range(r.shape[1])])

    def back_squares(self, r: np.ndarray) -> np.ndarray:
        """back() of the squared entries."""
        if not self.at.sparse:
            return (self.x * self.x).T @ r
        return np.column_stack([np.bincount(self.index, self.value**2 * r[self.row, c], self.at.size) for c in range(r.shape[1])])

    def some(self, which: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The coordinates which of rows lo to hi, dense."""
        if not self.at.sparse:
            return self.x[lo:hi][:, which]
        place = np.full(self.at.size, -1)
        place[which] = np.arange(len(which))
        keep = (place[self.index] >= 0) & (self.row >= lo) & (self.row < hi)
        out = np.zeros((hi - lo, len(which)))
        out[self.row[keep] - lo, place[self.index[keep]]] = self.value[keep]
        return out

    def squares(self) -> np.ndarray:
        """Squared length of each vector."""
        return np.einsum("ij,ij->i", self.x, self.x) if not self.at.sparse else np.bincount(self.row, self.value * self.value, self.n)


def folded(df: DataFrame, size: int, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of f, a vector of ``size`` doubles: in each task, then among tasks, then on the driver (LAST vectors at most)."""
    last = max(1, min(LAST, LAST_BYTES // (8 * size)))

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        some = False
        for b in it:
            if len(b):
                total += f(b)
                some = True
        if some:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "v"])

    def together(g: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in g["v"].to_pylist():
            total += np.frombuffer(x)
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    parts = df.mapInArrow(each, "g int, v binary").groupBy("g").applyInArrow(together, "v binary")
    return sum((np.frombuffer(r["v"]) for r in parts.collect()), np.zeros(size))


class BoundRows:
    """Value, gradient and Hessian of a linear, logistic or multinomial fit (logits against class 0).

    Parameters are p x k, row by row. The rows are cached until close().
    """

    def __init__(self, df: DataFrame, label: str, at: Vectors, mask: np.ndarray, logits: int = 1, family: str = "logistic", factors: np.ndarray | None = None, cached: bool = True):
        self.at, self.family, self.k = at, family, logits
        self.mask = np.repeat(np.asarray(mask, float), logits)
        rows = at.complete(df.select(*at.columns(), F.col(label).cast("double").alias("__y"))).where("__y is not null and not isnan(__y)")
        self.cached = cached
        self.df = rows.cache() if cached else rows
        self.factors = factors
        self._at: tuple[bytes, tuple, np.ndarray] | None = None
        self._bend: tuple[bytes, np.ndarray] | None = None
        n, trace = folded(self.df, 2, lambda b: np.array([len(b), Block(b, at, factors).squares().sum()]))
        self.n = int(n)
        #: The trace of X'X bounds its largest eigenvalue.
        self.curvature = trace * {"linear": 1.0, "logistic": 0.25, "multinomial": 0.5}[family]

    def close(self) -> None:
        if self.cached:
            self.df.unpersist()

    def sums(self, b: np.ndarray, square: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray | None]:
        """(value, gradient, Hessian of the coordinates square and all their logits): one job, remembered for the same point."""
        which = np.zeros(0, np.int64) if square is None else np.asarray(square, np.int64)
        if len(which) * self.k > MOST_SQUARE:
            raise ValueError(f"a Hessian of {len(which) * self.k} parameters is asked for; {MOST_SQUARE} is the most. Use Fista or CoordinateDescent")
        key = b.tobytes()
        if self._at and self._at[0] == key and (square is None or np.array_equal(self._at[2], which)):
            return self._at[1]
        p, k, m = self.at.size, self.k, len(which)
        got = folded(self.df, 1 + 2 * p * k + (m * k) ** 2, _task(self.at, self.factors, self.family, b.reshape(p, k), which))
        h = -got[1 + 2 * p * k :].reshape(m * k, m * k) if m else None
        self._at = key, (float(got[0]), got[1 : 1 + p * k].copy(), h), which
        self._bend = key, -got[1 + p * k : 1 + 2 * p * k]
        return self._at[1]

    def value(self, b: np.ndarray) -> float:
        return self.sums(b)[0]

    def smooth(self, b: np.ndarray) -> float:
        return self.value(b) / (2 if self.family == "linear" else 1)

    def gradient(self, b: np.ndarray) -> np.ndarray:
        return self.sums(b)[1]

    def hessian(self, b: np.ndarray) -> np.ndarray:
        return self.sums(b, np.arange(self.at.size))[2]

    def diagonal(self, b: np.ndarray) -> np.ndarray:
        """Of the Hessian; it comes with the gradient."""
        if self._bend is None or self._bend[0] != b.tobytes():
            self._at = None
            self.sums(b)
        return self._bend[1]

    def square(self, b: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The Hessian of the coordinates which (of all their logits)."""
        return self.sums(b, which)[2]

    def gradient_1d(self, b: np.ndarray, i: int) -> float:
        return float(self.gradient(b)[i])

    def hessian_1d(self, b: np.ndarray, i: int) -> float:
        return float(self.diagonal(b)[i])


def _task(at: Vectors, factors: np.ndarray | None, family: str, b: np.ndarray, which: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
    """What a task makes of a batch: value, gradient, diagonal and square of minus the Hessian at b (p x k)."""
    k, m = b.shape[1], len(which)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        block, y = Block(batch, at, factors), batch.column(batch.schema.get_field_index("__y")).to_numpy()
        value, r, weight = _rows(family, block.dot(b), y)
        out = [np.array([value]), block.back(r).ravel(), block.back_squares(np.column_stack([weight(c, c) for c in range(k)])).ravel()]
        if m:
            h = np.zeros((m, k, m, k))
            for lo in range(0, block.n, 1024):  # dense rows of the coordinates asked for
                x = block.some(which, lo, min(lo + 1024, block.n))
                for c in range(k):
                    for d in range(c, k):
                        h[:, c, :, d] += (x * weight(c, d)[lo : lo + 1024, None]).T @ x
            for c in range(k):
                for d in range(c):
                    h[:, c, :, d] = h[:, d, :, c]
            out.append(h.ravel())
        return np.concatenate(out)

    return of


def _rows(family: str, eta: np.ndarray, y: np.ndarray):
    """(value, residuals n x k, and a function that gives the weight of a pair of logits in each row)"""
    if family == "linear":
        r = y[:, None] - eta
        return -float((r * r).sum()), r, lambda c, d: np.ones(len(y))
    if family == "logistic":
        e, y = eta[:, 0], (y > 0).astype(float)
        small = np.exp(-np.abs(e))
        p = np.where(e >= 0, 1, small) / (1 + small)
        return float((y * e - np.maximum(e, 0) - np.log1p(small)).sum()), (y - p)[:, None], lambda c, d: p * (1 - p)
    k = eta.shape[1]
    top = np.maximum(eta.max(1), 0)
    w, cls = np.exp(eta - top[:, None]), y.astype(np.int64)
    total = np.exp(-top) + w.sum(1)
    p = w / total[:, None]
    own = np.where(cls == 0, 0.0, np.take_along_axis(eta, np.maximum(cls - 1, 0)[:, None], 1)[:, 0]) - top - np.log(total)
    return float(own.sum()), (cls[:, None] == np.arange(1, k + 1)) - p, lambda c, d: p[:, c] * ((c == d) - p[:, d])
