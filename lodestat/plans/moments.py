"""Single-pass moments: the aggregations from which linear models are solved on the driver.

Rows stay in Spark; what reaches the driver is p x p at most. Up to WIDE columns the cross products are built-in aggregates inside
code generation; beyond, each task folds its Arrow batches into one p x p block with numpy and blocks are summed.

Rows with a null or NaN in any of the columns (or in the weight) take no part and don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import complete
from .rows import folded

WIDE = 40


@dataclass
class Moments:
    """Weighted cross products of columns; n: rows."""

    columns: list[str]
    n: int
    cross: np.ndarray

    def block(self, rows: list[str], cols: list[str]) -> np.ndarray:
        i, j = [self.columns.index(c) for c in rows], [self.columns.index(c) for c in cols]
        return self.cross[np.ix_(i, j)]


def _shifted(df: DataFrame, columns: list[str], weight: str | None, shift: dict[str, float] | None, extra: tuple = ()) -> DataFrame:
    """x0..xp-1 and w of the complete rows."""
    shift = shift or {}
    x = df.select(*[(F.col(c).cast("double") - F.lit(float(shift.get(c, 0.0)))).alias(f"x{i}") for i, c in enumerate(columns)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *extra)
    return complete(x, [*[f"x{i}" for i in range(len(columns))], "w"])


def _cells(p: int) -> list:
    return [F.count("*").alias("n"), *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]]


def _of_row(columns: list[str], row) -> Moments:
    p = len(columns)
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cross[i, j] = cross[j, i] = row[f"s{i}_{j}"] or 0.0
    return Moments(columns, row["n"], cross)


def moments(df: DataFrame, columns: list[str], weight: str | None = None, shift: dict[str, float] | None = None) -> Moments:
    """Sums of w * x_i * x_j over all complete rows; shift: values to subtract first, for stability."""
    x = _shifted(df, columns, weight, shift)
    p = len(columns)
    if p <= WIDE:
        return _of_row(columns, x.agg(*_cells(p)).first())

    def fold(b: pa.RecordBatch) -> np.ndarray:
        m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
        return np.r_[((m[:, :p] * m[:, p:]).T @ m[:, :p]).ravel(), len(m)]

    flat = folded(x, p * p + 1, fold)
    return Moments(columns, int(flat[-1]), flat[:-1].reshape(p, p))


def moments_by(df: DataFrame, group: str, columns: list[str], shift: dict[str, float] | None = None) -> dict:
    """The moments of each value of group (of which there are few, such as folds), in one aggregation."""
    if len(columns) > WIDE:
        raise ValueError(f"at most {WIDE} columns by group")
    x = _shifted(df, columns, None, shift, (F.col(group).alias("g"),))
    return {r["g"]: _of_row(columns, r) for r in x.groupBy("g").agg(*_cells(len(columns))).collect()}


def added(parts: list[Moments]) -> Moments:
    return Moments(parts[0].columns, sum(m.n for m in parts), sum((m.cross for m in parts), np.zeros_like(parts[0].cross)))
