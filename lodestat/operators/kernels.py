"""Distances between vectors, kernels and feature maps. Centres are parameter-sized and enter as literals."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rows import Block, Vectors


def gaussian(r: Column, variance: float) -> Column:
    return F.exp(-r * r / F.lit(2.0 * variance))


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclid_arrays(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def angular_arrays(a: Column, b: Column) -> Column:
    """acos(cosine) / pi"""
    cosine = dot_arrays(a, b) / F.sqrt(dot_arrays(a, a) * dot_arrays(b, b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.lit(float(np.pi))


def multiply_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)


def distance_to(columns: list[str], centre: list[float]) -> Column:
    return F.sqrt(reduce(lambda s, x: s + x, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)]))


def rbf_bandwidths(centres: np.ndarray, half: bool = True) -> np.ndarray:
    """For each centre its squared distance to the nearest other one (half of it by default)."""
    d = ((centres[:, None] - centres[None]) ** 2).sum(-1)
    d[d == 0] = np.inf
    return d.min(1) * (0.5 if half else 1.0)


def rbf_features(df: DataFrame, columns: list[str], centres: np.ndarray, bandwidths: np.ndarray, prefix: str = "rbf_") -> DataFrame:
    """df with one kernel column for each centre, in one projection."""
    return df.withColumns({f"{prefix}{k}": gaussian(distance_to(columns, list(c)), float(b)) for k, (c, b) in enumerate(zip(centres, bandwidths, strict=True))})


def rbf_centres(df: DataFrame, columns: list[str], key: str, keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Centres from named rows, and their bandwidths."""
    rows = df.where(F.col(key).isin(keys)).select(key, *columns).orderBy(key).collect()
    c = np.array([[float(r[x]) for x in columns] for r in rows])
    return c, rbf_bandwidths(c)


def rbf_centres_kmeans(df: DataFrame, columns: list[str], key: str, clusters: int, iterations: int, restarts: int, half: bool = True, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centres from the cheapest of several k-means runs, and their bandwidths (half: of the squared distance to the nearest other centre, or all of it)."""
    from .cluster import kmeans_random

    c = kmeans_random(df, columns, clusters, restarts, iterations, key, seed).centres
    return c, rbf_bandwidths(c, half)


def rbf_rows(df: DataFrame, at: Vectors, centres: np.ndarray, bandwidths: np.ndarray, prefix: str = "rbf") -> tuple[DataFrame, Vectors]:
    """(df with <prefix>_indices and <prefix>_values, where they are): the kernels first, then the row's own entries, for dense or sparse vectors.

    Rows with missing entries go.
    """
    plain = Vectors(at.width, at.dense, at.indices, at.values, False)
    centres, spread = np.asarray(centres, float), 2 * np.asarray(bandwidths, float)
    norms, k = np.einsum("ij,ij->i", centres, centres), len(centres)
    names = [f"{prefix}_indices", f"{prefix}_values"]
    own = [c for c in df.columns if c not in names]
    tidy = plain.complete(df.select(*[F.col(f"`{c}`") for c in own], *plain.columns()))

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            block = Block(b, plain)
            square = np.maximum(block.squares()[:, None] - 2 * block.dot(centres.T) + norms, 0)
            kernel = np.exp(-square / spread)
            if plain.sparse:
                row, index, value = block.row, block.index, block.value
            else:
                row, index = np.nonzero(block.x)
                value = block.x[row, index]
            row, index, value = np.r_[np.repeat(np.arange(block.n), k), row], np.r_[np.tile(np.arange(k), block.n), index + k], np.r_[kernel.ravel(), value]
            o = np.lexsort((index, row))
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=block.n))], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(index[o].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value[o]))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in own], *lists], [*own, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in own)
    return tidy.mapInArrow(of, f"{kinds}`{names[0]}` array<int>, `{names[1]}` array<double>"), Vectors(at.width + k, None, *names, at.intercept)


class FeatureMap:
    """The extension point for feature maps: a callable on DataFrames that also names its columns."""

    penalize_all = False

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def columns(self, features: list[str]) -> list[str]:
        raise NotImplementedError

    def spec(self) -> dict:
        raise NotImplementedError


class Identity(FeatureMap):
    def __call__(self, df):
        return df

    def columns(self, features):
        return list(features)

    def spec(self):
        return {"type": "identity"}


@dataclass
class Rbf(FeatureMap):
    """Row -> constant 1, kernels, original columns."""

    inputs: list[str]
    centres: np.ndarray
    bandwidths: np.ndarray
    width: float = 1.0
    penalize_all: bool = False

    def __call__(self, df):
        return rbf_features(df.withColumn("intercept", F.lit(1.0)), self.inputs, self.centres, self.bandwidths * self.width)

    def columns(self, features):
        return ["intercept", *[f"rbf_{k}" for k in range(len(self.centres))], *features]

    def spec(self):
        return {"type": "rbf", "inputs": self.inputs, "centres": np.asarray(self.centres).tolist(), "bandwidths": np.asarray(self.bandwidths).tolist(), "width": self.width, "penalize_all": self.penalize_all}


def feature_map(spec: dict | str) -> FeatureMap:
    spec = json.loads(spec) if isinstance(spec, str) else dict(spec)
    makers: dict[str, Callable[..., FeatureMap]] = {"identity": Identity, "rbf": lambda centres, bandwidths, **k: Rbf(centres=np.array(centres), bandwidths=np.array(bandwidths), **k)}
    return makers[spec.pop("type")](**spec)
