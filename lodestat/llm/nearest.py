"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to a few dimensions with Gaussian (2-stable) weights: a true distance d shows as d * sqrt(X), X chi-square with as
many degrees of freedom as dimensions. A query reads projected neighbours in increasing projected distance from a kd-tree and verifies
each on the original vectors. It stops as soon as a neighbour closer than its current k-th would, with probability ``confidence``, have been
read already: chi2_cdf((projected / d_k)**2) >= confidence.

Distributed form: the top of the kd-tree (fitted on a bounded sample) cuts the projected space into cells, each held in blocks of bounded
size; a hot cell is spread over blocks by a hash of vec_id. Queries search their own cell first. Its k-th distance then bounds all else: a query is
sent to another cell only if the stopping test does not hold at the cell's nearest face. A cell's queries go in groups of bounded size, so a task holds one
block and one group; a block is copied only for the groups of its own cell, and blocks that no query asks don't move. Every row is indexed; the sample
(of about twice SAMPLE rows by a hash, then the SAMPLE smallest) only places the cuts.

Defined results: vectors that are null, zero, of another length than most of the sample, or with null or non-finite components take no part, as
query or candidate; so do rows with a null vec_id. Rows with a query's vec_id are its own; of queries with one vec_id the vector with the smaller hash counts.
Equal distances go to the smaller vec_id. Fewer candidates than k give fewer rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cut import cut

SAMPLE, MOST_CELLS, BLOCK, LEAF, GROUP = 16_384, 4096, 4096, 64, 20_000


def chi2_cdf(x: float, m: int) -> float:
    """For an even number m of degrees of freedom."""
    h = x / 2
    if h > 700:
        return 1.0
    term = total = math.exp(-h)
    for j in range(1, m // 2):
        term *= h / j
        total += term
    return 1 - total


def stop_ratio(confidence: float, m: int) -> float:
    """The squared ratio of projected to true distance from which the stopping test holds."""
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < confidence else (lo, mid)
    return hi


def projection(dimension: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, m))


def matrix(column, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision)"""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    n = np.asarray(column.value_lengths().fill_null(-1))
    if dimension is None:
        full = n[n > 0]
        dimension = int(np.bincount(full).argmax()) if len(full) else 0
    rows = np.flatnonzero(n == dimension) if dimension else np.zeros(0, np.int64)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dimension)  # null components become nan
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


@dataclass
class Cells:
    """The top of the kd-tree: cuts of inner nodes in breadth-first order, and each leaf's box."""

    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, p: np.ndarray, cells: int) -> Cells:
        depth = max(0, min(cells, MOST_CELLS, max(1, len(p) // 4)) - 1).bit_length()
        m = p.shape[1]
        dims, cuts, parts = [], [], [np.arange(len(p))]
        boxes = [(np.full(m, -np.inf), np.full(m, np.inf))]
        for _ in range(depth):
            nxt, nb = [], []
            for at, (lo, hi) in zip(parts, boxes, strict=True):
                x = p[at]
                d = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
                c = float(np.median(x[:, d])) if len(x) else 0.0
                dims.append(d)
                cuts.append(c)
                left = x[:, d] < c if len(x) else np.zeros(0, bool)
                nxt += [at[left], at[~left]]
                h, l2 = hi.copy(), lo.copy()
                h[d], l2[d] = min(hi[d], c), max(lo[d], c)
                nb += [(lo, h), (l2, hi)]
            parts, boxes = nxt, nb
        return cls(np.array(dims, np.int64), np.array(cuts), np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))

    def of(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        inner = len(self.cuts)
        if not inner:
            return at
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.dims[at]] >= self.cuts[at])
        return at - inner


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0)
    return np.einsum("qlm,qlm->ql", gap, gap)


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    parts, out = [np.arange(len(p))], []
    while parts:
        at = parts.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        x = p[at]
        d = int(np.argmax(np.ptp(x, axis=0)))
        o = np.argpartition(x[:, d], len(at) // 2)
        parts += [at[o[: len(at) // 2]], at[o[len(at) // 2 :]]]
    return out


def search(ids, x, p, qids, qx, qp, radius, k: int, ratio: float):
    """Rows (query, candidate, distance): each query's k nearest of this block, none beyond its radius."""
    leaves = _leaves(p)
    low, high = np.array([p[a].min(0) for a in leaves]), np.array([p[a].max(0) for a in leaves])
    out_q, out_i, out_d = [], [], []
    for s in range(0, len(qids), 256):
        bounds = _bounds(qp[s : s + 256], low, high)
        for j in range(len(bounds)):
            q = s + j
            order = np.argsort(bounds[j], kind="stable")
            edge = np.r_[bounds[j][order], np.inf]
            worst = radius[q]
            best_i, best_d = np.zeros(0, np.int64), np.zeros(0)
            wait, wait_p = np.zeros(0, np.int64), np.zeros(0)
            for step, leaf in enumerate(order):
                if edge[step] > ratio * worst * worst:
                    break
                at = leaves[leaf]
                gap = p[at] - qp[q]
                wait, wait_p = np.r_[wait, at], np.r_[wait_p, np.einsum("ij,ij->i", gap, gap)]
                near = wait_p <= edge[step + 1]  # no unread point is nearer than these in the projection
                now, wait, wait_p = wait[near], wait[~near], wait_p[~near]
                if not len(now):
                    continue
                now = now[ids[now] != qids[q]]
                gap = x[now] - qx[q]
                d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                ok = d <= worst  # distances are compared as they are returned, so exact ties are ties in every block
                best_i, best_d = np.r_[best_i, now[ok]], np.r_[best_d, d[ok]]
                if len(best_i) > k:
                    o = np.lexsort((ids[best_i], best_d))[:k]
                    best_i, best_d = best_i[o], best_d[o]
                if len(best_i) == k:
                    worst = min(worst, best_d.max())
            out_q.append(np.full(len(best_i), qids[q]))
            out_i.append(ids[best_i])
            out_d.append(best_d)
    cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_i, np.int64), cat(out_d, np.float64)


_FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, m: int = 8, confidence: float = 0.95, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found, by Euclidean distance in double precision."""
    if m % 2:
        raise ValueError("m must be even")
    spark, ratio = vectors.sparkSession, stop_ratio(confidence, m)
    tidy = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and x is not null")
    rows, asked = tidy(vectors), tidy(queries)
    total = rows.count()
    draw = F.xxhash64("id", "x", F.lit(3))
    few = rows if total <= SAMPLE else rows.where(F.pmod(draw, F.lit(1 << 40)) < int((1 << 40) * 2 * SAMPLE / total))
    _, some = matrix(few.orderBy(draw, "id").limit(SAMPLE).select("x").toArrow()["x"])
    if not len(some):  # rows that are all alike may all be left out
        _, some = matrix(rows.limit(SAMPLE).select("x").toArrow()["x"])
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = some.shape[1]
    weights = projection(dimension, m)
    cells = Cells.fit(some @ weights, total // BLOCK)

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, x = matrix(b.column(1), dimension)
            yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(cells.of(x @ weights), pa.int32()), b.column(1).take(pa.array(at))], ["id", "cell", "x"])

    place = lambda df: df.mapInArrow(placed, "id long, cell int, x array<double>")
    data = place(rows)
    sizes = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
    spread = {c: -(-n // BLOCK) for c, n in sizes.items()}
    first, n_blocks = {}, 0
    for c in sorted(spread):
        first[c] = n_blocks
        n_blocks += spread[c]
    table = np.zeros((len(cells.low), 2), np.int64)
    for c in first:
        table[c] = first[c], spread[c]
    one = Window.partitionBy("id").orderBy(F.xxhash64("x"))
    asked = cut(place(asked).withColumn("n", F.row_number().over(one)).where("n = 1").drop("n"))

    def wanted(b: pa.RecordBatch, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that each query of (id, cell, x, radius) has to search."""
        own = np.zeros((len(b), len(table)), bool)
        own[np.arange(len(b)), b.column(1).to_numpy()] = True
        if home:
            return np.nonzero(own)
        q = matrix(b.column(2), dimension)[1] @ weights
        return np.nonzero((_bounds(q, cells.low, cells.high) <= ratio * (b.column(3).to_numpy() ** 2)[:, None]) & ~own)

    def asks(df: DataFrame, home: bool) -> np.ndarray:
        """Groups of queries of each cell."""

        def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(table), np.int64)
            for b in it:
                n += np.bincount(wanted(b, home)[1], minlength=len(table))
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at])], ["cell", "n"])

        out = np.zeros(len(table), np.int64)
        for r in df.mapInArrow(of, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # MOST_CELLS rows at most
            out[r["cell"]] = -(-r["n"] // GROUP)
        return out

    def mixed(ids: np.ndarray) -> np.ndarray:
        return ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)

    def blocked(it: Iterator[pa.RecordBatch], groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in it:
            c, ids = b.column(1).to_numpy(), b.column(0).to_numpy()
            block = table[c, 0] + (mixed(ids) % np.maximum(table[c, 1], 1).astype(np.uint64)).astype(np.int64)
            n = groups[c]
            row = np.repeat(np.arange(len(b)), n)
            g = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row)
            yield pa.record_batch([pa.array(block[row], pa.int32()), pa.array(g, pa.int32()), b.column(0).take(at), b.column(2).take(at)], ["block", "g", "id", "x"])

    def sent(it: Iterator[pa.RecordBatch], home: bool, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Queries with their radius, once for each block that they have to search."""
        for b in it:
            row, cell = wanted(b, home)
            n = table[cell, 1]
            row, cell, base = np.repeat(row, n), np.repeat(cell, n), np.repeat(table[cell, 0], n)
            block = base + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            g = (mixed(b.column(0).to_numpy()[row] ^ 0x5DEECE66D) % np.maximum(groups[cell], 1).astype(np.uint64)).astype(np.int32)
            at = pa.array(row)
            yield pa.record_batch([pa.array(block, pa.int32()), pa.array(g), b.column(0).take(at), b.column(2).take(at), b.column(3).take(at)], ["block", "g", "id", "x", "radius"])

    def found(df: DataFrame, home: bool) -> DataFrame:
        groups = asks(df, home)

        def run(part: pa.Table, qs: pa.Table) -> pa.Table:
            if not len(part) or not len(qs):
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            part, qs = part.sort_by("id"), qs.sort_by("id")
            x, qx = matrix(part["x"], dimension)[1], matrix(qs["x"], dimension)[1]
            got = search(part["id"].to_numpy(), x, x @ weights, qs["id"].to_numpy(), qx, qx @ weights, qs["radius"].to_numpy(), k, ratio)
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got), strict=True)))

        blocks = data.mapInArrow(lambda it: blocked(it, groups), "block int, g int, id long, x array<double>")
        qs = df.mapInArrow(lambda it: sent(it, home, groups), "block int, g int, id long, x array<double>, radius double")
        return blocks.groupBy("block", "g").cogroup(qs.groupBy("block", "g")).applyInArrow(run, _FOUND)

    def top(df: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return df.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    near = cut(found(asked.withColumn("radius", F.lit(float("inf"))), True))
    radius = top(near).groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(F.lit(float("inf"))).alias("radius"))
    again = asked.join(radius, asked["id"] == radius["query_id"], "left").select("id", "cell", "x", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    return top(near.unionByName(found(again, False))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
