"""k-means, k-medoid, hierarchical clustering, PCA."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.moments import moments
from ..plans.rows import Block, Vectors, folded
from .frames import complete, drawn
from .linalg import fix_signs


def nearest_centre(columns: list[str], centres: np.ndarray) -> tuple[Column, Column]:
    """(index, squared distance) of the nearest centre, lowest index on ties, as one expression."""
    squared = [reduce(lambda s, t: s + t, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, m, strict=True)]) for m in centres]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(squared)]))
    return best["k"], best["d"]


def assign(df: DataFrame, columns: list[str], centres: np.ndarray, out: str = "cluster") -> DataFrame:
    k, d = nearest_centre(columns, centres)
    return df.withColumn("__best", F.struct(k.alias("k"), d.alias("d"))).withColumn(out, F.col("__best.k")).withColumn("distance2", F.col("__best.d")).drop("__best")


def update(assigned: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Means of the clusters that have members."""
    return assigned.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])


@dataclass
class KMeansResult:
    centres: np.ndarray
    assigned_by: np.ndarray
    cost: float

    def transform(self, df: DataFrame, columns: list[str], out: str = "cluster") -> DataFrame:
        return assign(df, columns, self.assigned_by, out)


def cost(df: DataFrame, columns: list[str], labels: np.ndarray, means: np.ndarray) -> float:
    """Sum of squared distances of rows, labelled by the centres labels, to means."""
    rows = assign(df, columns, labels)
    sq = F.lit(0.0)
    for k, m in enumerate(means):
        d = reduce(lambda s, t: s + t, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, m, strict=True)])
        sq = F.when(F.col("cluster") == k, d).otherwise(sq)
    return float(rows.agg(F.sum(sq)).first()[0] or 0.0)


def kmeans(df: DataFrame, columns: list[str], centres: np.ndarray, iterations: int) -> KMeansResult:
    """iterations + 1 Lloyd steps from given centres; clusters without members go, the others are renumbered.

    Labels are by the centres before the last update, the cost by those after it. One aggregation a step over cached rows.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).cache()
    before = np.asarray(centres, float)
    for _ in range(iterations + 1):
        before = np.asarray(centres, float)
        got = update(assign(rows, columns, before), columns).orderBy("cluster").collect()
        centres = np.array([[r[c] for c in columns] for r in got])
        live = np.array([r["cluster"] for r in got])
        before = before[live]
    total = cost(rows, columns, before, centres)
    rows.unpersist()
    return KMeansResult(centres, before, total)


def kmeans_random(df: DataFrame, columns: list[str], k: int, restarts: int, iterations: int, key: str, seed: int = 42) -> KMeansResult:
    """The cheapest of several runs from rows picked by a seeded hash of their key."""
    best = None
    for r in range(restarts):
        rows = df.orderBy(drawn(key, seed + r), key).limit(k).select(*columns).collect()
        got = kmeans(df, columns, np.array([[float(x[c]) for c in columns] for x in rows]), iterations)
        best = got if best is None or got.cost < best.cost else best
    return best


def assign_rows(df: DataFrame, at: Vectors, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """df with the nearest centre (lowest index on ties) and its squared distance, for feature vectors, dense or sparse.

    |x - c|^2 = |x|^2 - 2 x.c + |c|^2 with the centres' norms computed once, so a sparse row costs its entries only. Rows with missing entries go.
    """
    at = Vectors(at.width, at.dense, at.indices, at.values, False)
    centres = np.asarray(centres, float)
    norms = np.einsum("ij,ij->i", centres, centres)
    own = [c for c in df.columns if c not in (out, "distance2")]
    tidy = at.complete(df.select(*[F.col(f"`{c}`") for c in own], *at.columns()))

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            k, d = _nearest(Block(b, at), centres, norms)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in own], pa.array(k, pa.int32()), pa.array(d)], [*own, out, "distance2"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in own)
    return tidy.mapInArrow(of, f"{kinds}, `{out}` int, distance2 double")


def _nearest(block: Block, centres: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, at = np.full(block.n, np.inf), np.zeros(block.n, np.int64)
    for lo in range(0, len(centres), 64):  # a bounded table of distances at a time
        d = norms[lo : lo + 64] - 2 * block.dot(centres[lo : lo + 64].T)
        k = d.argmin(1)
        near = d[np.arange(block.n), k]
        closer = near < best
        best, at = np.where(closer, near, best), np.where(closer, k + lo, at)
    return at, np.maximum(best + block.squares(), 0)


def kmeans_rows(df: DataFrame, at: Vectors, centres: np.ndarray, iterations: int) -> KMeansResult:
    """kmeans() on feature vectors of any width, dense or sparse: one numpy fold a step over cached rows."""
    at = Vectors(at.width, at.dense, at.indices, at.values, False)
    rows = at.complete(df.select(*at.columns())).cache()
    centres = np.asarray(centres, float)
    try:
        for _ in range(iterations + 1):
            before, norms, k = centres, np.einsum("ij,ij->i", centres, centres), len(centres)

            def of(b: pa.RecordBatch, before=before, norms=norms, k=k) -> np.ndarray:
                block = Block(b, at)
                near, _ = _nearest(block, before, norms)
                if at.sparse:
                    sums = np.bincount(near[block.row] * at.width + block.index, block.value, k * at.width)
                else:
                    sums = np.bincount((near[:, None] * at.width + np.arange(at.width)).ravel(), block.x.ravel(), k * at.width)
                return np.r_[np.bincount(near, minlength=k), sums, block.squares().sum()]

            got = folded(rows, k + k * at.width + 1, of)
            n, sums = got[:k], got[k:-1].reshape(k, at.width)
            live = n > 0
            before, centres = before[live], sums[live] / n[live, None]
        # labels by the centres before the last update, cost by those after it: sum |x|^2 - 2 sum_k m_k.s_k + sum_k n_k |m_k|^2
        total = got[-1] - float((n[live] * np.einsum("ij,ij->i", centres, centres)).sum())
    finally:
        rows.unpersist()
    return KMeansResult(centres, before, max(total, 0.0))


def kmeans_rows_random(df: DataFrame, at: Vectors, k: int, restarts: int, iterations: int, key: str, seed: int = 42) -> KMeansResult:
    """The cheapest of several runs from rows picked by a seeded hash of their key."""
    at = Vectors(at.width, at.dense, at.indices, at.values, False)
    rows, best = at.complete(df.select(F.col(key).alias("__k"), *at.columns())), None
    for r in range(restarts):
        picked = rows.orderBy(drawn("__k", seed + r), "__k").limit(k).drop("__k").toArrow().combine_chunks().to_batches()
        start = np.concatenate([Block(b, at).some(np.arange(at.width), 0, len(b)) for b in picked]) if picked else np.zeros((0, at.width))
        if not len(start):
            raise ValueError("k-means needs a complete row at least")
        got = kmeans_rows(df, at, start, iterations)
        best = got if best is None or got.cost < best.cost else best
    return best


def cluster_plot(assigned: DataFrame, key: str, x: str, y: str, cluster: str = "cluster", centres: np.ndarray | None = None) -> DataFrame:
    """(kind, key, x, y, cluster): the points of a scatter plot of two coordinates, and the centres (kind 'centre', null key)."""
    points = assigned.select(F.lit("point").alias("kind"), F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(cluster).cast("long").alias("cluster"))
    if centres is None:
        return points
    rows = [("centre", None, float(c[0]), float(c[1]), k) for k, c in enumerate(centres)]
    return points.unionByName(assigned.sparkSession.createDataFrame(rows, "kind string, key string, x double, y double, cluster long"))


def medoid_plot(df: DataFrame, assigned: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(kind, key, x, y, cluster) of k-medoid clusters, each named by its medoid's key; the medoids themselves are of kind 'medoid'."""
    both = df.join(assigned.select(F.col("i").alias(key), "medoid"), key)
    kind = F.when(F.col(key) == F.col("medoid"), "medoid").otherwise("point")
    return both.select(kind.alias("kind"), F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col("medoid").cast("long").alias("cluster"))


#: Pairs of rows that distances() makes at most.
MOST_PAIRS = 500_000_000

#: Points of a block, and most partitions of the pairs of blocks, when sums of distances within clusters are formed.
BLOCK, BLOCK_PARTS = 2048, 20_000


def distances(df: DataFrame, key: str, columns: list[str], to: DataFrame | None = None) -> DataFrame:
    """(i, j, d) of all pairs, or of all rows i and the rows j of to.

    All pairs are a square of the rows; a table with more than MOST_PAIRS is refused (kmedoid_rows() works on any number of rows).
    """
    if to is None and (n := df.count()) ** 2 > MOST_PAIRS:
        raise ValueError(f"{n} rows have {n * n} pairs; {MOST_PAIRS} are the most")
    left = df.select(F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = (df if to is None else to).select(F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    d = F.sqrt(reduce(lambda s, t: s + t, [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]))
    return left.join(right, F.lit(True)).select("i", "j", d.alias("d"))


def medoid_distances(df: DataFrame, key: str, columns: list[str], medoids: list) -> DataFrame:
    """(i, j, d) of all rows and the medoids, which are broadcast."""
    return distances(df, key, columns, F.broadcast(df.where(F.col(key).isin(medoids))))


def medoid_assign(dist: DataFrame, medoids: list) -> DataFrame:
    """(i, medoid, d): the nearest medoid, lowest id on ties."""
    best = F.min(F.struct("d", "j"))
    return dist.where(F.col("j").isin(medoids)).groupBy("i").agg(best.alias("b")).select("i", F.col("b.j").alias("medoid"), F.col("b.d").alias("d"))


def medoid_recenter(dist: DataFrame, assigned: DataFrame) -> DataFrame:
    """(medoid, new): in each cluster the member with the smallest sum of distances, lowest id on ties."""
    mine, theirs = assigned.select("i", "medoid"), assigned.select(F.col("i").alias("j"), F.col("medoid").alias("m2"))
    sums = dist.join(mine, "i").join(theirs, "j").where("medoid = m2").groupBy("medoid", "i").agg(F.sum("d").alias("s"))
    return sums.groupBy("medoid").agg(F.min(F.struct("s", "i")).alias("b")).select("medoid", F.col("b.i").alias("new"))


def medoid_recenter_rows(df: DataFrame, key: str, columns: list[str], assigned: DataFrame) -> DataFrame:
    """medoid_recenter() of all rows without a table of pairs.

    Equal rows of a cluster are one point with its lowest id and a weight. Points are dealt into blocks, and each pair of blocks of a
    cluster gives one sum for each point of the first. Rows with a null coordinate have no distance and take no part.
    """
    rows = df.dropna(subset=[key, *columns]).select(F.col(key).alias("i"), *[F.col(c).cast("double").alias(c) for c in columns])
    points = rows.join(assigned.select("i", "medoid"), "i").groupBy("medoid", *columns).agg(F.min("i").alias("i"), F.count("*").cast("double").alias("w"))
    sizes = points.groupBy("medoid").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    pairs = int(sizes.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 1)
    parts = max(8, min(BLOCK_PARTS, pairs))
    dealt = points.join(F.broadcast(sizes), "medoid").withColumn("b", F.pmod(F.xxhash64(*columns), F.col("blocks")))
    packed = dealt.groupBy("medoid", "blocks", "b").agg(F.collect_list(F.struct("i", "w", F.array(*columns).alias("x"))).alias("p"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = packed.select("medoid", F.col("b").alias("a"), every.alias("b"), F.col("p").alias("mine")).repartition(parts, "medoid", "a", "b")
    right = packed.select("medoid", "b", every.alias("a"), F.col("p").alias("theirs")).repartition(parts, "medoid", "a", "b")

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(batch.num_rows):
                (i, _, x), (_, w, y) = (batch.column(c)[r].values.flatten() for c in (1, 2))
                x, y = (v.flatten().to_numpy().reshape(-1, len(columns)) for v in (x, y))
                s = np.concatenate([_distances(x[k : k + 256], y) @ w.to_numpy() for k in range(0, len(x), 256)])
                yield pa.record_batch([pa.array([batch.column(0)[r].as_py()] * len(i), batch.column(0).type), i, pa.array(s)], ["medoid", "i", "s"])

    kind = {c: points.schema[c].dataType.simpleString() for c in ("medoid", "i")}
    sums = left.join(right, ["medoid", "a", "b"]).select("medoid", "mine", "theirs").mapInArrow(of, f"medoid {kind['medoid']}, i {kind['i']}, s double")
    whole = sums.groupBy("medoid", "i").agg(F.sum("s").alias("s"))
    return whole.groupBy("medoid").agg(F.min(F.struct("s", "i")).alias("b")).select("medoid", F.col("b.i").alias("new"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        d += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(d)


@dataclass
class KMedoidResult:
    medoids: list
    cost: float


def kmedoid(dist: DataFrame, medoids: list, most: int = 100) -> KMedoidResult:
    """Alternates until the cost no longer falls; the best step is kept."""
    dist = dist.cache()
    best = _alternate(lambda now: medoid_assign(dist, now), lambda a: medoid_recenter(dist, a), medoids, most)
    dist.unpersist()
    return best


def kmedoid_rows(df: DataFrame, key: str, columns: list[str], medoids: list, most: int = 100) -> KMedoidResult:
    """kmedoid() of all rows without a table of pairs."""
    rows = df.select(key, *columns).cache()
    best = _alternate(lambda now: medoid_assign(medoid_distances(rows, key, columns, now), now), lambda a: medoid_recenter_rows(rows, key, columns, a), medoids, most)
    rows.unpersist()
    return best


def _alternate(assigned: Callable[[list], DataFrame], recentred: Callable[[DataFrame], DataFrame], medoids: list, most: int) -> KMedoidResult:
    best, now = None, sorted(medoids)
    for _ in range(most):
        a = assigned(now).cache()
        c = float(a.agg(F.sum("d")).first()[0] or 0.0)
        if best is not None and c >= best.cost:
            a.unpersist()
            break
        best = KMedoidResult(now, c)
        now = sorted(r["new"] for r in recentred(a).collect())
        a.unpersist()
    return best


def complete_linkage(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a small distance matrix; merge m makes cluster n + m; ties to the smallest ids."""
    n = len(d)
    live = {i: [i] for i in range(n)}
    gap = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for m in range(n - 1):
        (a, b), h = min(gap.items(), key=lambda x: (x[1], x[0]))
        new = n + m
        for k in live:
            if k not in (a, b):
                gap[(k, new)] = max(gap[tuple(sorted((a, k)))], gap[tuple(sorted((b, k)))])
        gap = {p: v for p, v in gap.items() if a not in p and b not in p}
        live[new] = live.pop(a) + live.pop(b)
        out.append((a, b, h))
    return out


def leaf_order(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    members = {i: [i] for i in range(n)}
    for m, (a, b, _) in enumerate(merges):
        members[n + m] = members.pop(a) + members.pop(b)
    return next(iter(members.values())) if members else []


def column_distances(df: DataFrame, columns: list[str], angular: bool = False) -> np.ndarray:
    """Between columns, from one Gram aggregation."""
    g = moments(df, columns).cross
    size = np.diag(g)
    if angular:
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = np.nan_to_num(g / np.sqrt(np.outer(size, size)))
        np.fill_diagonal(cos, 1.0)
        return np.arccos(np.clip(cos, -1, 1)) / np.pi
    return np.sqrt(np.maximum(size[:, None] + size[None] - 2 * g, 0))


def cluster_columns(df: DataFrame, columns: list[str], distance: Callable[[DataFrame, list[str]], np.ndarray] = column_distances) -> tuple[list[str], np.ndarray]:
    """(columns in the leaf order of complete linkage, their distance matrix in that order)"""
    d = distance(df, columns)
    order = leaf_order(complete_linkage(d), len(columns))
    return [columns[i] for i in order], d[np.ix_(order, order)]


#: Products of scores that are written as one projection at most.
FEW_TERMS = 256


@dataclass
class Pca:
    """sigma: singular values of the demeaned data; loadings: columns of V."""

    columns: list[str]
    means: np.ndarray
    sigma: np.ndarray
    loadings: np.ndarray

    def scores(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """df with U * Sigma: in one projection, or (for more than FEW_TERMS products) by numpy on Arrow batches. Rows with missing cells get nulls."""
        names = [f"{prefix}{k + 1}" for k in range(len(self.sigma))]
        if len(self.columns) * len(names) > FEW_TERMS:
            own = [c for c in df.columns if c not in names]
            x = F.array(*[F.col(c).cast("double") for c in self.columns])
            means, loadings = self.means, self.loadings

            def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in it:
                    m = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(means))
                    s = (m - means) @ loadings
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, from_pandas=True) for c in s.T]], [*own, *names])

            kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in own)
            return df.select(*own, x.alias("__x")).mapInArrow(of, kinds + ", ".join(f"`{n}` double" for n in names))

        def score(k: int) -> Column:
            return reduce(lambda s, t: s + t, [(F.col(c) - F.lit(float(m))) * F.lit(float(self.loadings[i, k])) for i, (c, m) in enumerate(zip(self.columns, self.means, strict=True))])

        return df.withColumns({n: score(k) for k, n in enumerate(names)})

    def scree(self, spark) -> DataFrame:
        share = self.sigma**2 / (self.sigma**2).sum()
        return spark.createDataFrame([(k + 1, float(s), float(f)) for k, (s, f) in enumerate(zip(self.sigma, share, strict=True))], "component int, sigma double, share double")

    def pairwise(self, df: DataFrame, key: str, group: str | None = None) -> DataFrame:
        """(key, a, b, x, y, group): every pair of components a < b as the points of a scatter plot."""
        scored, n = self.scores(df, "__pc"), len(self.sigma)
        pairs = [F.struct(F.lit(a + 1).alias("a"), F.lit(b + 1).alias("b"), F.col(f"__pc{a + 1}").alias("x"), F.col(f"__pc{b + 1}").alias("y")) for a in range(n) for b in range(a + 1, n)]
        colour = F.col(group).cast("string") if group else F.lit(None).cast("string")
        return scored.select(F.col(key).alias("key"), colour.alias("group"), F.explode(F.array(*pairs)).alias("p")).select("key", "group", "p.*")

    def loading_histograms(self, spark, bins: int = 20) -> DataFrame:
        """(component, bin, low, high, n) of the loadings of each component; parameter-sized."""
        out = []
        for k in range(len(self.sigma)):
            n, edges = np.histogram(self.loadings[:, k], bins)
            out += [(k + 1, i, float(edges[i]), float(edges[i + 1]), int(c)) for i, c in enumerate(n)]
        return spark.createDataFrame(out, "component int, bin int, low double, high double, n long")

    def top_loadings(self, spark, n: int = 5) -> DataFrame:
        """(component, place, term, loading): the n smallest and n largest loadings of each component, all where there are fewer than 2 n."""
        out = []
        for k in range(len(self.sigma)):
            order = sorted(range(len(self.columns)), key=lambda i: (self.loadings[i, k], self.columns[i]))  # noqa: B023
            order = order if len(order) < 2 * n else order[:n] + order[-n:]
            out += [(k + 1, at, self.columns[i], float(self.loadings[i, k])) for at, i in enumerate(order)]
        return spark.createDataFrame(out, "component int, place int, term string, loading double")

    def loading_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, k + 1, float(self.loadings[i, k])) for i, c in enumerate(self.columns) for k in range(len(self.sigma))], "term string, component int, loading double")


def pca(df: DataFrame, columns: list[str], most: int = 10) -> Pca:
    """Two aggregations: means, then the centred Gram matrix of the complete rows.

    The rank is that of the standardised data (singular values above 1e-4); components of the demeaned data at 1e-4 or less go too.
    """
    df = complete(df, columns)
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = np.array([row[c] or 0.0 for c in columns])
    g = moments(df, columns, shift=dict(zip(columns, means, strict=True)))
    sd = np.sqrt(np.diag(g.cross) / max(g.n - 1, 1))
    unit = g.cross / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
    rank = int((np.sqrt(np.maximum(np.linalg.eigvalsh(unit), 0)) > 1e-4).sum())
    values, vectors = np.linalg.eigh(g.cross)
    order = np.argsort(-values)[: min(rank, most)]
    order = order[np.sqrt(np.maximum(values[order], 0)) > 1e-4]
    return Pca(list(columns), means, np.sqrt(np.maximum(values[order], 0)), fix_signs(vectors[:, order]))


def pca_from_covariance(cov: np.ndarray, most: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, scores) of a sample by sample covariance; there are no loadings."""
    values, vectors = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-values)[:most] if values[i] > 1e-4]
    sigma = np.sqrt(values[order])
    return sigma, fix_signs(vectors[:, order]) * sigma
