"""Matrices as coordinate tables (i, j, v) and vectors as (i, v): relational algebra that Spark shuffles by index.

Zeros need not be stored. Small p x p results can go to the driver; nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns of a matrix whose Gram matrix goes to the driver at most.
WIDEST = 4096
#: Rows and cells of a block of outer(), columns that are multiplied at a time, and most partitions of the pairs of blocks.
BLOCK, BLOCK_CELLS, BLOCK_COLUMNS, BLOCK_PARTS = 2048, 1 << 18, 256, 20_000
#: Cells of a partition whose cells are gathered into rows, and entries of such rows that are given at a time.
ROW_CELLS, ROW_ENTRIES = 1 << 19, 1 << 19


def coo(df: DataFrame, key: str, array: str) -> DataFrame:
    """(i, j, v) of an array column; zeros and nulls are not stored."""
    return df.select(F.col(key).alias("i"), F.posexplode(F.col(array).cast("array<double>")).alias("j", "v")).where("v <> 0")


def from_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)])
    return df.select(F.col(key).alias("i"), F.explode(cells).alias("c")).select("i", "c.j", "c.v").where("v <> 0")


def vector(values, spark) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")


def dense(m: DataFrame, columns: int) -> DataFrame:
    """(i, row): arrays with zeros filled in."""
    maps = m.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "v"))).alias("m"))
    return maps.select("i", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("row"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with the inner product of two (i, v) vectors."""
    return a.join(b.select("i", F.col("v").alias("w")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element by element, for vectors (i) or matrices (i, j)."""
    on = [c for c in ("i", "j") if c in a.columns]
    return a.join(b.withColumnRenamed("v", "w"), on).select(*on, (F.col("v") * F.col("w")).alias("v"))


def mv(m: DataFrame, x: DataFrame) -> DataFrame:
    return m.join(x.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def tmv(m: DataFrame, x: DataFrame) -> DataFrame:
    """Transposed matrix times vector."""
    return m.join(x.select("i", F.col("v").alias("w")), "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def mm(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def tmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Transposed a times b."""
    right = b.select("i", F.col("j").alias("c"), F.col("v").alias("w"))
    return a.join(right, "i").groupBy(F.col("j").alias("i"), F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gram_rows(df: DataFrame, array: str, width: int) -> np.ndarray:
    """M'M of a table of dense rows: each task adds its rows into one width x width block, so no products of cells are made as rows.

    Null rows and null or NaN entries count as 0. For wide sparse matrices use gram().
    """
    from ..plans.rows import folded

    def of(b) -> np.ndarray:
        m = b.column(0).flatten().to_numpy().reshape(len(b), width)
        return (m.T @ m).ravel()

    return folded(df.select(_filled(array, width).alias("x")), width * width, of).reshape(width, width)


def _filled(array: str, width: int) -> Column:
    """An array column without nulls and NaN."""
    return F.transform(F.coalesce(F.col(array).cast("array<double>"), F.array_repeat(F.lit(0.0), width)), lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))


def rows_times(df: DataFrame, key: str, array: str, b: np.ndarray) -> DataFrame:
    """(key, array) of each dense row times b, which is parameter-sized: rows stay where they are and pass batch by batch."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield _row_batch(batch.column(0), batch.column(1).flatten().to_numpy().reshape(len(batch), len(b)) @ b, [key, array])

    return df.select(key, _filled(array, len(b)).alias(array)).mapInArrow(of, f"`{key}` {df.schema[key].dataType.simpleString()}, `{array}` array<double>")


def _row_batch(keys: pa.Array, x: np.ndarray, names: list[str]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return pa.record_batch([keys, lists], names)


def gathered(m: DataFrame, columns: int) -> DataFrame:
    """(i, x): the cells of each row as a dense array; equal (i, j) are added. Partitions grow in number, not in size, with the table."""
    m = m.where("j is not null and v is not null").select("i", F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    parts = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m.count() // ROW_CELLS))
    kind = m.schema["i"].dataType.simpleString()

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last row, which may go on
        for batch in it:
            if not len(batch):
                continue
            code = batch.column(0).dictionary_encode(null_encoding="encode")
            row, j, v = code.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()  # rows come in order, so codes do
            names, many = code.dictionary, max(1, ROW_ENTRIES // columns)
            for low in range(0, len(names), many):
                some = slice(*np.searchsorted(row, [low, low + many]))
                x = np.zeros((min(many, len(names) - low), columns))
                np.add.at(x, (row[some] - low, j[some]), v[some])
                own = names.slice(low, len(x))
                if kept is not None and kept[0].equals(own.slice(0, 1)):
                    x[0] += kept[1][0]
                elif kept is not None:
                    yield _row_batch(*kept, ["i", "x"])
                if len(x) > 1:
                    yield _row_batch(own.slice(0, len(x) - 1), x[:-1], ["i", "x"])
                kept = own.slice(len(x) - 1), x[-1:]
        if kept is not None:
            yield _row_batch(*kept, ["i", "x"])

    return m.repartition(parts, "i").sortWithinPartitions("i").mapInArrow(of, f"i {kind}, x array<double>")


def gram(m: DataFrame) -> DataFrame:
    """M'M: half of the symmetric products are computed, then mirrored. Rows of d stored cells make d^2 / 2 products; dense rows are better off with gram_rows()."""
    right = m.select("i", F.col("j").alias("c"), F.col("v").alias("w"))
    half = m.join(right, "i").where("c >= j").groupBy(F.col("j").alias("i"), F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def outer(m: DataFrame) -> DataFrame:
    """MM', diagonal included: a cell for each two rows that store a column in common.

    Rows are dealt into blocks, and each pair of blocks is multiplied once, where its cells are also written from: what is shuffled are the
    blocks, once for each other block, and no products or partial sums.
    """
    m = m.where("j is not null and v is not null").select("i", "j", F.col("v").cast("double").alias("v"))
    n, cells = m.agg(F.count_distinct(F.struct("i")), F.count("*")).first()
    blocks = max(1, -(-n // BLOCK), -(-cells // BLOCK_CELLS))
    parts = max(8, min(BLOCK_PARTS, blocks * (blocks + 1) // 2))
    packed = m.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("i", "j", "v")).alias("p"))
    left = packed.select(F.col("b").alias("x"), F.explode(F.sequence("b", F.lit(blocks - 1).cast("long"))).alias("y"), F.col("p").alias("mine")).repartition(parts, "x", "y")
    right = packed.select(F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("x"), F.col("b").alias("y"), F.col("p").alias("theirs")).repartition(parts, "x", "y")

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(batch.num_rows):
                yield from _block_product(batch.column(1)[r].values, batch.column(2)[r].values, batch.column(0)[r].as_py())

    kind = m.schema["i"].dataType.simpleString()
    return left.join(right, ["x", "y"]).select((F.col("x") != F.col("y")).alias("two"), "mine", "theirs").mapInArrow(of, f"i {kind}, j {kind}, v double")


def _block_product(mine: pa.StructArray, theirs: pa.StructArray, mirrored: bool) -> Iterator[pa.RecordBatch]:
    """(i, j, v) of one block times another's transpose, and (j, i, v) if mirrored; BLOCK_COLUMNS columns are dense at a time."""
    sides, stored = [], []
    for p in (mine, theirs):
        i, j, v = p.flatten()
        code = i.dictionary_encode(null_encoding="encode")
        sides.append((code.dictionary, code.indices.to_numpy(), v.to_numpy()))
        stored.append(j)
    column = pa.concat_arrays(stored).dictionary_encode()
    at = np.split(column.indices.to_numpy(), [len(mine)])
    size = tuple(len(names) for names, _, _ in sides)
    total, common = np.zeros(size), np.zeros(size, np.float32)
    odd = np.unique(np.concatenate([c[~np.isfinite(v)] for c, (_, _, v) in zip(at, sides, strict=True)]))
    for low in range(0, len(column.dictionary), BLOCK_COLUMNS):
        dense, there = [], []
        for c, (names, row, v) in zip(at, sides, strict=True):
            of = (c >= low) & (c < low + BLOCK_COLUMNS)
            x = np.zeros((len(names), BLOCK_COLUMNS))
            some = of & ~np.isin(c, odd)
            np.add.at(x, (row[some], c[some] - low), v[some])
            dense.append(x)
            x = np.zeros((len(names), BLOCK_COLUMNS), np.float32)
            x[row[of], c[of] - low] = 1
            there.append(x)
        total += dense[0] @ dense[1].T
        common += there[0] @ there[1].T
    for c in odd:  # infinite or NaN entries must not meet zeros that are not stored
        (a, x), (b, y) = ((row[w == c], v[w == c]) for w, (_, row, v) in zip(at, sides, strict=True))
        with np.errstate(invalid="ignore"):
            np.add.at(total, np.ix_(a, b), np.multiply.outer(x, y))
    (first, _, _), (second, _, _) = sides
    for k in range(0, size[0], 64):
        a, b = np.nonzero(common[k : k + 64])
        i, j, v = first.take(pa.array(a + k)), second.take(pa.array(b)), pa.array(total[k : k + 64][a, b])
        yield pa.record_batch([i, j, v], ["i", "j", "v"])
        if mirrored:
            yield pa.record_batch([j, i, v], ["i", "j", "v"])


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def diag_left(d: DataFrame, m: DataFrame) -> DataFrame:
    return m.join(d.select("i", F.col("v").alias("w")), "i").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def diag_right(m: DataFrame, d: DataFrame) -> DataFrame:
    return m.join(d.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def row(m: DataFrame, i) -> DataFrame:
    return m.where(F.col("i") == i).select(F.col("j").alias("i"), "v")


def col(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("j") == j).select("i", "v")


def rows(m: DataFrame, keys: DataFrame) -> DataFrame:
    return m.join(keys.select("i").distinct(), "i", "left_semi")


def shape(m: DataFrame) -> DataFrame:
    """n_rows and n_cols, from the largest stored indices."""
    return m.agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"))


def cell(m: DataFrame, i: int, j: int, n_rows: int, n_cols: int) -> float:
    if not (0 <= i < n_rows and 0 <= j < n_cols):
        raise IndexError(f"({i}, {j}) is outside of {n_rows} x {n_cols}")
    got = m.where((F.col("i") == i) & (F.col("j") == j)).agg(F.sum("v")).first()[0]
    return float(got or 0.0)


def column_means(m: DataFrame, n_rows: int) -> DataFrame:
    """Zeros that are not stored count."""
    return m.groupBy("j").agg((F.sum("v") / F.lit(float(n_rows))).alias("mean"))


def to_numpy(m: DataFrame, n_rows: int, n_cols: int) -> np.ndarray:
    """A parameter-sized matrix on the driver."""
    out = np.zeros((n_rows, n_cols))
    got = m.toPandas()
    out[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["v"].to_numpy(float)
    return out


def svd(m: DataFrame, columns: int, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(singular values, V on the driver, U as (i, j, v)) of the k largest; needs columns^2 cells on the driver (WIDEST columns at most)."""
    if columns > WIDEST:
        raise ValueError(f"{columns} columns; {WIDEST} are the most")
    s, v, u = svd_rows(gathered(m, columns), "i", "x", columns, k)
    return s, v, u.select("i", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def svd_rows(df: DataFrame, key: str, array: str, width: int, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """svd() of a table of dense rows, whose U is (key, array) with a row of U each. Nothing is shuffled; null rows and null or NaN entries count as 0."""
    if width > WIDEST:
        raise ValueError(f"{width} columns; {WIDEST} are the most")
    values, vectors = np.linalg.eigh(gram_rows(df, array, width))
    order = np.argsort(-values)[:k]
    s = np.sqrt(np.maximum(values[order], 0))
    keep = s > 1e-12 * max(s.max(initial=0), 1e-300)
    s, v = s[keep], fix_signs(vectors[:, order[keep]])
    return s, v, rows_times(df, key, array, v / s)


def singular_values(m: DataFrame, columns: int, k: int) -> np.ndarray:
    values = np.linalg.eigvalsh(gram_rows(gathered(m, columns), "x", columns))[::-1][:k]
    return np.sqrt(np.maximum(values, 0))


def fix_signs(v: np.ndarray) -> np.ndarray:
    """The largest component of each column is positive."""
    if not v.size:
        return v
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def eigen_symmetric(a: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by size of their absolute value, and vectors."""
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(-np.abs(values))[: k or len(values)]
    return values[order], fix_signs(vectors[:, order])


def power_step(step: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """One product, scaled to unit length (the zero vector stays)."""
    y = step(x)
    size = np.linalg.norm(y)
    return y / size if size else y


def power_error(step: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> tuple[float, float]:
    """(Rayleigh quotient, length of what x misses to be an eigenvector): of a unit vector."""
    y = step(x)
    value = float(x @ y)
    return value, float(np.linalg.norm(y - value * x))


def deflated(step: Callable[[np.ndarray], np.ndarray], values: list[float], vectors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """The same symmetric map without the given eigenpairs."""
    return lambda x: step(x) - sum((v * (u @ x) * u for v, u in zip(values, vectors, strict=True)), np.zeros_like(x))


def eigen_by_power(step: Callable[[np.ndarray], np.ndarray], n: int, k: int, iterations: int = 1000, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenpairs of a symmetric map of largest absolute value, one after the other by deflation."""
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for _ in range(min(k, n)):
        v, x = power_iteration(deflated(step, values, vectors), n, iterations, eps)
        values.append(v)
        vectors.append(x)
    return np.array(values), fix_signs(np.array(vectors).T) if vectors else np.zeros((n, 0))


def table_map(m: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A (cached) n x n table as a map: each product is one job; vectors are parameter-sized."""
    spark = m.sparkSession

    def step(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for r in mv(m, vector(x, spark)).collect():
            out[r["i"]] = r["v"]
        return out

    return step


def power_iteration(step: Callable[[np.ndarray], np.ndarray], n: int, iterations: int = 1000, eps: float = 1e-12) -> tuple[float, np.ndarray]:
    """The dominant eigenpair of an operator that is known only by its product with a vector, such as a cached table's mv."""
    x = np.arange(1, n + 1, dtype=float)
    x /= np.linalg.norm(x)
    value = 0.0
    for _ in range(iterations):
        y = step(x)
        new = float(x @ y)
        size = np.linalg.norm(y)
        if size == 0:
            return 0.0, x
        y /= size
        if abs(new - value) <= eps * abs(new) and min(np.abs(y - x).max(), np.abs(y + x).max()) < 1e-9:
            return new, y
        x, value = y, new
    return value, x


def invert(a: np.ndarray) -> np.ndarray:
    """By Cholesky where a is positive definite, else by LU."""
    try:
        lower = np.linalg.inv(np.linalg.cholesky(a))
        return lower.T @ lower
    except np.linalg.LinAlgError:
        return np.linalg.inv(a)


def log_determinant(a: np.ndarray) -> float:
    return float(np.linalg.slogdet(a)[1])
