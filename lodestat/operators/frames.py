"""Frame algebra: tables with a row key and one column per feature, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, names: Iterable[str] | Callable[[str], bool]) -> DataFrame:
    """Columns by name or by a predicate on the name."""
    return df.select([c for c in df.columns if names(c)] if callable(names) else list(names))


def without_rows(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among keys."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def with_rows(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def map_columns(df: DataFrame, columns: Iterable[str], f: Callable[[Column], Column]) -> DataFrame:
    """f applied to each of columns, in one projection."""
    columns = set(columns)
    return df.select([f(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def reduce_columns(df: DataFrame, columns: Iterable[str], f: Callable[[Column], Column]) -> DataFrame:
    """One row: an aggregate of each column, in one pass."""
    return df.agg(*[f(F.col(c)).alias(c) for c in columns])


def beside(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Columns of both tables, rows matched by key."""
    return left.join(right, on, how)


def reindex(df: DataFrame, columns: Iterable[str], fill: float | None = None) -> DataFrame:
    """Exactly these columns; those that are missing are null, or fill."""
    have = set(df.columns)
    out = [F.col(c).cast("double") if c in have else F.lit(None).cast("double") for c in columns]
    if fill is not None:
        out = [F.coalesce(x, F.lit(float(fill))) for x in out]
    return df.select(*[x.alias(c) for x, c in zip(out, columns, strict=True)])


def fill(df: DataFrame, columns: Iterable[str], value: float | str = 0.0) -> DataFrame:
    """Nulls and NaNs by a constant, or by the column's mean with value='mean' (one aggregation)."""
    columns = list(columns)
    clean = map_columns(df, columns, nan_to_null)
    if value != "mean":
        return clean.fillna(value, columns)
    means = clean.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return clean.fillna({c: m for c, m in means.items() if m is not None})


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def complete(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows without a null or NaN in any of columns."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns], F.lit(True)))


def drawn(key: str | Column, *seeds: int) -> Column:
    """A hash that orders rows at random: 32 hex digits of the key and seeds, the same on every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.col(key) if isinstance(key, str) else key, *[F.lit(s) for s in seeds]))


def range_bucket(df: DataFrame, column: str, parts: int = 64) -> Column:
    """The number of a value's range: ranges hold about as many rows each, and equal values share one. Nulls are in the first."""
    cuts = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.001)))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(column))), F.lit(0))


def numbered(df: DataFrame, column: str, key: str, out: str = "rn", parts: int = 64) -> DataFrame:
    """1-based place of each row by column, then key. Ranges are numbered side by side and offset, so no window spans the table."""
    at = df.withColumn("__part", range_bucket(df, column, parts))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))  # parts rows at most
    place = F.col("__s") + F.row_number().over(Window.partitionBy("__part").orderBy(column, key))
    return at.join(F.broadcast(starts), "__part").withColumn(out, place.cast("long")).drop("__part", "__s")


def value_places(df: DataFrame, column: str) -> DataFrame:
    """(v, n, before): distinct values, their rows, and the rows with smaller values. Null is smallest.

    Values are counted before they are ordered, so ties cost nothing; ranges of values are summed side by side and offset, so no window
    spans the table.
    """
    values = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).withColumn("__part", range_bucket(df.withColumn("v", F.col(column)), "v"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = values.groupBy("__part").agg(F.sum("n").alias("n")).select("__part", before(Window.orderBy("__part")).alias("__s"))  # a row for each range
    return values.join(F.broadcast(starts), "__part").select("v", "n", (F.col("__s") + before(Window.partitionBy("__part").orderBy("v"))).alias("before"))


def ranked(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ascending rank with ties averaged. Without groups (by), distinct values are counted first and numbered range by range."""
    if by:
        order = Window.partitionBy(*by).orderBy(column)
        return df.withColumn(out, F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0)
    values = value_places(df, column).select(F.col("v").alias("__v"), (F.col("before") + 1 + (F.col("n") - 1) / 2.0).alias(out))
    return df.join(values, df[column].eqNullSafe(values["__v"])).drop("__v")


def extremes(df: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    """The n smallest and n largest rows (ties by key), with side 'low' or 'high'; no global sort."""
    low = df.orderBy(F.asc(column), F.asc(key)).limit(n).withColumn("side", F.lit("low"))
    high = df.orderBy(F.desc(column), F.asc(key)).limit(n).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def row_sum(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def column_difference(df: DataFrame, other: DataFrame) -> list[str]:
    names = set(other.columns)
    return [c for c in df.columns if c not in names]


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first")).orderBy("first", column)


def modal(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value, ties to the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(1)


def column_pairs(columns: Iterable[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def long(df: DataFrame, key: str, columns: Iterable[str], name: str = "j", value: str = "v") -> DataFrame:
    """One row for each cell."""
    return df.unpivot([key], list(columns), name, value)


def wide(df: DataFrame, key: str, name: str, value: str, columns: list) -> DataFrame:
    """The reverse of long; columns are given, so no extra pass looks for them."""
    return df.groupBy(key).pivot(name, columns).agg(F.first(value))


def transposed(df: DataFrame, key: str, columns: list[str], keys: list) -> DataFrame:
    """Rows become columns; keys are the row keys wanted."""
    return wide(long(df, key, columns), "j", key, "v", keys)


def scalar(name: str, c: Column, *args: float) -> Column:
    """The scalar functions that models use, by name."""
    table: dict[str, Callable[..., Column]] = {
        "exp": F.exp, "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "sign": F.signum,
        "pow": lambda x, p: F.pow(x, F.lit(p)), "max": lambda x, m: F.greatest(x, F.lit(m)), "min": lambda x, m: F.least(x, F.lit(m)),
        "round": lambda x, d: F.round(x, int(d)), "sigmoid": sigmoid,
    }
    return table[name](c, *args)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def parse_double(c: Column) -> Column:
    """A string cell as double, or null."""
    return c.try_cast("double")


def dot(columns: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    """A linear predictor, summed by Catalyst inside one projection."""
    return reduce(lambda a, b: a + b, [F.lit(float(intercept))] + [F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])
