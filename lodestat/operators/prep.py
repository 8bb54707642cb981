"""Data preparation: from tables of strings to tables of doubles."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import nan_to_null, parse_double, ranked

#: What counts as missing in string cells, after trimming and lower-casing.
NA = ("na", "n/a", "")


class MissingMode(Enum):
    DROP_SAMPLE = "drop"
    MEAN_IMPUTE = "impute"


@dataclass
class Prepared:
    frame: DataFrame
    levels: dict[str, list[str]] = field(default_factory=dict)


def is_na(c: Column, na: tuple[str, ...] = NA) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*na)


def categorical_columns(df: DataFrame, columns: list[str], force: tuple[str, ...] = (), na: tuple[str, ...] = NA) -> list[str]:
    """Columns with any value that is neither missing nor a number, and those forced: one aggregation."""
    text = {c: F.col(c).cast("string") for c in columns}
    row = df.agg(*[F.max(F.when(~is_na(x, na) & parse_double(x).isNull(), 1).otherwise(0)).alias(c) for c, x in text.items()]).first()
    return [c for c in columns if c in force or row[c] == 1]


#: Levels of one categorical column at most: each becomes a column.
MOST_LEVELS = 10_000


def all_levels(df: DataFrame, columns: list[str], na: tuple[str, ...] = NA) -> dict[str, list[tuple[str, int]]]:
    """(level, rows) of each column, levels ascending: one aggregation over all columns. More than MOST_LEVELS of a column are an error."""
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    if not columns:
        return out
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("c")
    counts = df.select(cells).select("c.*").where(~is_na(F.col("v"), na)).groupBy("i", "v").agg(F.count("*").alias("n"))
    got = counts.limit(MOST_LEVELS * len(columns) + 1).collect()
    for r in got:
        out[columns[r["i"]]].append((r["v"], r["n"]))
    for c, found in out.items():
        if len(found) > MOST_LEVELS or len(got) > MOST_LEVELS * len(columns):
            raise ValueError(f"column {c} has more than {MOST_LEVELS} levels" if len(found) > MOST_LEVELS else "too many levels")
        found.sort()
    return out


def levels(df: DataFrame, column: str, na: tuple[str, ...] = NA) -> list[str]:
    """Distinct non-missing values, ascending; MOST_LEVELS at most."""
    return [v for v, _ in all_levels(df, [column], na)[column]]


def one_hot(df: DataFrame, column: str, values: list[str], drop_first: bool = True) -> DataFrame:
    """column becomes column_level of 1.0 and 0.0 for each level but the first."""
    flags = [F.when(F.col(column).cast("string") == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in values[1 if drop_first else 0 :]]
    return df.select(*[c for c in df.columns if c != column], *flags)


def fill_category(df: DataFrame, column: str, mode: MissingMode, na: tuple[str, ...] = NA) -> DataFrame:
    """Missing categories: the most frequent level (ties to the smallest), or the row goes."""
    x = F.col(column).cast("string")
    if mode is MissingMode.DROP_SAMPLE:
        return df.where(~is_na(x, na))
    top = df.where(~is_na(x, na)).groupBy(x.alias("v")).count().orderBy(F.desc("count"), "v").limit(1).first()
    return df.withColumn(column, F.when(is_na(x, na), F.lit(top["v"] if top else None)).otherwise(x))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def fill_numeric(df: DataFrame, columns: list[str], mode: MissingMode) -> DataFrame:
    """Missing or infinite numbers: the mean of the finite ones, or the row goes."""
    if mode is MissingMode.DROP_SAMPLE:
        return df.where(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns], F.lit(True)))
    means = df.agg(*[F.avg(F.when(finite(F.col(c)), F.col(c))).alias(c) for c in columns]).first().asDict() if columns else {}
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)).otherwise(F.lit(means[c])) for c in columns})


def scale(df: DataFrame, columns: list[str], factors: dict[str, float] | None = None) -> DataFrame:
    """x / sample standard deviation, not centred; a constant column stays as it is. factors: given standard deviations."""
    if factors is None:
        factors = deviations(df, columns)
    return df.withColumns({c: F.col(c) / F.lit(factors[c] if factors.get(c) else 1.0) for c in columns})


def deviations(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first().asDict()


def prep(df: DataFrame, key: str, mode: MissingMode = MissingMode.MEAN_IMPUTE, force: tuple[str, ...] = (), na: tuple[str, ...] = NA, normalize: bool = False) -> Prepared:
    """All steps: find categories, fill or drop their gaps, one-hot, parse, fill or drop numeric gaps, and scale if asked."""
    columns = [c for c in df.columns if c != key]
    categories = categorical_columns(df, columns, force, na)
    found: dict[str, list[str]] = {}
    if mode is MissingMode.DROP_SAMPLE:
        for c in categories:
            df = fill_category(df, c, mode, na)
    counts = all_levels(df, categories, na)
    for c in categories:
        found[c] = [v for v, _ in counts[c]]
        if mode is MissingMode.MEAN_IMPUTE and counts[c]:
            top = min(counts[c], key=lambda x: (-x[1], x[0]))[0]
            df = df.withColumn(c, F.when(is_na(F.col(c).cast("string"), na), F.lit(top)).otherwise(F.col(c).cast("string")))
    for c in categories:
        df = one_hot(df, c, found[c])
    numeric = [c for c in columns if c not in categories]
    df = df.withColumns({c: nan_to_null(parse_double(F.when(is_na(F.col(c).cast("string"), na), None).otherwise(F.col(c).cast("string")))) for c in numeric})
    df = fill_numeric(df, numeric, mode)
    if normalize:
        df = scale(df, [c for c in df.columns if c != key])
    return Prepared(df, found)


def with_intercept(df: DataFrame, key: str | None = None, name: str = "intercept") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.select(*([key] if key else []), F.lit(1.0).alias(name), *rest)


def zero_to_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zeros by the mean of the other values."""
    means = df.agg(*[F.avg(F.when(F.col(c) != 0, F.col(c))).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.when(F.col(c) == 0, F.lit(means[c])).otherwise(F.col(c)) for c in columns})


def powers(df: DataFrame, columns: list[str], exponents: tuple[int, ...] = (2, 3)) -> DataFrame:
    return df.withColumns({f"{c}_p{e}": F.pow(F.col(c), F.lit(float(e))) for c in columns for e in exponents})


def interactions(df: DataFrame, columns: list[str], most_zeros: int | None = None) -> DataFrame:
    """Products of column pairs; with most_zeros only those that are zero in fewer rows (one aggregation)."""
    pairs = list(combinations(columns, 2))
    if most_zeros is not None and pairs:
        row = df.agg(*[F.count_if(F.col(a) * F.col(b) == 0).alias(f"{a}*{b}") for a, b in pairs]).first()
        pairs = [(a, b) for a, b in pairs if row[f"{a}*{b}"] < most_zeros]
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs})


def differs(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(a) != F.col(b), 1.0).otherwise(0.0))


def log10_plus_1(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.log10(F.col(c) + 1) for c in columns})


def rank_sum(df: DataFrame, signed: dict[str, int], out: str = "rank_sum", by: list[str] | None = None) -> DataFrame:
    """Sum of each column's tie-averaged rank times its sign."""
    total = F.lit(0.0)
    for c, s in signed.items():
        df = ranked(df, c, f"__{c}", by)
        total = total + F.col(f"__{c}") * s
    return df.withColumn(out, total).drop(*[f"__{c}" for c in signed])


def univariate_screen(df: DataFrame, label: str, columns: list[str], p_below: float = 1e-4) -> list[dict]:
    """Simple regressions of label on each column, all in one aggregation; those with a small p value, with the slope's sign."""
    from ..functions.tests import student_test

    aggregates = [f(label, c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("slope", F.regr_slope), ("r", F.corr), ("n", F.regr_count))]
    row, out = df.agg(*aggregates).first(), []
    for i, c in enumerate(columns):
        slope, r, n = row[f"slope_{i}"], row[f"r_{i}"], row[f"n_{i}"]
        if slope is None or r is None or n < 3:
            continue
        sd = abs(slope / r) * ((1 - r * r) / (n - 2)) ** 0.5 if r else float("nan")
        test = student_test(slope, sd, n - 2)
        if test.p_value < p_below:
            out.append({"term": c, "slope": slope, "sign": 1 if slope > 0 else -1, "std_error": sd, "t": test.statistic, "p_value": test.p_value})
    return out
