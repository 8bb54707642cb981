"""Readers and writers: keyed CSV, LIBSVM text, predictions, model JSON."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.rows import Vectors


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; one of our own only where it names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestat-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """All cells as strings; the first column (or key) becomes row_id."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumnRenamed(key or df.columns[0], "row_id")


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as numbers; what cannot be read is null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def read_libsvm(spark: SparkSession, path: str, constant: bool = False) -> DataFrame:
    """(row_id, label, indices, values) of lines 'label i:v ...' with 1-based indices, kept sparse; row_id counts lines from 0.

    constant: an entry of 1 at index 0 is put first.
    """
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m")).where(F.trim("value") != "")
    # A row's id is its place among the lines of all files, by file name and place in the file, so it doesn't depend on how files are split. A split's lines are numbered in
    # their order and offset by the counts of earlier splits.
    split = Window.partitionBy("__f", "__b").orderBy("__m")
    sizes = lines.groupBy("__f", "__b").agg(F.count("*").alias("__n"))  # a row for each split of a file
    starts = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    lines = lines.withColumn("__r", F.row_number().over(split)).join(starts, ["__f", "__b"]).select("value", (F.col("__s") + F.col("__r") - 1).alias("row_id"))
    cells = F.filter(F.slice(parts, 2, F.size(parts)), lambda c: F.instr(c, ":") > 0)
    got = lines.select("row_id", parts[0].try_cast("double").alias("label"), F.transform(cells, lambda c: F.split(c, ":")[0].cast("int")).alias("indices"), F.transform(cells, lambda c: F.split(c, ":")[1].cast("double")).alias("values"))
    if constant:
        got = got.withColumn("indices", F.concat(F.array(F.lit(0)), "indices")).withColumn("values", F.concat(F.array(F.lit(1.0)), "values"))
    return got


def libsvm_dense(df: DataFrame, width: int) -> DataFrame:
    """(row_id, label, features): arrays of indices 1..width with zeros filled in."""
    cells = F.map_from_arrays("indices", "values")
    return df.select("row_id", "label", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(0.0))).alias("features"))


def libsvm_vectors(df: DataFrame, width: int) -> tuple[DataFrame, Vectors]:
    """(df, where its sparse vectors are): 1-based indices as coordinates from 0, so that fits and k-means take the rows as they are."""
    return df.withColumn("indices", F.transform("indices", lambda i: i - 1)), Vectors(width, None, "indices", "values")


def libsvm_coo(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").alias("i"), F.explode(F.arrays_zip("indices", "values")).alias("c")).select("i", F.col("c.indices").alias("j"), F.col("c.values").alias("v"))


def from_log10_plus_1(prediction: Column) -> Column:
    """The reverse of log10(x + 1), 1 at least."""
    return F.greatest(F.lit(1.0), F.pow(F.lit(10.0), prediction) - 1)


def decided(prediction: Column, cut: float = 0.5) -> Column:
    return F.when(prediction > cut, 1).otherwise(0)


def write_predictions(df: DataFrame, key: str, value: Column, path: str, name: str = "prediction") -> None:
    df.select(key, value.alias(name)).write.mode("overwrite").option("header", True).csv(path)


def sparse_rows(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, size, indices, values) of an array column without its zeros."""
    x = F.col(array).cast("array<double>")
    at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.element_at(x, i + 1) != 0)
    at = F.when(F.size(x) > 0, at).otherwise(F.array().cast("array<int>"))
    return df.select(key, F.size(x).alias("size"), at.alias("indices"), F.transform(at, lambda i: F.element_at(x, i + 1)).alias("values"))


def appended(*parts: Column) -> Column:
    """Vectors one after the other; null if any is."""
    return F.concat(*[p.cast("array<double>") for p in parts])


def write_plot(df: DataFrame, path: str) -> None:
    """The table behind a plot as CSV with a header: what stands in for image files, as no drawing library is assumed."""
    df.write.mode("overwrite").option("header", True).csv(path)


def vector_json(values) -> str:
    return json.dumps([None if np.isnan(v) else float(v) for v in values])


def vector_from_json(text: str) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in json.loads(text)], float)


def series_json(names: list[str], values) -> str:
    return json.dumps({"index": list(names), "values": json.loads(vector_json(values))})


def series_from_json(text: str) -> tuple[list[str], np.ndarray]:
    d = json.loads(text)
    return d["index"], vector_from_json(json.dumps(d["values"]))
