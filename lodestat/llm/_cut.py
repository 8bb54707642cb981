"""Lineage cuts and distributed connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that are broadcast at most (about 50 bytes each).
BROADCAST_ROWS = 500_000


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """df, computed once and written to the folder named in spark.checkpoint.dir.

    free: what led to it was large; have Spark delete those shuffle files now.

    A folder of our own is used only where the session names none, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestat-"))
    out = df.checkpoint(True)
    if free:  # once collected, the shuffles that led to out go from all machines
        gc.collect()
        sc._jvm.System.gc()
    return out


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps: each step links nodes to the smallest
    neighbour, with aggregations and joins only, so no component meets in one task.
    Empty edges give an empty table.
    """
    one = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(limit):
        both = e.select(F.explode(F.array(one("a", "b"), one("b", "a"))).alias("e")).select("e.a", "e.b")
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.least("a", "m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(one("v", "m"), one("u", "m"))).alias("e")).select("e.a", "e.b")
        e = cut(small.where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    heads = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads.select("node", F.col("node").alias("component")))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole text column, by one aggregation."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)
