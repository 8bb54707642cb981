"""Scoring and running moments over Structured Streaming sources, with the same expressions as for tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends predictions to Parquet; files and offsets are committed together, so a restart repeats nothing."""
    writer = predict(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_moments(stream: DataFrame, time: str, x: str, y: str, window: str, late: str) -> DataFrame:
    """n, means, slope and correlation of y on x for each time window; rows later than the watermark are dropped by Spark."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window)).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("r")
    )
