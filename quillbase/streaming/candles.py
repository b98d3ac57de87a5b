"""Hourly candles over a stream: an extension, as batch candles need whole hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.functions.expr import HOUR_MS


def stream_candles(points: DataFrame, series: str = "kind", lateness: str = "10 minutes") -> DataFrame:
    """Candles of a stream of ``operators.timeseries`` points, each sent once, when the watermark has passed its hour."""
    order = F.struct("ts", "id")
    timed = points.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    out = timed.groupBy(F.col(series).alias("series"), F.window("at", "1 hour").alias("w")).agg(
        F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count(F.lit(1)).cast("double").alias("v")
    )
    start = F.unix_millis("w.start")
    return out.select("series", start.alias("t"), "o", "h", "l", "c", "v", (start + HOUR_MS - 1).alias("t_end"))
