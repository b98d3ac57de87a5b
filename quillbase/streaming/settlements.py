"""Settlements matched to candles over streams (an extension): the stream's answer is the batch's, once the settlement hour is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbase.functions.expr import HOUR_MS
from quillbase.operators import signal

CANDLE = ("t_end", "o", "h", "l", "c", "v")


def match_funding_stream(candles: DataFrame, funding: DataFrame, lateness: str = "10 minutes", grace_ms: int = signal.Rules.grace_ms) -> DataFrame:
    """``signal.match_funding`` of two streams, in append mode: one row per candle, when the watermark has passed the hour after it.

    candles: series, t, t_end, o, h, l, c, v. funding: series, time, rate. Both become events of one keyed window, the hour in which the
    settlement must fall: the candle at its end, a settlement at its time. So the state of a series is a count, the first
    settlement and the candle for each hour that isn't over, whatever the order of arrival; one settlement, several and none are told
    apart only when none can come any more. Rows later than ``lateness`` are dropped; a candle that comes again counts once;
    rows without a time are left out, and a stream may be empty.
    """
    instant = lambda ms: F.timestamp_millis(ms)
    nothing = lambda *cs: [F.lit(None).cast(kind).alias(c) for c, kind in cs]
    kinds = dict(candles.dtypes)
    bars = candles.where("t IS NOT NULL").select("series", instant(F.col("t") + HOUR_MS).alias("at"), F.struct(*CANDLE).alias("candle"), *nothing(("time", "long"), ("rate", dict(funding.dtypes)["rate"])))
    shape = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in CANDLE) + ">"
    paid = funding.where("time IS NOT NULL").select("series", instant(F.col("time")).alias("at"), F.lit(None).cast(shape).alias("candle"), F.col("time").cast("long").alias("time"), "rate")
    events = bars.unionByName(paid).withWatermark("at", lateness)
    hours = events.groupBy("series", F.window("at", "1 hour").alias("w")).agg(F.max("candle").alias("candle"), F.count("time").alias("_n"), F.min(F.when(F.col("time").isNotNull(), F.struct("time", "rate"))).alias("s"))
    rows = hours.where("candle IS NOT NULL").select("series", (F.unix_millis(F.col("w.start")) - HOUR_MS).alias("t"), "candle.*", "_n", F.col("s.time").alias("_time"), F.col("s.rate").alias("_rate"))
    return signal.judge_settlement(rows, grace_ms)
