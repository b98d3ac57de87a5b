"""Daily roll-ups, activity over all groups, and volume by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbase.operators.ledger import at, since


def daily(transfers: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """By (token, chain, day): transfers, distinct senders, volume in millions."""
    recent = transfers.where((F.col("ts") > since(as_of, days)) & (F.col("ts") <= at(as_of)))
    return recent.groupBy("token", "chain", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("transfers"),
        F.countDistinct("sender").alias("unique_senders"),
        F.round(F.sum("value").cast("double") / 1e6, 6).alias("volume_m"),
    )


def overall(transfers: DataFrame, as_of: str, tokens: tuple[str, ...]) -> DataFrame:
    """One row per token, also for those without transfers: activity of 7 and 30 days, in one pass over the log."""
    spark = transfers.sparkSession
    recent = transfers.where((F.col("ts") > since(as_of, 30)) & (F.col("ts") <= at(as_of)) & F.col("token").isin(*tokens))
    side = lambda c, k: F.struct(F.col(c).alias("party"), F.lit(k).alias("side"))
    parties = recent.select("token", "ts", "value", F.explode(F.array(side("sender", 0), side("receiver", 1))).alias("p"))
    # a party counts once for each side; its last transfer says for which windows
    each = parties.groupBy("token", "p").agg(
        F.max("ts").alias("last"),
        *(F.count_if((F.col("p.side") == 0) & (F.col("ts") > since(as_of, d))).alias(f"n{d}") for d in (7, 30)),
        *(F.sum(F.when((F.col("p.side") == 0) & (F.col("ts") > since(as_of, d)), F.col("value"))).alias(f"v{d}") for d in (7, 30)),
    )
    out = each.groupBy("token").agg(
        *(F.count_if(F.col("last") > since(as_of, d)).alias(f"active_{d}d") for d in (7, 30)),
        *(F.sum(f"n{d}").alias(f"transfers_{d}d") for d in (7, 30)),
        *(F.round(F.coalesce(F.sum(f"v{d}"), F.lit(0)).cast("double") / 1e6, 6).alias(f"volume_{d}d") for d in (7, 30)),
    )
    names = spark.createDataFrame([(t,) for t in tokens], "token string")
    return names.join(out, "token", "left").fillna(0)


def pair_volume(trades: DataFrame, as_of: str, first: str, second: str, top: int = 20) -> DataFrame:
    """The pairs of largest 30-day volume: volume and trades of 7 and 30 days. A trade with both tokens counts as the first's.

    ``trades`` repeats ``trades_30d`` for readers of an older layout.
    """
    tokens = (first, second)
    recent = trades.where((F.col("ts") > since(as_of, 30)) & (F.col("ts") <= at(as_of)) & (F.col("bought").isin(*tokens) | F.col("sold").isin(*tokens)))
    token = F.when((F.col("bought") == first) | (F.col("sold") == first), first).otherwise(second)
    week = F.col("ts") > since(as_of, 7)
    out = recent.groupBy(token.alias("token"), "project", F.col("pair").alias("token_pair")).agg(
        F.coalesce(F.sum(F.when(week, F.col("amount"))), F.lit(0)).cast("double").alias("volume_7d"),
        F.count_if(week).alias("trades_7d"),
        F.sum("amount").alias("volume"),
        F.count(F.lit(1)).alias("trades_30d"),
    )
    best = out.orderBy(F.desc("volume"), "token", "project", "token_pair").limit(top)
    return best.select("token", "project", "token_pair", "volume_7d", "trades_7d", F.col("volume").cast("double").alias("volume_30d"), "trades_30d", F.col("trades_30d").alias("trades"))


def daily_supply(transfers: DataFrame, issuer_below: int) -> DataFrame:
    """By day and chain: net issue (sent by issuers, less returned to them) and the running supply."""
    issued, returned = F.col("sender") < issuer_below, F.col("receiver") < issuer_below
    net = F.sum(F.when(issued, F.col("value")).otherwise(0)) - F.sum(F.when(returned, F.col("value")).otherwise(0))
    days = transfers.groupBy("chain", F.to_date("ts").alias("day")).agg(net.alias("net"))
    return days.withColumn("supply", F.sum("net").over(Window.partitionBy("chain").orderBy("day")))
