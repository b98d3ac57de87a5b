"""Supply reports over (chain, day, supply): leading chains, two assets side by side, ranks, and what drove a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.operators.timeseries import period_delta


def chain_trend(days: DataFrame, top: int = 3) -> DataFrame:
    """(day, chain, supply) of the ``top`` chains by their latest supply; ties go by name. Pivot on chain for a chart."""
    last = days.groupBy("chain").agg(F.max_by("supply", "day").alias("last"))
    leading = last.orderBy(F.desc("last"), "chain").limit(top).select("chain")
    return days.join(F.broadcast(leading), "chain", "left_semi").select("day", "chain", "supply")  # ``top`` names


def asset_mix(days: DataFrame, asset: str, value: str, first: str, second: str) -> DataFrame:
    """By day: the value of two assets and the share of the first in per cent; a missing side counts as zero, and no total as null."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col(asset) == name, F.col(value))), F.lit(0))
    out = days.where(F.col(asset).isin(first, second)).groupBy("day").agg(of(first).alias("first"), of(second).alias("second"))
    total = F.col("first") + F.col("second")
    return out.withColumn("share_pct", F.round(F.try_divide(F.col("first").cast("double"), total.cast("double")) * 100, 6))


def peer_rank(days: DataFrame, n: int, combined: str = "combined") -> DataFrame:
    """Growth of each chain's supply over its last ``n`` days in per cent, and of all chains together, ranked; nulls last, ties by name."""
    order = Window.partitionBy("chain").orderBy(F.desc("day"))
    ends = days.withColumn("k", F.row_number().over(order)).where(F.col("k").isin(1, n + 1))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("supply")))
    each = ends.groupBy("chain").agg(at(1).alias("last"), at(n + 1).alias("earlier"))
    both = each.agg(F.lit(combined).alias("chain"), F.sum("last").alias("last"), F.sum("earlier").alias("earlier"))
    growth = F.round(F.try_divide(F.col("last").cast("double"), F.col("earlier").cast("double")) * 100 - 100, 6)
    out = each.unionByName(both).withColumn("growth_pct", growth)
    return out.select("chain", "growth_pct", F.row_number().over(Window.orderBy(F.desc_nulls_last("growth_pct"), "chain")).alias("rank"))  # a row a chain


def waterfall(days: DataFrame, n: int, total: str = "total") -> DataFrame:
    """What each chain added to the supply over its last ``n`` days, and the total; a shorter history counts from zero."""
    last = Window.partitionBy("chain").orderBy(F.desc("day"))
    moved = period_delta(days, "chain", "supply", n).withColumn("k", F.row_number().over(last)).where("k = 1")
    each = moved.select("chain", F.coalesce(f"delta_{n}", "supply").alias("delta"))
    return each.unionByName(each.agg(F.lit(total).alias("chain"), F.sum("delta").alias("delta")))


def window_count(row_7d: Column, row_30d: Column, older: Column, days: int) -> Column:
    """Trades of the last 7 or 30 days; the longer window falls back to the older field of documents that lack it, then to zero."""
    return F.coalesce(row_7d, F.lit(0)) if days == 7 else F.coalesce(row_30d, older, F.lit(0))
