"""Balances, holders, largest holders and activity of token ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.operators.stored import Scratch

GROUP = ("chain", "token")
SUMMARY = ("holders", "active_7d", "transfers_7d", "volume_7d", "active_30d", "transfers_30d", "volume_30d")


def at(as_of: str) -> Column:
    """A point in time without a zone, as the tables have it, so that filters reach the scan."""
    return F.expr(f"timestamp_ntz'{as_of}'")


def since(as_of: str, days: int) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}' - INTERVAL '{days}' DAY")


def accounts(transfers: DataFrame, as_of: str) -> DataFrame:
    """One row per (chain, token, address): balance, when it last sent and received, and what it sent lately.

    Each transfer becomes two entries in one pass, and one shuffle serves balances as well as activity.
    """
    entry = lambda address, amount, sent: F.struct(F.col(address).alias("address"), amount.alias("amount"), F.lit(sent).alias("sent"))
    both = F.array(entry("receiver", F.col("value"), False), entry("sender", -F.col("value"), True))
    rows = transfers.where(F.col("ts") <= at(as_of)).select(*GROUP, "ts", F.explode(both).alias("e")).select(*GROUP, "ts", "e.*")
    recent = lambda days: F.col("sent") & (F.col("ts") > since(as_of, days))
    return rows.groupBy(*GROUP, "address").agg(
        F.sum("amount").alias("balance"),
        F.max(F.when(F.col("sent"), F.col("ts"))).alias("last_sent"),
        F.max(F.when(~F.col("sent"), F.col("ts"))).alias("last_received"),
        *(F.count_if(recent(d)).alias(f"transfers_{d}d") for d in (7, 30)),
        *(F.sum(F.when(recent(d), -F.col("amount"))).alias(f"volume_{d}d") for d in (7, 30)),
    )


def balances(transfers: DataFrame, as_of: str) -> DataFrame:
    """Positive balances by (chain, token, address)."""
    return accounts(transfers, as_of).where("balance > 0").select(*GROUP, "address", "balance")


def holders(transfers: DataFrame, as_of: str) -> DataFrame:
    """Holders and their total balance by (chain, token)."""
    return balances(transfers, as_of).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("holders"), F.sum("balance").cast("double").alias("total"))


def summary(of: DataFrame, as_of: str) -> DataFrame:
    """By (token, chain): holders, and for 7 and 30 days active senders plus active receivers, transfers, volume in millions.

    Groups without a holder are left out, however active.
    """
    active = lambda d: F.count_if(F.col("last_sent") > since(as_of, d)) + F.count_if(F.col("last_received") > since(as_of, d))
    columns = [F.count_if(F.col("balance") > 0).alias("holders")]
    for d in (7, 30):
        volume = F.coalesce(F.sum(f"volume_{d}d").cast("double") / 1e6, F.lit(0.0))
        columns += [active(d).alias(f"active_{d}d"), F.sum(f"transfers_{d}d").alias(f"transfers_{d}d"), F.round(volume, 6).alias(f"volume_{d}d")]
    return of.groupBy("token", "chain").agg(*columns).where("holders > 0")


def largest(of: DataFrame, top: int = 10) -> DataFrame:
    """The largest holders of each group: address, balance in millions, share of the group's positive balances, rank. Ties by address."""
    held = of.where("balance > 0")
    group = Window.partitionBy(*GROUP)
    ranked = held.select(*GROUP, "address", "balance", F.row_number().over(group.orderBy(F.col("balance").desc(), "address")).alias("rank"))
    # a filter on the rank alone lets Spark keep ``top`` rows of a group before the shuffle; totals are a small table
    totals = held.groupBy(*GROUP).agg(F.sum("balance").alias("total"))
    return ranked.where(F.col("rank") <= top).join(totals, list(GROUP)).select(
        "token", "chain", F.col("address").cast("string").alias("address"),
        (F.col("balance").cast("double") / 1e6).alias("balance"),
        F.round(F.col("balance").cast("double") / F.col("total").cast("double") * 100, 6).alias("pct"),
        F.col("rank").cast("long").alias("rank"),
    )


def combined(transfers: DataFrame, as_of: str, top: int = 10) -> DataFrame:
    """Summaries (rank null) and largest holders (rank set) as one row set. Accounts are written once, and both are read from that table."""
    of = Scratch(transfers.sparkSession).keep(accounts(transfers, as_of), last=True)
    return summary(of, as_of).unionByName(largest(of, top), allowMissingColumns=True)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and largest holders of ``combined``, each without the other's columns."""
    return rows.where("rank IS NULL").drop("address", "balance", "pct", "rank"), rows.where("rank IS NOT NULL").drop(*SUMMARY)
