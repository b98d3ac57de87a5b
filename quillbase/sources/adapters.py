"""Domain inputs as projections of the stored tables: transfers, trades, candles, fills, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.sources.tables import load


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, token, sender, receiver, value (decimal), ts."""
    item, order = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    return item.join(order, item.l_orderkey == order.o_orderkey).select(
        F.col("o_orderpriority").alias("chain"),
        F.col("l_returnflag").alias("token"),
        F.col("l_suppkey").alias("sender"),
        F.col("l_partkey").alias("receiver"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
        F.col("l_shipdate").alias("ts"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bought, sold, project, pair, amount (decimal), ts."""
    item, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return item.join(part, item.l_partkey == part.p_partkey).select(
        F.col("l_returnflag").alias("bought"),
        F.col("l_linestatus").alias("sold"),
        F.col("p_brand").alias("project"),
        F.col("p_type").alias("pair"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("l_shipdate").alias("ts"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a value series: ts, id, kind, user, value, props."""
    return load(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"), "value", "props")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, oid, coin, side, px, sz, closed_pnl, fee, crossed."""
    return load(spark, sf_dir, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.col("event_id").alias("oid"),
        F.concat(F.col("event_type"), F.lit("-"), F.pmod("user_id", F.lit(10)).cast("string")).alias("coin"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "B").otherwise("A").alias("side"),
        F.col("value").alias("px"),
        F.lit(1.0).alias("sz"),
        F.col("value").cast("decimal(18,4)").alias("closed_pnl"),
        (F.col("value") * 0.01).cast("decimal(18,4)").alias("fee"),
        (F.pmod("event_id", F.lit(3)) == 0).alias("crossed"),
    )


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph of all line items, suppliers to parts, a link for each; a part's links are those of the supplier with its number."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
