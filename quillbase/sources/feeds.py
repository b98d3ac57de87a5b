"""Landed JSON feeds: files of one array or object each, read by Spark's text reader and typed by schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.operators.docs import BODY, OBJECT

# The public feeds' rows, as the exchange names and types them.
SCHEMAS = {
    "candles": "t long, T long, o string, h string, l string, c string, v string",
    "funding": "time long, fundingRate string",
    "book": "levels array<array<struct<px:string>>>",
    "fills": "time long, coin string, side string, dir string, px string, sz string, closedPnl string, fee string, crossed boolean, oid long",
    "cashflows": "time long, delta struct<type:string,usdcValue:string>",
    "orders": "coin string, side string, limitPx string, sz string, oid long, timestamp long, triggerPx string, triggerCondition string, reduceOnly boolean, isTrigger boolean, orderType string",
    "clearinghouse": "marginSummary struct<accountValue:string,totalMarginUsed:string,totalNtlPos:string>, withdrawable string, assetPositions array<struct<position:struct<coin:string,szi:string,entryPx:string,positionValue:string,unrealizedPnl:string,marginUsed:string,liquidationPx:string,leverage:struct<value:int>>>>",
    "documents": f"documentId string, title string, body {BODY}, inlineObjects map<string,{OBJECT}>",
    "portfolio": "window string, accountValueHistory array<struct<ts:string,val:string>>",
}
TIMES = {"candles": "t", "funding": "time", "fills": "time", "cashflows": "time", "orders": "timestamp"}


def read_feed(spark: SparkSession, folder: str, feed: str) -> DataFrame:
    """(feed, file, body): the rows of all files of a feed as JSON texts, from any folder that Spark can read.

    An object is one row; a file is parsed whole, by the task that reads it. A file that is no JSON gives one null body.
    """
    files = spark.read.option("wholetext", True).text(folder, pathGlobFilter=f"{feed}*.json").select("value", F.col("_metadata.file_name").alias("file"))
    held = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    return files.select(F.lit(feed).alias("feed"), "file", F.explode_outer(F.from_json(held, "array<string>")).alias("body"))


def typed(rows: DataFrame, feed: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """A feed's rows in the columns of its schema, of times from ``from_ms`` to before ``to_ms``; rows without a time fall out of a range."""
    out = rows.select("file", F.from_json("body", SCHEMAS[feed]).alias("r")).select("file", "r.*")
    time = TIMES.get(feed)
    if time and from_ms is not None:
        out = out.where(F.col(time) >= from_ms)
    return out.where(F.col(time) < to_ms) if time and to_ms is not None else out
