"""Landed responses of feeds: one row a response, laid out by feed and day, so that a range of times opens only its own days' files.

A response is kept as it came: JSON text, or why there is none. What is missing or broken is a row like any
other, so whoever reads a response must look at its error first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.functions import untyped

#: ``key``: the account or symbol; ``time``: when it was asked, in epoch milliseconds.
SCHEMA = "key string, time long, body string, error string"
DAY_MS = 86_400_000
ABSENT, BROKEN = "response is missing", "response is not JSON"


def day(ms: Column) -> Column:
    """The number of the day since 1970 of a time in milliseconds; null for null."""
    return F.floor(ms / DAY_MS).cast("int")


def land(responses: DataFrame, folder: str) -> None:
    """Add rows (feed, key, time, body, error) to a folder, by feed and day of ``time``. Rows without a time go to a day of their own, which no range reads."""
    rows = responses.select("feed", day(F.col("time")).alias("day"), *(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")))
    rows.write.mode("append").partitionBy("feed", "day").parquet(folder)


def read_landed(spark: SparkSession, folder: str, feeds: tuple[str, ...], from_ms: int | None = None, to_ms: int | None = None, least: Column | None = None) -> DataFrame:
    """(feed, day, key, time, body, error) of the given feeds, of times from ``from_ms`` to before ``to_ms``.

    The range becomes a filter of partitions, so files of other days aren't opened. ``least`` is a lower bound that only the
    run knows, such as the least cutoff of a table of accounts as a scalar subquery; it prunes days as well.
    """
    rows = spark.read.schema(f"{SCHEMA}, feed string, day int").parquet(folder).where(F.col("feed").isin(*feeds))
    if from_ms is not None:
        rows = rows.where((F.col("day") >= from_ms // DAY_MS) & (F.col("time") >= from_ms))
    if to_ms is not None:
        rows = rows.where((F.col("day") <= (to_ms - 1) // DAY_MS) & (F.col("time") < to_ms))
    if least is not None:
        rows = rows.where((F.col("day") >= day(least)) & (F.col("time") >= least))
    return rows


def latest_by_key(responses: DataFrame, keys: DataFrame, feeds: tuple[str, ...]) -> DataFrame:
    """One row per key of ``keys`` (key): for each feed a struct (value VARIANT, error, body), the last response by time.

    A feed that has no row says ``ABSENT``, and a body that isn't JSON ``BROKEN``; a response with an error has neither value nor body. Of responses of one
    time the one with an error wins. Keys of ``responses`` that ``keys`` lacks are left out.
    """
    one = lambda f: F.max(F.when(F.col("feed") == f, F.struct("time", F.col("error").isNotNull().alias("bad"), "error", "body"))).alias(f)
    wide = responses.where(F.col("time").isNotNull()).groupBy(F.col("key").alias("_key")).agg(*(one(f) for f in feeds))
    out = keys.select("key").distinct().join(wide, F.col("key") == F.col("_key"), "left").drop("_key")

    # a column of its own, so that each body is parsed once
    parsed = out.select("key", *feeds, *(F.try_parse_json(F.col(f)["body"]).alias(f"_{f}") for f in feeds))

    def judged(f: str) -> Column:
        value = F.col(f"_{f}")
        error = F.when(F.col(f).isNull(), ABSENT).when(F.col(f)["bad"], F.col(f)["error"]).when(value.isNull(), BROKEN)
        return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"), F.when(error.isNull(), F.col(f)["body"]).alias("body")).alias(f)

    return parsed.select("key", *(judged(f) for f in feeds))


def source_errors(row_of: dict[str, Column]) -> Column:
    """Map of feed to error, of the feeds that have one, in their order."""
    told = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(name).alias("key"), c.alias("value"))) for name, c in row_of.items())))
    return F.map_from_entries(told)


def required_error(clearinghouse: Column, orders: Column) -> Column:
    """Why no record may be made: the account's state or its orders are unavailable or malformed; null if they are sound."""
    account, listed = clearinghouse["value"], orders["value"]
    unavailable = ~F.coalesce(untyped.truthy(account), F.lit(False)) | ~untyped.is_array(listed)
    worth = F.try_variant_get(account, "$.marginSummary.accountValue", "double")
    finite = worth.isNotNull() & ~F.isnan(worth) & (F.abs(worth) != float("inf"))
    held = F.try_variant_get(account, "$.assetPositions", "array<variant>").isNotNull()
    # What the reader of a record is told.
    return F.when(unavailable, "required public account state is unavailable").when(~F.coalesce(finite & held, F.lit(False)), "required public account state is malformed")
