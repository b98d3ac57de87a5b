"""Hourly candles and ordered-series measures, each within a series (a symbol, an account, a chain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.functions.expr import HOUR_MS, not_finite, percent_change

NEEDED = 25


def hourly_candles(points: DataFrame, series: str = "kind") -> DataFrame:
    """By series and hour: t and t_end (epoch ms), open, high, low, close, count as volume. Ties in time go by id."""
    order = F.struct("ts", "id")
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts")).cast("timestamp"))
    return points.groupBy(F.col(series).alias("series"), hour.alias("t")).agg(
        F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count(F.lit(1)).cast("double").alias("v")
    ).withColumn("t_end", F.col("t") + HOUR_MS - 1)


def completed(candles: DataFrame, now_ms: Column | int) -> DataFrame:
    """Candles that ended before ``now_ms``; a missing end counts as the start, a missing start as incomplete."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return candles.where(F.col("t").isNotNull() & (F.coalesce("t_end", "t") < now))


def _by_time() -> Window:
    return Window.partitionBy("series").orderBy("t")


def with_lag_return(candles: DataFrame, lag: int = 6) -> DataFrame:
    """``r``: close over the close ``lag`` rows before, less one; null without such a row or with a zero."""
    return candles.withColumn("r", F.try_divide(F.col("c"), F.lag("c", lag).over(_by_time())) - 1)


def dollar_volume(row: Column | None = None) -> Column:
    """Mean of open, high, low and close times volume."""
    of = (lambda k: row[k]) if row is not None else F.col
    return (of("o") + of("h") + of("l") + of("c")) / 4 * of("v")


def with_trailing_volume(candles: DataFrame, rows: int = 24) -> DataFrame:
    """``day_volume``: dollar volume of the last ``rows`` rows, the current one included."""
    return candles.withColumn("day_volume", F.sum(dollar_volume()).over(_by_time().rowsBetween(1 - rows, 0)))


def with_gaps(candles: DataFrame) -> DataFrame:
    """``gap``: the row doesn't start an hour after the one before; false for the first."""
    return candles.withColumn("gap", F.coalesce(F.lag("t").over(_by_time()) + HOUR_MS != F.col("t"), F.lit(False)))


# What may be wrong with one candle, in order, and with the last ``NEEDED`` of a series.
ROW_REASONS = ("hourly candle is malformed", "hourly candle timestamps are misaligned", "hourly candle OHLCV is invalid")
TOO_FEW, GAPPED, STALE = "fewer than 25 completed hourly candles", "hourly candles are duplicated or gapped", "latest completed hourly candle is stale"


def row_faults() -> tuple[Column, Column, Column]:
    """Whether ``ROW_REASONS`` hold of a candle; one that is malformed has no other fault."""
    t, o, h, l, c, v = map(F.col, "tohlcv")
    end = F.coalesce("t_end", t + HOUR_MS - 1)
    missing = F.lit(False)
    for x in (t, o, h, l, c, v):
        missing = missing | not_finite(x)
    crooked = (F.pmod(t, F.lit(HOUR_MS)) != 0) | (end != t + HOUR_MS - 1)
    unsound = (l <= 0) | (v < 0) | (l > F.least(o, c)) | (F.greatest(o, c) > h)
    sure = lambda p: F.coalesce(p, F.lit(False))
    return missing, sure(~missing & crooked), sure(~missing & unsound)


def with_window_reasons(candles: DataFrame, now_ms: Column, name: str = "reasons") -> DataFrame:
    """``name``: what is wrong with the last 25 candles of the series up to each one, as seen at ``now_ms``; each reason once, a candle's in the order of
    the first candle that gives it. Only windows over the series by time: flags and first places, no rows are gathered."""
    by, last = _by_time(), _by_time().rowsBetween(1 - NEEDED, 0)
    faults = dict(zip(("_f0", "_f1", "_f2"), row_faults(), strict=True))
    step = F.coalesce(F.col("t") != F.lag("t").over(by) + HOUR_MS, F.lit(False))
    rows = candles.withColumns({**faults, "_place": F.row_number().over(by), "_step": step})
    firsts = {f"{f}_at": F.min(F.when(F.col(f), F.col("_place"))).over(last) for f in faults}
    rows = rows.withColumns({**firsts, "_n": F.count(F.lit(1)).over(last), "_gap": F.max("_step").over(by.rowsBetween(2 - NEEDED, 0))})
    each = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"_f{k}_at").isNotNull(), F.struct(F.col(f"_f{k}_at").alias("at"), F.lit(k).alias("k"), F.lit(r).alias("said"))) for k, r in enumerate(ROW_REASONS)))))
    sound = F.col("_f0_at").isNull()
    late = F.col("t") != now_ms - F.pmod(now_ms, F.lit(HOUR_MS)) - HOUR_MS
    whole = F.array_compact(F.array(F.when(sound & F.col("_gap"), GAPPED), F.when(sound & late, STALE)))
    reasons = F.when(F.col("_n") < NEEDED, F.array(F.lit(TOO_FEW))).otherwise(F.concat(F.transform(each, lambda x: x["said"]), whole))
    return rows.withColumn(name, reasons).drop(*faults, *firsts, "_place", "_step", "_n", "_gap")



def drawdown(points: DataFrame, series: str, *order: str) -> DataFrame:
    """Points above 1 with the running peak and the drawdown from it in per cent; ``order`` begins with a timestamp.

    A series may be long: each of its days is a partition of its own, and what came before a day enters as
    the running maximum of the days' peaks, a row a day.
    """
    held = points.where("value > 1").withColumn("_day", F.date_trunc("day", F.col(order[0])))
    earlier = Window.partitionBy("_series").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = held.groupBy(F.col(series).alias("_series"), F.col("_day").alias("_d")).agg(F.max("value").alias("_top"))
    days = days.withColumn("_earlier", F.max("_top").over(earlier)).drop("_top")
    run = Window.partitionBy(series, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = held.join(days, F.col(series).eqNullSafe(F.col("_series")) & F.col("_day").eqNullSafe(F.col("_d")))
    out = out.withColumn("peak", F.greatest(F.max("value").over(run), "_earlier")).drop("_day", "_series", "_d", "_earlier")
    return out.withColumn("drawdown_pct", F.round((F.col("value") / F.col("peak") - 1) * 100, 6))


def period_result(points: DataFrame, series: str) -> DataFrame:
    """First and last value of each series, their difference, the change in per cent, and whether it didn't fall."""
    order = F.struct("ts", "id")
    ends = points.where("value > 1").groupBy(F.col(series).alias("series")).agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    hours = (F.unix_millis(F.col("end").cast("timestamp")) - F.unix_millis(F.col("start").cast("timestamp"))) / HOUR_MS
    return ends.select(
        "series", "first", "last",
        F.round(F.col("last") - F.col("first"), 6).alias("pnl"),
        F.round(percent_change(F.col("last"), F.col("first")), 6).alias("pct"),
        (F.col("last") >= F.col("first")).alias("rising"),
        F.when(hours > 36, "day").otherwise("hour").alias("unit"),
    )


def period_delta(days: DataFrame, series: str, value: str, *intervals: int) -> DataFrame:
    """``delta_n``: the value less that n rows before, for each n intervals (so n + 1 points)."""
    order = Window.partitionBy(series).orderBy("day")
    return days.withColumns({f"delta_{n}": F.col(value) - F.lag(value, n).over(order) for n in intervals})


def pace(days: DataFrame, series: str, value: str, n: int) -> DataFrame:
    """Change per day over the last n intervals of each series; null for shorter ones."""
    order = Window.partitionBy(series).orderBy(F.desc("day"))
    last = days.withColumn("k", F.row_number().over(order)).where(F.col("k").isin(1, n + 1))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col(value)))
    return last.groupBy(series).agg(((at(1) - at(n + 1)).cast("double") / n).alias("pace"))
