"""Rule-based signals over every hour: funding settlement, top of book, gates and their reasons."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbase.functions import untyped
from quillbase.functions.expr import HOUR_MS, finite_number, floor_hour, iso_ms, not_finite, spread_bps
from quillbase.operators.timeseries import dollar_volume, with_window_reasons


@dataclass(frozen=True)
class Rules:
    """Fixed values of the rule; ``EPSILON`` keeps a return of exactly the bound out."""

    min_return: float = 0.03
    live_return: float = 0.05
    strong_return: float = 0.05
    min_funding: float = 0.00002
    min_day_volume: float = 1_000_000
    max_spread_bps: float = 5
    max_age_ms: int = 1_800_000
    band_low: float = 0.985
    band_high: float = 1.01
    grace_ms: int = 120_000
    base_fraction: float = 0.0
    strong_fraction: float = 0.2


EPSILON = 1e-12
# Where a strategy document has each number.
MANIFEST = {
    "min_return": "rule.minReturnExclusive", "live_return": "rule.liveEntryMinReturnExclusive", "strong_return": "risk.strongReturnExclusive", "min_funding": "rule.minFundingRate", "min_day_volume": "rule.minDayVolumeUsd",
    "max_spread_bps": "rule.maxSpreadBps", "max_age_ms": "rule.maxSignalAgeMs", "band_low": "rule.minLiveVsSignal", "band_high": "rule.maxLiveVsSignal", "grace_ms": "schedule.fundingSettlementGraceMs",
    "base_fraction": "risk.baseAccountRiskFraction", "strong_fraction": "risk.strongAccountRiskFraction",
}
# The reasons that a signal may give, here and in ``timeseries``.
NO_FUNDING = "post-signal funding settlement is missing"
NO_BOOK = "top of book is missing or invalid"


def settlements(funding: DataFrame) -> DataFrame:
    """By series and hour: how many settlements, and time and rate of the first. Rows without a time are left out."""
    timed = funding.where(F.col("time").isNotNull())
    first = F.min(F.struct("time", "rate"))
    return timed.groupBy("series", floor_hour(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("n"), first.alias("s")).select("series", "hour", "n", "s.time", "s.rate")


def funding_error(n: Column, time: Column, rate: Column, start: Column, grace_ms: Column | int) -> Column:
    """Why the settlement after a candle can't be used, null if it can."""
    end = start + HOUR_MS - 1
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, NO_FUNDING)
        .when(n > 1, "duplicate post-signal funding settlements")
        .when((time <= end) | (time > end + grace_ms), "post-signal funding settlement timestamp is not immediate")
        .when(not_finite(rate), "post-signal funding settlement is not finite")
    )


def _with_settlement(candles: DataFrame, funding: DataFrame) -> DataFrame:
    """Each candle with count, time and rate of the settlements in the hour after it, as ``_n``, ``_time`` and ``_rate``."""
    found = settlements(funding).select(F.col("series").alias("_s"), (F.col("hour") - HOUR_MS).alias("_t"), F.col("n").alias("_n"), F.col("time").alias("_time"), F.col("rate").alias("_rate"))
    return candles.join(found, (F.col("series") == F.col("_s")) & (F.col("t") == F.col("_t")), "left").drop("_s", "_t")


def judge_settlement(rows: DataFrame, grace_ms: Column | int) -> DataFrame:
    """Candles with count, time and rate of their settlements as ``_n``, ``_time`` and ``_rate``, judged: ``funding_rate``, ``funding_time``, ``funding_error``."""
    out = rows.withColumn("funding_error", funding_error(F.col("_n"), F.col("_time"), F.col("_rate"), F.col("t"), grace_ms))
    good = F.col("funding_error").isNull()
    return out.withColumns({"funding_rate": F.when(good, F.col("_rate")), "funding_time": F.when(good, F.col("_time"))}).drop("_n", "_time", "_rate")


def match_funding(candles: DataFrame, funding: DataFrame, grace_ms: int = Rules.grace_ms) -> DataFrame:
    """Each candle with the one settlement in the hour after it: ``funding_rate``, ``funding_time``, ``funding_error``."""
    return judge_settlement(_with_settlement(candles, funding), grace_ms)


def best_prices(book: Column) -> tuple[Column, Column]:
    """Best bid and ask of a book record whose ``levels`` are [bids, asks] of {px: text}; null where a level or number is missing."""
    at = lambda side: finite_number(F.get(F.get(book["levels"], F.lit(side)), F.lit(0))["px"])
    return at(0), at(1)


def top_of_book(bid: Column, ask: Column) -> Column:
    """Struct bid, ask, mid, spread_bps, error: all null but the error unless 0 < bid < ask."""
    sound = F.coalesce((bid > 0) & (ask > bid), F.lit(False))
    when = lambda x: F.when(sound, x)
    return F.struct(when(bid).alias("bid"), when(ask).alias("ask"), when((bid + ask) / 2).alias("mid"), when(spread_bps(bid, ask)).alias("spread_bps"), F.when(~sound, NO_BOOK).alias("error"))


def failed(*gates: tuple[Column, Column | str]) -> Column:
    """Reasons of the gates that are not true (null counts as not true), in order, each once."""
    told = [F.when(~F.coalesce(p, F.lit(False)), F.lit(r) if isinstance(r, str) else r) for p, r in gates]
    return F.array_distinct(F.array_compact(F.array(*told)))


def _windows(candles: DataFrame, now_ms: Column) -> DataFrame:
    """Each candle with what it and those before it in its series say; only windows over a series by time."""
    last = Window.partitionBy("series").orderBy("t")
    held = lambda x: F.when(F.col("sound"), x)
    rows = with_window_reasons(candles.withColumn("now", now_ms), F.col("now"), "data_reasons").withColumn("sound", F.size("data_reasons") == 0)
    rows = rows.withColumns({"_before": F.lag("c", 6).over(last), "_volume": F.sum(dollar_volume()).over(last.rowsBetween(-23, 0))})
    rows = rows.withColumns({"r6": held(F.try_divide(F.col("c"), F.col("_before")) - 1), "day_volume": held(F.col("_volume")), "age_ms": held(F.col("now") - F.col("t_end"))})
    return rows.drop("_before", "_volume")


def _with_quotes(rows: DataFrame, quotes: DataFrame, *on: str) -> DataFrame:
    """Candles with the top of book of their quotes, which are found by the columns ``on``."""
    own = quotes.select(*(F.col(c).alias(f"_q_{c}") for c in on), top_of_book(F.col("bid"), F.col("ask")).alias("book"))
    rows = rows.join(own, [F.col(c) == F.col(f"_q_{c}") for c in on], "left").drop(*(f"_q_{c}" for c in on))
    rows = rows.withColumn("book_error", F.coalesce(F.when(F.col("book").isNull(), NO_BOOK), F.col("book")["error"]))
    return rows.withColumn("live_vs_signal", F.when(F.col("sound") & (F.col("c") > 0), F.col("book")["mid"] / F.col("c")))


def _facts(candles: DataFrame, funding: DataFrame, books: DataFrame, now_ms: Column) -> DataFrame:
    """What a rule is judged by, a row a candle: nothing here depends on the rule."""
    return _with_quotes(_with_settlement(_windows(candles, now_ms), funding), books, "series", "t")


def evaluate(candles: DataFrame, funding: DataFrame, books: DataFrame, now_ms: Column, rules: Rules = Rules()) -> DataFrame:
    """One row per candle, judged at ``now_ms`` (an expression over the candle): the gates of both streams and their inputs.

    candles: series, t, t_end, o, h, l, c, v. funding: series, time, rate. books: series, t, bid, ask. Where
    the last 25 candles are unsound, only reasons, book and times are set; ``candle`` is the start of the one judged. Partitioned by series throughout.
    """
    given = {f.name: F.lit(getattr(rules, f.name)) for f in fields(Rules)}
    return _judged(_facts(candles, funding, books, now_ms), given)


def evaluate_last(candles: DataFrame, funding: DataFrame, quotes: DataFrame, now_ms: Column, rules: Rules = Rules()) -> DataFrame:
    """``evaluate`` of each series' last candle only: one row a series. quotes: series, bid, ask, at most one a series.

    Only the windows see all candles. Of candles that share the last start, it is the one that is judged with all others.
    """
    given = {f.name: F.lit(getattr(rules, f.name)) for f in fields(Rules)}
    # in the order of the windows below, so that the rows are sorted once
    later = F.lead(F.lit(True)).over(Window.partitionBy("series").orderBy("t"))
    rows = _windows(candles, now_ms).withColumn("_later", later).where("_later IS NULL").drop("_later")
    return _judged(_with_quotes(_with_settlement(rows, funding), quotes, "series"), given)


def evaluate_many(candles: DataFrame, funding: DataFrame, books: DataFrame, now_ms: Column, manifest: DataFrame) -> DataFrame:
    """``evaluate`` for every strategy in one pass: a row per candle and strategy of its series, with ``strategy`` and ``version``.

    ``manifest``: strategy, series, version, valid_from (ms) and the fields of ``Rules``, a row a version. Each signal is judged by the version
    in force at its ``now``; before a strategy's first version it has no signal. A number that a version lacks fails its gates. What
    the rules are judged by is computed once for all; the versions of a strategy come as one small array.
    """
    names = [f.name for f in fields(Rules)]
    versions = F.sort_array(F.collect_list(F.struct("valid_from", "version", *names)))
    sets = manifest.where("valid_from IS NOT NULL").groupBy(F.col("series").alias("_s"), "strategy").agg(versions.alias("_versions"))
    rows = _facts(candles, funding, books, now_ms)
    rows = rows.join(sets, F.col("series") == F.col("_s")).drop("_s")
    rows = rows.withColumn("_rule", F.try_element_at(F.filter("_versions", lambda v: v["valid_from"] <= F.col("now")), F.lit(-1))).where("_rule IS NOT NULL").drop("_versions")
    return _judged(rows, {n: F.col("_rule")[n] for n in names}, F.col("strategy"), F.col("_rule")["version"].alias("version"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Strategy documents (JSON, one or a list a file) as rows for ``evaluate_many``; a document says from when it holds as ``validFromMs``.

    Fields that no rule has may be there; a number that is missing or none is null.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("held"))
    listed = untyped.children(files.where(untyped.kind(F.col("held")) == "array"), "held").select(F.col("value").alias("doc"))
    docs = files.where(untyped.kind(F.col("held")) == "object").select(F.col("held").alias("doc")).unionByName(listed)
    number = lambda path: finite_number(untyped.text(F.col("doc"), path))
    kind = {f.name: "long" if isinstance(f.default, int) and f.name.endswith("_ms") else "double" for f in fields(Rules)}
    return docs.select(
        untyped.text(F.col("doc"), "$.id").alias("strategy"), untyped.text(F.col("doc"), "$.symbol").alias("series"), untyped.text(F.col("doc"), "$.version").alias("version"),
        number("$.validFromMs").cast("long").alias("valid_from"), *(number(f"$.{p}").cast(kind[n]).alias(n) for n, p in MANIFEST.items()),
    )


def _judged(rows: DataFrame, rule: dict[str, Column], *more: Column) -> DataFrame:
    """Gates, reasons and tier of rows of ``_facts`` by a rule's columns."""
    rows = judge_settlement(rows, rule["grace_ms"])
    book = lambda k: F.col("book")[k]
    held = lambda x: F.when(F.col("sound"), x)
    said = lambda text, *xs: F.format_string(text, *xs)
    paid = (F.col("funding_error").isNull(), F.col("funding_error"))
    enough = (F.col("funding_rate") >= rule["min_funding"], said("post-signal funding settlement is below %.1f bps", rule["min_funding"] * 10_000))
    over = lambda bound, use: (F.col("r6") > bound + EPSILON, said(f"completed six-hour return is not above %.0f%% for {use}", bound * 100))
    regime = failed(paid, over(rule["min_return"], "the regime stream"), enough)
    market = failed(
        paid,
        over(rule["live_return"], "live entry"),
        enough,
        (F.col("day_volume") >= rule["min_day_volume"], said("trailing dollar volume is below $%.0fm", rule["min_day_volume"] / 1e6)),
        (F.col("book_error").isNull(), F.col("book_error")),
        (book("spread_bps") <= rule["max_spread_bps"], F.concat(F.lit("top spread exceeds "), F.regexp_replace(rule["max_spread_bps"].cast("double").cast("string"), r"\.0$", ""), F.lit(" bps"))),
        (F.col("age_ms").between(0, rule["max_age_ms"]), "completed signal candle is stale"),
        (F.col("live_vs_signal").between(rule["band_low"], rule["band_high"]), "live price moved outside the frozen entry band"),
    )
    short = F.array_distinct(F.array_compact(F.concat("data_reasons", F.array("book_error"))))
    rows = rows.withColumns({"regime_blockers": F.when(F.col("sound"), regime).otherwise(F.col("data_reasons")), "blockers": F.when(F.col("sound"), market).otherwise(short)})
    strong = F.col("r6") > rule["strong_return"] + EPSILON
    passes = F.size("regime_blockers") == 0
    return rows.select(
        "series", *more,
        (F.col("sound") & F.col("funding_error").isNull() & F.col("book_error").isNull()).alias("data_complete"),
        passes.alias("regime_passes"), "regime_blockers", (F.size("blockers") == 0).alias("market_passes"), "blockers",
        iso_ms(F.col("now")).alias("observed_at"),
        held(F.col("t")).alias("signal_start"), held(F.col("t_end")).alias("signal_end"),
        (floor_hour(F.col("now")) + HOUR_MS).alias("next_close"),
        held(F.col("c")).alias("signal_close"), "r6", (F.col("r6") * 100).alias("r6_pct"),
        held(F.col("funding_rate")).alias("funding_rate"), held(F.col("funding_rate") * 10_000).alias("funding_bps"), "day_volume",
        book("bid").alias("bid"), book("ask").alias("ask"), book("mid").alias("mid"), book("spread_bps").alias("spread_bps"),
        "live_vs_signal", "age_ms",
        held(F.when(strong, "strong_r6").when(passes, "virtual_regime_only").otherwise("not_qualified")).alias("risk_tier"),
        held(F.when(strong, rule["strong_fraction"]).otherwise(rule["base_fraction"])).alias("max_risk_fraction"),
        "now", F.col("t").alias("candle"),
    )


def merge_source_errors(signals: DataFrame, missing: Column) -> DataFrame:
    """Adds "<name> source unavailable" for each name in the array ``missing``, and judges the gates again."""
    named = lambda names: F.transform(F.filter(missing, lambda n: n.isin(*names)), lambda n: F.concat(n, F.lit(" source unavailable")))
    out = signals.withColumns({"blockers": F.array_union("blockers", named(["candles", "funding", "book"])), "regime_blockers": F.array_union("regime_blockers", named(["candles", "funding"]))})
    complete = F.col("data_complete") & ~F.arrays_overlap(missing, F.array(F.lit("candles"), F.lit("funding"), F.lit("book")))
    return out.withColumns({"market_passes": F.size("blockers") == 0, "regime_passes": F.size("regime_blockers") == 0, "data_complete": complete})


def gate_rows(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Seven rows per signal: gate, observed, required and whether it holds."""
    gate = lambda name, seen, need, ok: F.struct(F.lit(name).alias("gate"), seen.cast("double").alias("observed"), F.lit(float(need)).alias("required"), F.coalesce(ok, F.lit(False)).alias("passes"))
    gates = F.array(
        gate("regime return", F.col("r6"), rules.min_return, F.col("r6") > rules.min_return + EPSILON),
        gate("live return", F.col("r6"), rules.live_return, F.col("r6") > rules.live_return + EPSILON),
        gate("funding", F.col("funding_rate"), rules.min_funding, F.col("funding_rate") >= rules.min_funding),
        gate("day volume", F.col("day_volume"), rules.min_day_volume, F.col("day_volume") >= rules.min_day_volume),
        gate("spread", F.col("spread_bps"), rules.max_spread_bps, F.col("spread_bps") <= rules.max_spread_bps),
        gate("age", F.col("age_ms"), rules.max_age_ms, F.col("age_ms").between(0, rules.max_age_ms)),
        gate("price band", F.col("live_vs_signal"), rules.band_high, F.col("live_vs_signal").between(rules.band_low, rules.band_high)),
    )
    return signals.select("series", "now", F.inline(gates))
