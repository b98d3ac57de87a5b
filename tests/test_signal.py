"""Signal vectors: 25 hourly candles, one settlement, one book."""

import json

import pytest
from pyspark.sql import functions as F

from quillbase.functions.expr import HOUR_MS
from quillbase.operators import signal, timeseries
from quillbase.plans import catalogue

START = 50 * HOUR_MS
NOW = START + HOUR_MS + 60_000


def candles(last=104.0, shift=0, skip=None, **change):
    rows = []
    for i in range(25):
        t = START - 24 * HOUR_MS + shift + i * HOUR_MS
        c = last if i == 24 else 100.0
        row = {"series": "s", "t": t, "t_end": t + HOUR_MS - 1, "o": c, "h": c + 1, "l": c - 1, "c": c, "v": 1000.0}
        if i == 12:
            row |= change
        if i != skip:
            rows.append(row)
    return rows


def run(spark, rows, funding=((START + HOUR_MS, 2e-5),), mid=104.0, bps=2.0, now=NOW):
    c = spark.createDataFrame(rows, "series string, t long, t_end long, o double, h double, l double, c double, v double")
    f = spark.createDataFrame([("s", t, r) for t, r in funding], "series string, time long, rate double")
    b = spark.createDataFrame([("s", r["t"], mid - mid * bps / 20000, mid + mid * bps / 20000) for r in rows] if mid else [], "series string, t long, bid double, ask double")
    c = timeseries.completed(c, now)
    out = signal.evaluate(c, f, b, F.lit(now))
    last = c.agg(F.max("t")).first()[0]
    rows = [r for r in out.withColumn("age", F.lit(last)).collect() if r.signal_start in (last, None)]
    return sorted(rows, key=lambda r: r.signal_start or -1)[-1]


def test_pass_virtual(spark):
    r = run(spark, candles())
    assert r.regime_passes and not r.market_passes and r.risk_tier == "virtual_regime_only" and r.max_risk_fraction == 0.0
    assert r.blockers == ["completed six-hour return is not above 5% for live entry"]


def test_pass_strong(spark):
    r = run(spark, candles(106.0), mid=106.0)
    assert r.regime_passes and r.market_passes and r.data_complete and r.risk_tier == "strong_r6" and r.max_risk_fraction == 0.2


def test_exact_bound_fails(spark):
    r = run(spark, candles(103.0), mid=103.0)
    assert not r.regime_passes and not r.market_passes
    assert any("not above 3%" in b for b in r.regime_blockers)


@pytest.mark.parametrize(
    ("funding", "said"),
    [
        ((), "post-signal funding settlement is missing"),
        (((START + HOUR_MS, 2e-5), (START + HOUR_MS + 5, 2e-5)), "duplicate post-signal funding settlements"),
        (((START + HOUR_MS + 200_000, 2e-5),), "post-signal funding settlement timestamp is not immediate"),
        (((START + HOUR_MS, None),), "post-signal funding settlement is not finite"),
    ],
)
def test_funding(spark, funding, said):
    r = run(spark, candles(), funding=funding)
    assert not r.data_complete and r.blockers[0] == said and r.regime_blockers[0] == said


@pytest.mark.parametrize(("mid", "bps"), [(None, 0), (100.0, 0.0)])
def test_book(spark, mid, bps):
    assert "top of book is missing or invalid" in run(spark, candles(), mid=mid, bps=bps).blockers


@pytest.mark.parametrize(
    ("rows", "said"),
    [
        (candles(shift=-HOUR_MS), ["latest completed hourly candle is stale"]),
        (candles(skip=3), ["fewer than 25 completed hourly candles"]),
        (candles(l=200.0), ["hourly candle OHLCV is invalid"]),
        (candles(c=None), ["hourly candle is malformed"]),
        (candles(t_end=5), ["hourly candle timestamps are misaligned"]),
        (candles(t_end=5, l=200.0), ["hourly candle timestamps are misaligned", "hourly candle OHLCV is invalid"]),
        ([r | ({"v": -1.0} if i == 3 else {"t_end": 7} if i == 9 else {}) for i, r in enumerate(candles(shift=-HOUR_MS))], ["hourly candle OHLCV is invalid", "hourly candle timestamps are misaligned", "latest completed hourly candle is stale"]),
        ([r | ({"c": None} if i == 20 else {"v": -1.0} if i == 22 else {}) for i, r in enumerate(candles(shift=-HOUR_MS))], ["hourly candle is malformed", "hourly candle OHLCV is invalid"]),
    ],
)
def test_unsound(spark, rows, said):
    out = timeseries.with_window_reasons(spark.createDataFrame(rows, "series string, t long, t_end long, o double, h double, l double, c double, v double"), F.lit(NOW))
    assert out.orderBy(F.desc("t")).first().reasons == said


def test_source_errors(spark):
    df = spark.createDataFrame([(["a"], [], True, False, True)], "blockers array<string>, regime_blockers array<string>, regime_passes boolean, market_passes boolean, data_complete boolean")
    r = signal.merge_source_errors(df, F.array(F.lit("book"), F.lit("candles"))).first()
    assert r.blockers == ["a", "book source unavailable", "candles source unavailable"] and r.regime_blockers == ["candles source unavailable"]
    assert not r.data_complete and not r.regime_passes


def test_infinite_numbers_are_malformed(spark):
    inf = float("inf")
    row = spark.createDataFrame([(0, 3_599_999, 1.0, inf, 1.0, 1.0, 1.0)], "t long, t_end long, o double, h double, l double, c double, v double")
    assert tuple(row.select(*(f.alias(f"f{k}") for k, f in enumerate(timeseries.row_faults()))).first()) == (True, False, False)
    paid = spark.createDataFrame([(1, 3_600_001, inf), (1, 3_600_001, -inf), (1, 3_600_001, 0.1)], "n long, time long, rate double")
    said = paid.select(signal.funding_error(F.col("n"), F.col("time"), F.col("rate"), F.lit(0), 120_000).alias("e")).collect()
    assert [r.e for r in said] == ["post-signal funding settlement is not finite"] * 2 + [None]


def test_many_strategies_equal_runs_one_at_a_time(spark, sf_dir, tmp_path):
    candles = catalogue._candles(spark, sf_dir).where("series < 'e'").cache()
    funding = catalogue._funding(spark, sf_dir)
    books = candles.select("series", "t", (F.col("c") * 0.9999).alias("bid"), (F.col("c") * 1.0001).alias("ask"))
    now = F.col("t_end") + 60_001
    change = candles.agg(F.percentile_approx("t", 0.5)).first()[0]
    tight, loose = signal.Rules(), signal.Rules(min_return=-0.5, live_return=0.01, min_funding=0.00001, min_day_volume=1500, max_spread_bps=0.5, grace_ms=600_000, band_high=1.5)
    names = [r.series for r in candles.select("series").distinct().collect()]

    def document(strategy, series, version, since, rules):
        out = {"id": strategy, "symbol": series, "version": version, "validFromMs": since, "unknown": [1]}
        for name, path in signal.MANIFEST.items():
            section, field = path.split(".")
            out.setdefault(section, {})[field] = getattr(rules, name)
        return out

    docs = [document("x", n, "v1", 0, tight) for n in names] + [document("x", n, "v2", change, loose) for n in names] + [document("y", names[0], "w1", change, tight)]
    (tmp_path / "all.json").write_text(json.dumps(docs[1:]))
    (tmp_path / "one.json").write_text(json.dumps(docs[0]))
    got = signal.evaluate_many(candles, funding, books, now, signal.read_manifest(spark, str(tmp_path)))
    columns = [c for c in got.columns if c not in ("strategy", "version")]
    runs = {name: signal.evaluate(candles, funding, books, now, rules).select(columns) for name, rules in (("v1", tight), ("v2", loose), ("w1", tight))}
    want = runs["v1"].where(F.col("now") < change).unionByName(runs["v2"].where(F.col("now") >= change))
    have = got.where("strategy = 'x'").select(columns)
    assert have.count() == want.count() > 100 and have.exceptAll(want).isEmpty()
    later = runs["w1"].where((F.col("now") >= change) & (F.col("series") == names[0]))
    have = got.where("strategy = 'y'").select(columns)
    assert have.count() == later.count() > 0 and have.exceptAll(later).isEmpty()
