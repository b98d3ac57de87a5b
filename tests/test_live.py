"""Status records: responses gathered once, odd values in them, and the last candle judged as among all."""

import json

from pyspark.sql import functions as F

from quillbase.functions.expr import HOUR_MS
from quillbase.operators import live, signal, snapshot, timeseries
from quillbase.sources import landing

ROWS = "feed string, key string, time long, body string, error string"
NOW = 1_000 * HOUR_MS + 60_000
STATE = {"marginSummary": {"accountValue": "5"}, "withdrawable": True, "assetPositions": []}


def _candle(i, **other):
    return {"t": (975 + i) * HOUR_MS, "T": (976 + i) * HOUR_MS - 1, "o": "100", "h": "101", "l": "99", "c": "100", "v": "1000"} | other


def _records(spark, folder, bodies):
    """The records of accounts from bodies by key and feed, landed and read back."""
    feeds = {"clearinghouse": STATE, "orders": [], "portfolio": [], "fills": [], "cashflows": [], "candles": [], "funding": [], "book": {}}
    rows = [(f, k, NOW, json.dumps(b), None) for k, own in bodies.items() for f, b in (feeds | own).items()]
    landing.land(spark.createDataFrame(rows, ROWS), folder)
    found = landing.read_landed(spark, folder, live.FEEDS, NOW - 1, NOW + 1)
    return live.status_records(spark.createDataFrame([(k,) for k in bodies], "key string"), found, spark.createDataFrame([], snapshot.SCHEMA), "lanes", NOW, 1.0, NOW)


def test_responses_are_gathered_once(spark, tmp_path):
    """The record reads the table of gathered texts; the landed files are not opened again for each of its parts."""
    out = _records(spark, str(tmp_path / "landed"), {"a": {}, "b": {"orders": {}}})
    assert not [f for f in out.inputFiles() if "/landed/" in f]
    assert {r.key: (r.error, r.record is None) for r in out.collect()} == {"a": (None, False), "b": ("required public account state is unavailable", True)}


def test_odd_values(spark, tmp_path):
    """Neither objects, flags nor lists are numbers, whatever their text; elements that are no objects are passed over."""
    fills = [
        None, 7, "x", {"time": 1, "px": "1e999", "sz": {"a": 1}, "fee": [5], "closedPnl": True, "coin": 5, "side": {"b": 1}, "dir": None, "crossed": "0"},
        {"time": " 2 ", "px": "\t1.5", "sz": "3d", "fee": "0x1p3", "closedPnl": ".5e1", "coin": 1.25, "side": True, "dir": "Open", "crossed": 0}, [1],
        {"time": "NaN", "px": "", "sz": "Infinity", "fee": "1.", "closedPnl": "-.", "coin": "A", "side": [1], "dir": "", "crossed": {}},
    ]
    odd = {3: {"c": {"a": 1}}, 4: {"c": True}, 5: {"h": ["101"]}, 6: {"t": "x"}}
    candles = [None, 5, "x", [1], {}] + [_candle(i, **odd.get(i, {})) for i in range(25)]
    found = {r.key: r.record for r in _records(spark, str(tmp_path / "landed"), {"a": {"fills": fills}, "b": {"candles": candles}, "c": {"candles": candles[5:8] + [_candle(i) for i in range(25)]}}).collect()}
    got = [tuple(f[n] for n in ("time", "px", "sz", "fee", "closedPnl", "coin", "side", "dir", "crossed")) for f in found["a"].account.fills]
    assert got == [
        (2.0, 1.5, None, None, 5.0, "1.25", "true", "Open", False), (1.0, None, None, None, None, "5", "", "", True),
        (None, None, None, None, None, "", "", "", False), (None, None, None, 1.0, None, "A", "", "", True),
    ]
    assert list(found["a"].account.fills[0].asDict()) == ["time", "coin", "side", "dir", "px", "sz", "closedPnl", "fee", "crossed"]
    assert found["a"].account.withdrawable is None and found["a"].account.equity == 5
    assert found["b"].signal.regime_blockers == [timeseries.TOO_FEW]  # one of the 25 has no start
    assert found["c"].signal.regime_blockers == [timeseries.GAPPED]


def test_last_candle_is_judged_as_among_all(spark):
    """Series that are sound, short, gapped, stale, doubled at their end, longer than needed, or without quotes."""
    rows = {
        "sound": range(25), "short": range(1, 25), "gapped": [*range(3), *range(4, 25), 25], "stale": range(-1, 24), "long": range(-40, 25), "doubled": [*range(25), 24], "blind": range(25), "one": [24],
    }
    held = [(s, *(float(x) if n in "ohlcv" else x for n, x in _candle(i, c=str(100 + k * 0.3)).items())) for s, places in rows.items() for k, i in enumerate(places)]
    candles = spark.createDataFrame(held, "series string, t long, t_end long, o double, h double, l double, c double, v double").withColumn("h", F.greatest("h", "c"))
    funding = spark.createDataFrame([(s, NOW - NOW % HOUR_MS + 5, 3e-5) for s in rows if s != "long"], "series string, time long, rate double")
    quotes = spark.createDataFrame([(s, 100.0, 100.01) for s in rows if s != "blind"], "series string, bid double, ask double")
    now = F.lit(NOW).cast("long")
    every = signal.evaluate(candles, funding, candles.groupBy("series").agg(F.max("t").alias("t")).join(quotes, "series"), now)
    ends = {}
    for r in every.collect():
        rank = (r.candle, timeseries.TOO_FEW not in r.regime_blockers)
        if r.series not in ends or rank > ends[r.series][0]:
            ends[r.series] = (rank, r)
    got = {r.series: r for r in signal.evaluate_last(candles, funding, quotes, now).collect()}
    same = lambda a, b: all(x == y for x, y in zip(a, b, strict=True))
    assert set(got) == set(rows)
    assert [s for s in rows if s != "doubled" and not same(got[s], ends[s][1])] == []
    assert got["doubled"].regime_blockers == [timeseries.GAPPED] and got["sound"].data_complete and not got["blind"].data_complete and got["short"].regime_blockers == [timeseries.TOO_FEW]
