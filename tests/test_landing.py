"""Landed responses: layout and pruning, the last response of each feed, errors as rows, required feeds."""

import json

from pyspark.sql import functions as F

from quillbase.operators import live
from quillbase.sources import landing

DAY = landing.DAY_MS
ROWS = "feed string, key string, time long, body string, error string"


def test_only_the_range_is_opened(spark, tmp_path):
    folder = str(tmp_path / "landed")
    rows = [("fills", "a", d * DAY + 5, f"[{d}]", None) for d in range(6)] + [("book", "a", 3 * DAY, "{}", None), ("fills", "b", None, "[9]", None)]
    landing.land(spark.createDataFrame(rows[:5], ROWS), folder)
    landing.land(spark.createDataFrame(rows[5:], ROWS), folder)
    for path in (tmp_path / "landed").glob("feed=*/day=*/*.parquet"):  # files outside the range can't be read at all
        if path.parent.name not in ("day=2", "day=3") or path.parent.parent.name != "feed=fills":
            path.write_bytes(b"broken")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    got = landing.read_landed(spark, folder, ("fills",), 2 * DAY + 5, 3 * DAY + 6)
    assert sorted(r.body for r in got.collect()) == ["[2]", "[3]"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "feed" in filters and "day" in filters
    assert [r.body for r in landing.read_landed(spark, folder, ("fills",), 2 * DAY + 6, 3 * DAY + 5).collect()] == []
    # a bound that only the run knows prunes too
    cutoffs = spark.createDataFrame([(3 * DAY,), (4 * DAY,)], "cutoff long").agg(F.min("cutoff"))
    assert [r.body for r in landing.read_landed(spark, folder, ("fills",), None, 4 * DAY, cutoffs.scalar()).collect()] == ["[3]"]


def test_last_response_and_errors(spark):
    state = json.dumps({"marginSummary": {"accountValue": "5"}, "assetPositions": []})
    rows = [
        ("clearinghouse", "a", 1, "{}", None), ("clearinghouse", "a", 2, state, None), ("orders", "a", 2, "[]", None), ("book", "a", 2, None, "timed out"), ("funding", "a", 2, "{no", None), ("candles", "a", 2, "[]", None), ("candles", "a", 2, None, "down"),
        ("clearinghouse", "b", 1, state, None), ("clearinghouse", "c", 1, state, None), ("orders", "c", 1, '{"a": 1}', None), ("clearinghouse", "d", 1, '{"marginSummary": {"accountValue": "NaN"}, "assetPositions": []}', None), ("orders", "d", 1, "[]", None),
        ("clearinghouse", "e", 1, '{"marginSummary": {"accountValue": 1}}', None), ("orders", "e", 1, "[]", None), ("orders", "z", 1, "[]", None), ("clearinghouse", "f", None, state, None),
    ]
    keys = spark.createDataFrame([(k,) for k in "aabcdef"], "key string")
    wide = landing.latest_by_key(spark.createDataFrame(rows, ROWS), keys, live.FEEDS)
    errors = landing.source_errors({f: F.col(f)["error"] for f in live.FEEDS})
    got = {r.key: (r.required, r.errors) for r in wide.select("key", landing.required_error(F.col("clearinghouse"), F.col("orders")).alias("required"), errors.alias("errors")).collect()}
    lacking, malformed = "required public account state is unavailable", "required public account state is malformed"
    assert {k: v[0] for k, v in got.items()} == {"a": None, "b": lacking, "c": lacking, "d": malformed, "e": malformed, "f": lacking}
    assert got["a"][1] == {"portfolio": "response is missing", "fills": "response is missing", "cashflows": "response is missing", "candles": "down", "funding": "response is not JSON", "book": "timed out"}
