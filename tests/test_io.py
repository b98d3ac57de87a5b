"""Feeds, results written aside, fallback and the streaming candles."""

import json

import pytest
from pyspark.sql import functions as F

from quillbase.operators import docs, refresh, signal, timeseries
from quillbase.plans import catalogue
from quillbase.sources import adapters, feeds
from quillbase.streaming.candles import stream_candles
from quillbase.streaming.settlements import match_funding_stream


def test_feeds(spark, tmp_path):
    (tmp_path / "fills-1.json").write_text(json.dumps([{"coin": "Z", "px": "1", "time": 5}, {"coin": "é", "time": 7}]))
    (tmp_path / "fills-2.json").write_text(json.dumps({"coin": "Q", "time": 9}))
    (tmp_path / "book.json").write_text(json.dumps({"levels": [[{"px": "1.5"}, {"px": "1"}], [{"px": "2"}]]}))
    rows = feeds.read_feed(spark, str(tmp_path), "fills")
    assert sorted((r.file, r.coin, r.px) for r in feeds.typed(rows, "fills").collect()) == [("fills-1.json", "Z", "1"), ("fills-1.json", "é", None), ("fills-2.json", "Q", None)]
    assert [r.coin for r in feeds.typed(rows, "fills", 6, 9).collect()] == ["é"]
    book = feeds.typed(feeds.read_feed(spark, str(tmp_path), "book"), "book").select(F.struct("levels").alias("book"))
    bid, ask = signal.best_prices(F.col("book"))
    assert tuple(book.select(bid, ask).first()) == (1.5, 2.0)
    empty = spark.sql("SELECT named_struct('levels', array(cast(array() AS array<struct<px:string>>))) AS book")
    assert tuple(empty.select(*signal.best_prices(F.col("book"))).first()) == (None, None)


def test_documents_as_a_feed(spark, tmp_path):
    link = {"content": "Next Page", "textStyle": {"link": {"url": "https://docs.google.com/document/d/ID2/edit"}, "bold": True}}
    paragraph = {"paragraphStyle": {"namedStyleType": "HEADING_2", "unknown": 1}, "elements": [{"textRun": {"content": "Hi & bye"}}, {"textRun": link}, {"inlineObjectElement": {"inlineObjectId": "i"}}]}
    held = {"i": {"inlineObjectProperties": {"embeddedObject": {"imageProperties": {"contentUri": "u.png"}}}}}
    (tmp_path / "documents-1.json").write_text(json.dumps({"documentId": "ID1", "title": "T", "revision": 5, "body": {"content": [{"sectionBreak": {}}, {"paragraph": paragraph}]}, "inlineObjects": held}))
    (tmp_path / "documents-2.json").write_text(json.dumps({"documentId": "ID2"}))
    rows = feeds.typed(feeds.read_feed(spark, str(tmp_path), "documents"), "documents").withColumn("tree", F.struct("body", "inlineObjects"))
    texts = docs.to_markdown(rows, "documentId", "tree")
    assert {r.documentId: r.html for r in docs.to_html(texts, "documentId").collect()} == {"ID1": '<h2>Hi &amp; bye<a href="/p/next-page/">Next Page</a></h2>\n<p><img src="u.png" alt="image" /></p>\n', "ID2": ""}
    assert [(r.src, r.dst, r.slug) for r in docs.link_edges(rows, "documentId", "tree").collect()] == [("ID1", "ID2", "next-page")]


@pytest.mark.parametrize("fmt", refresh.FORMATS)
def test_a_failing_job_keeps_the_earlier_result(spark, tmp_path, fmt):
    assert refresh.latest(spark, str(tmp_path), "a") is None
    assert refresh.publish(spark.range(3), str(tmp_path), "a", fmt) is None
    bad = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken half-way"))).otherwise(F.col("id")).alias("id"))
    assert "broken half-way" in refresh.publish(bad, str(tmp_path), "a", fmt)
    assert sorted(r.id for r in refresh.latest(spark, str(tmp_path), "a").collect()) == [0, 1, 2]
    assert refresh.publish(spark.range(5), str(tmp_path), "a", fmt) is None
    assert refresh.latest(spark, str(tmp_path), "a").count() == 5


def test_fallback_and_summary(spark):
    kinds = "name string, rows array<long>, error string, updated_ms long"
    now = spark.createDataFrame([("a", [1], None, 9), ("b", None, "timed out", None), ("c", None, "down", None)], kinds)
    old = spark.createDataFrame([("a", [0], None, 1), ("b", [2], None, 2), ("d", [3], None, 3)], kinds)
    out = refresh.with_earlier(now, old)
    assert sorted((r.name, r.rows, r.updated_ms, r.error, r.outcome) for r in out.collect()) == [("a", [1], 9, None, "fresh"), ("b", [2], 2, "timed out", "kept"), ("c", None, None, "down", "failed"), ("d", [3], 3, None, "kept")]
    row = refresh.run_summary(out).first()
    assert (row.queries, row.ok, row.fresh, row.failed) == (4, 3, 1, 1)


def test_contract(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "x", "y"), (1, None, "y")], "schemaVersion int, account string, signal string")
    assert [r[0] for r in rows.select(refresh.contract_error(rows, 1, ("account", "signal"))).collect()] == [None, "unknown schema version", "required keys are missing"]
    assert rows.select(refresh.contract_error(rows, 1, ("sources",))).first()[0] == "required keys are missing"


def test_is_fresh(spark):
    day = refresh.DAY_MS
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "k int, updated long").select("k", refresh.is_fresh(F.col("updated"), day).alias("f"))
    assert {r.k: r.f for r in rows.collect()} == {1: False, 2: True, 3: False}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    points = adapters.points(spark, sf_dir)
    points.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_candles(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("candles_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("candles_out")
    batch = timeseries.hourly_candles(points)
    assert got.count() > 0
    assert got.join(batch, ["series", "t", "o", "h", "l", "c", "v", "t_end"], "left_anti").count() == 0


def test_settlements_of_streams_equal_the_batch(spark, sf_dir, tmp_path):
    hour = 3_600_000
    bars = catalogue._candles(spark, sf_dir).where("series < 'e'").select("series", "t", "t_end", "o", "h", "l", "c", "v")
    paid = catalogue._funding(spark, sf_dir).where("series < 'e'")
    paid = paid.unionByName(paid.where("time % 3 = 0"))  # settlements that come twice
    end = bars.agg(F.max("t")).first()[0] + 100 * hour
    last = spark.createDataFrame([("end", end, 0.0)], "series string, time long, rate double")  # the watermark passes all others
    # files in an order of their own: within each, and from one to the next, rows are up to four hours late
    late = lambda df, time: df.withColumn("_f", F.floor((F.col(time) + F.pmod(F.xxhash64("series", time), F.lit(4)) * hour) / (48 * hour)))
    parts = {"bars": late(bars, "t"), "paid": late(paid, "time")}
    for name, df in parts.items():
        for k, (f,) in enumerate(sorted(df.select("_f").distinct().collect())):
            df.where(F.col("_f") == f).drop("_f").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "paid"))
    read = lambda name: spark.readStream.schema(parts[name].drop("_f").schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / name))
    stream = match_funding_stream(read("bars"), read("paid"), "1000 hours", 600_000)
    run = stream.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    got = spark.table("settled")
    assert got.count() == 0  # nothing is told before the lateness is over
    last.withColumn("time", F.col("time") + 2000 * hour).write.mode("append").parquet(str(tmp_path / "paid"))
    stream = match_funding_stream(read("bars"), read("paid"), "1000 hours", 600_000)
    run = stream.writeStream.format("memory").queryName("settled2").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    got, batch = spark.table("settled2"), signal.match_funding(bars, paid, 600_000)
    assert got.count() == batch.count() > 100 and batch.select(got.columns).exceptAll(got).isEmpty()
    assert {r[0] for r in got.select("funding_error").distinct().collect()} >= {None, "post-signal funding settlement is missing", "duplicate post-signal funding settlements"}
