"""Public status records of many accounts from landed responses, all at once: signal, protection, performance, fills, portfolio, lanes.

Every account is a row; what its required feeds lack becomes that row's error and no record, and what other
feeds lack becomes an entry of its errors beside the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.functions import untyped
from quillbase.functions.expr import HOUR_MS, finite, finite_number, iso_ms, number
from quillbase.operators import account, signal, snapshot, status, timeseries
from quillbase.operators.stored import Scratch
from quillbase.sources import landing

FEEDS = ("clearinghouse", "orders", "portfolio", "fills", "cashflows", "candles", "funding", "book")
SYMBOL = "ZEC"
MOST_FILLS = 250


def _number(value: Column, path: str) -> Column:
    """A finite number at a path of parsed JSON, written as number or text; null for anything else, whose text is no number."""
    return finite_number(F.try_variant_get(value, path, "string"))


def _elements(wide: DataFrame, feed: str, path: str = "$", kinds: tuple[str, ...] = ("object",)) -> DataFrame:
    """(key, pos, value): the elements of the array at ``path`` of a feed's value; none if it is no array."""
    is_of = {"object": untyped.is_object, "array": untyped.is_array}
    wanted = F.lit(False)
    for k in kinds:
        wanted = wanted | is_of[k](F.col("value"))
    return wide.select("key", F.posexplode(F.try_variant_get(F.col(feed)["value"], path, "array<variant>")).alias("pos", "value")).where(wanted)


def _candles(wide: DataFrame) -> DataFrame:
    """(series, t, t_end, o, h, l, c, v): the elements of each key's array of candles; what is no finite number is null."""
    names = {"t": "t", "t_end": "T", **{n: n for n in "ohlcv"}}
    texts = F.try_variant_get(F.col("candles")["value"], "$", "array<map<string,string>>")
    # inside the array, so that each text is parsed once
    parsed = F.transform(texts, lambda x: F.struct(*(number(F.try_element_at(x, F.lit(n))).alias(c) for c, n in names.items())))
    rows = wide.select(F.col("key").alias("series"), F.inline(parsed))
    return rows.select("series", *(finite(F.col(c)).cast("long" if c.startswith("t") else "double").alias(c) for c in names))


def market_signals(wide: DataFrame, now_ms: int, rules: signal.Rules = signal.Rules()) -> DataFrame:
    """(key, signal columns) as ``signal.evaluate`` has them, of each key's last completed candle; also for keys that have no candle."""
    rows = timeseries.completed(_candles(wide), now_ms).withColumn("t_end", F.coalesce("t_end", F.col("t") + HOUR_MS - 1))
    v = lambda n: _number(F.col("value"), f"$.{n}")
    paid = _elements(wide, "funding").select(F.col("key").alias("series"), v("time").cast("long").alias("time"), v("fundingRate").alias("rate"))
    price = lambda side: _number(F.col("book")["value"], f"$.levels[{side}][0].px")
    quotes = wide.select(F.col("key").alias("series"), price(0).alias("bid"), price(1).alias("ask"))
    newest = signal.evaluate_last(rows, paid, quotes, F.lit(now_ms).cast("long"), rules).drop("candle")
    top = quotes.withColumn("top", signal.top_of_book(F.col("bid"), F.col("ask"))).select(F.col("series").alias("key"), "top")
    out = top.join(newest, top["key"] == newest["series"], "left").drop("series")
    bare = F.array(F.lit(timeseries.TOO_FEW))
    here = F.col("next_close").isNotNull()
    base = {
        "data_complete": F.coalesce("data_complete", F.lit(False)), "regime_passes": F.coalesce("regime_passes", F.lit(False)), "regime_blockers": F.when(here, F.col("regime_blockers")).otherwise(bare),
        "market_passes": F.coalesce("market_passes", F.lit(False)), "blockers": F.when(here, F.col("blockers")).otherwise(F.array_compact(F.concat(bare, F.array(F.col("top.error"))))),
        "observed_at": iso_ms(F.lit(now_ms).cast("long")), "next_close": F.lit(now_ms - now_ms % HOUR_MS + HOUR_MS).cast("long"),
        "bid": F.col("top.bid"), "ask": F.col("top.ask"), "mid": F.col("top.mid"), "spread_bps": F.col("top.spread_bps"),
    }
    return out.withColumns(base).drop("top", "now")


def account_parts(wide: DataFrame) -> dict[str, DataFrame]:
    """Positions, orders, fills and portfolio of each key as rows of public fields."""
    v = F.col("value")
    inner = F.coalesce(untyped.at(v, "$.position"), v)
    p = _elements(wide, "clearinghouse", "$.assetPositions").select("key", "pos", inner.alias("value"))
    amount = lambda n: _number(F.col("value"), f"$.{n}").alias(n)
    text = lambda n: F.coalesce(untyped.text(F.col("value"), f"$.{n}"), F.lit("")).alias(n)
    leverage = F.to_json(F.when(untyped.kind(untyped.at(F.col("value"), "$.leverage")).isin("object", "array"), untyped.at(F.col("value"), "$.leverage")))
    positions = p.select("key", "pos", text("coin"), *(amount(n) for n in ("szi", "entryPx", "positionValue", "unrealizedPnl", "marginUsed", "liquidationPx")), leverage.alias("leverage")).where(F.abs("szi") > 0)
    flat = account.flatten_orders(wide.select("key", F.col("orders")["value"].alias("orders")), "key", account.order_columns)
    orders = account.public_orders(flat, "key", "at")
    # in steps, so that each text is parsed once
    amounts = ("time", "px", "sz", "closedPnl", "fee")
    fills = _elements(wide, "fills", kinds=("object", "array")).select("key", "pos", text("coin"), text("side"), text("dir"), *(number(F.try_variant_get(v, f"$.{n}", "string")).alias(n) for n in amounts), untyped.at(v, "$.crossed").alias("crossed"))
    fills = fills.withColumns({**{n: finite(F.col(n)) for n in amounts}, "_kind": untyped.kind(F.col("crossed"))})
    fills = fills.withColumn("crossed", F.coalesce(untyped.truthy(F.col("crossed"), F.col("_kind")), F.lit(False)))
    newest = Window.partitionBy("key").orderBy(F.desc_nulls_last("time"), "pos")
    fills = fills.withColumn("at", F.row_number().over(newest) - 1).where(F.col("at") < MOST_FILLS)
    fills = fills.select("key", "at", "time", "coin", "side", "dir", "px", "sz", "closedPnl", "fee", "crossed")
    entries = _elements(wide, "portfolio", kinds=("array",)).where(untyped.kind(untyped.at(v, "$[1]")).isin("object", "array"))
    points = lambda field: F.filter(
        F.transform(F.coalesce(F.try_variant_get(v, f"$[1].{field}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.struct(_number(x, "$[0]").alias("ts"), _number(x, "$[1]").alias("val"))),
        lambda x: x["ts"].isNotNull() & x["val"].isNotNull(),
    )
    portfolio = entries.select("key", F.col("pos").alias("at"), untyped.text(v, "$[0]").alias("window"), points("accountValueHistory").alias("accountValueHistory"), points("pnlHistory").alias("pnlHistory"), _number(v, "$[1].vlm").alias("vlm"))
    return {"positions": positions.withColumnRenamed("pos", "at"), "orders": orders, "fills": fills, "portfolio": portfolio}


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """(_key, name): a key's rows in order of ``at`` as one array of structs, as bounded as the response they come from."""
    fields = [c for c in rows.columns if c not in ("key", "at")]
    listed = F.sort_array(F.collect_list(F.struct("at", F.struct(*fields).alias("row"))))
    return rows.groupBy(F.col("key").alias(f"_{name}")).agg(F.transform(listed, lambda x: x["row"]).alias(name))


def status_records(keys: DataFrame, responses: DataFrame, snapshots: DataFrame, lanes_schema: str, now_ms: int, baseline: float, cutoff_ms: int, label: str | None = None, rules: signal.Rules = signal.Rules(), symbol: str = SYMBOL) -> DataFrame:
    """(key, error, record): one row per key of ``keys``: the nested public record, or why there is none.

    ``responses``: rows of ``landing.read_landed``. ``snapshots``: at most one research snapshot a key, of ``snapshot.SCHEMA``. Each
    key's last responses count. They are gathered once, into a table of the checkpoint folder: a text a feed, which only the parts that need it parse.
    """
    wide = landing.latest_by_key(responses, keys, FEEDS)
    bad = {f: F.col(f)["error"] for f in FEEDS}
    with Scratch(wide.sparkSession) as scratch:
        texts = (F.struct(F.col(f)["body"], F.col(f)["error"]).alias(f) for f in FEEDS)
        wide = scratch.keep(wide.select("key", landing.required_error(F.col("clearinghouse"), F.col("orders")).alias("error"), landing.source_errors(bad).alias("errors"), *texts), last=True)
        wide = wide.withColumns({f: F.struct(F.try_parse_json(F.col(f)["body"]).alias("value"), F.col(f)["error"]) for f in FEEDS})
        sound = wide.where("error IS NULL")
        missing = F.array_compact(F.array(*(F.when(bad[f].isNotNull(), F.lit(f)) for f in ("candles", "funding", "book"))))
        judged = market_signals(sound, now_ms, rules).join(sound.select("key", missing.alias("_missing")), "key")
        judged = scratch.keep(signal.merge_source_errors(judged, F.col("_missing")).drop("_missing"), last=True)
        # protection and performance are tables as well: the plan of the record holds their rows, not their joins
        parts = account_parts(sound)
        worth = lambda path: _number(F.col("clearinghouse")["value"], path)
        own = sound.select(
            "key", worth("$.marginSummary.accountValue").alias("equity"), worth("$.withdrawable").alias("withdrawable"), worth("$.marginSummary.totalMarginUsed").alias("margin_used"), worth("$.marginSummary.totalNtlPos").alias("notional"),
            "errors", F.col("cashflows")["error"].alias("ledger_error"), F.coalesce(untyped.kind(F.col("cashflows")["value"]) == "array", F.lit(False)).alias("listed"),
        )
        flows = _elements(sound, "cashflows", kinds=("object", "array")).select("key", _number(F.col("value"), "$.time").alias("time"))
        earned = scratch.keep(account.performance(own, flows, "key", F.lit(baseline), F.lit(cutoff_ms).cast("long"), F.col("ledger_error"), F.col("listed"), F.lit(label).cast("string")), last=True)
        asked = parts["orders"].select("key", "coin", "side", "sz", F.col("reduceOnly").alias("reduce_only"), F.col("isTrigger").alias("is_trigger"), F.col("orderType").alias("order_type"))
        held = account.protection(parts["positions"], asked, "key", symbol)
        held = scratch.keep(sound.select("key").join(held, "key", "left").select(
            "key", F.coalesce("status", F.lit("not_required")).alias("status"), "protected", F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"), F.lit(symbol).alias("symbol"),
            "position_size", F.coalesce("protection_orders", F.lit(0).cast("long")).alias("protection_orders"),
        ), last=True)
    gate = account.account_gate(own, parts["positions"], parts["orders"], "key").select("key", F.col("blockers").alias("account_blockers"), F.col("passes").alias("account_gate"))
    accounts = own.drop("ledger_error", "listed").join(gate, "key")
    for name, rows in parts.items():
        accounts = accounts.join(_gathered(rows, name), F.col("key") == F.col(f"_{name}"), "left").drop(f"_{name}")
    accounts = accounts.withColumns({n: F.coalesce(n, F.array()) for n in parts})
    lanes = snapshot.publish(snapshots, lanes_schema, now_ms)
    told = status.assemble(accounts, judged, held, earned, lanes, F.col("errors"), "key", F.lit(now_ms).cast("long"))
    told = told.withColumn("account", F.col("account").dropFields("errors"))
    record = told.select(F.col("key").alias("_key"), F.struct(*(c for c in told.columns if c != "key")).alias("record"))
    return wide.select("key", "error").join(record, F.col("key") == F.col("_key"), "left").select("key", "error", "record")
