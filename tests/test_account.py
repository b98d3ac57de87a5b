"""Orders, protection, performance and portfolio vectors."""

import json
import random

from pyspark.sql import functions as F

from quillbase.functions import untyped
from quillbase.operators import account

ORDER = "account long, coin string, side string, sz double, reduce_only boolean, is_trigger boolean, order_type string"


def recursion(rows):
    out = []
    for row in rows if isinstance(rows, list) else []:
        if isinstance(row, dict):
            kids = row.get("children") if isinstance(row.get("children"), list) else []
            if not kids or row.get("cloid"):
                out.append(row.get("oid"))
            out += recursion(kids)
    return out


def test_flatten_equals_recursion(spark):
    rng = random.Random(3)

    def grown(depth):
        row = {"oid": rng.randrange(10**6), "coin": rng.choice(["ZEC", 7, None]), "cloid": rng.choice(["", "x", 0, 1, None, False, "0"])}
        if depth and rng.random() < 0.9:
            row["children"] = rng.choice([[grown(depth - 1) for _ in range(2)]] * 3 + [[], "none", None, [None, 5, grown(depth - 1)]])
        return row

    trees = [[grown(6) for _ in range(3)] for _ in range(5)] + [[], {"oid": 1}, "text", [None, 3, "x", {"oid": 9}]]
    texts = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(50, None), (51, "{broken")]
    flat = account.flatten_orders(spark.createDataFrame(texts, "account long, orders string"), "account").withColumn("oid", F.try_variant_get("order", "$.oid", "long")).collect()
    for i, tree in enumerate(trees):
        assert [r.oid for r in sorted((r for r in flat if r.account == i), key=lambda r: r.at)] == recursion(tree)
    assert not any(r.account >= 50 for r in flat) and max(len(r.path) for r in flat) >= 6
    fields = account.order_fields(account.flatten_orders(spark.createDataFrame([(1, '[{"coin": 5, "sz": "2", "limitPx": 1.5, "reduceOnly": 1, "oid": 7, "orderType": {"a": 1}}]')], "account long, orders string"), "account"), "account").first()
    assert (fields.coin, fields.sz, fields.limitPx, fields.reduceOnly, fields.isTrigger, fields.oid, fields.orderType) == ("5", "2", "1.5", True, False, 7, None)


def test_field_kinds(spark):
    docs = [(1, '{"a": 1, "b": [1, "x", {"c": null}]}'), (1, '{"a": "1", "b": {"c": true}}'), (2, "[]"), (2, None), (2, "no json")]
    rows = spark.createDataFrame(docs, "g int, j string").select("g", F.try_parse_json("j").alias("v"))
    got = {(r.g, r.path, r.kind): r.n for r in untyped.field_kinds(rows, "g", "v").collect()}
    assert got == {
        (1, "$", "object"): 2, (2, "$", "array"): 1, (1, "$.a", "number"): 1, (1, "$.a", "text"): 1, (1, "$.b", "array"): 1, (1, "$.b", "object"): 1,
        (1, "$.b[]", "number"): 1, (1, "$.b[]", "text"): 1, (1, "$.b[]", "object"): 1, (1, "$.b.c", "boolean"): 1, (1, "$.b[].c", "null"): 1,
    }


def status(spark, positions, orders):
    p = spark.createDataFrame(positions, "account long, coin string, szi double")
    o = spark.createDataFrame(orders, ORDER)
    return account.protection(p, o, "account", "ZEC").first()


def bracket(kind):
    return (1, "zec", "B", 2.0, True, True, kind)


def test_protection(spark):
    assert status(spark, [], [(1, "ZEC", "B", 2.0, True, True, "Stop Market")]).status == "unprotected"
    good = status(spark, [(1, "ZEC", -2.0)], [bracket("Take Profit Market"), bracket("Stop Market")])
    assert good.status == "protected" and good.protected and good.position_size == 2.0
    half = status(spark, [(1, "ZEC", -2.0)], [bracket("Take Profit Market")])
    assert half.status == "unprotected" and half.protected is False
    assert half.blockers == [
        "expected exactly two ZEC protection orders",
        "protection orders must be opposite-side, reduce-only triggers matching the full position size",
        "exactly one stop trigger is required",
    ]
    two = status(spark, [(1, "ZEC", -2.0), (1, "ETH", 1.0)], [bracket("Take Profit Market"), bracket("Stop Market")])
    assert two.blockers == ["expected exactly one open ZEC position and no other positions"] and two.position_size == 2.0


def test_performance(spark):
    a = spark.createDataFrame([(1, 450.0), (2, None), (3, 10.0)], "account long, equity double")
    flows = spark.createDataFrame([(3, 101), (1, 100), (1, None)], "account long, time long")
    r = {x.account: x for x in account.performance(a, flows, "account", F.lit(630.617157), F.lit(100)).collect()}
    assert r[1].status == "reconciled" and abs(r[1].pnl - (450 - 630.617157)) < 1e-9 and r[1].later_cash_flows == 0
    assert r[2].blocker == "account equity is unavailable" and r[2].status == "unavailable" and r[2].later_cash_flows == 0
    assert r[3].status == "cash_flow_reconciliation_required" and r[3].pnl is None
    bad = account.performance(a, flows, "account", F.lit(None), F.lit(100)).first()
    assert bad.blocker == "strategy accounting baseline is missing or invalid" and bad.later_cash_flows is None
    down = account.performance(a, flows, "account", F.lit(5.0), F.lit(100), F.lit("timed out")).first()
    assert down.blocker == "cash-flow source unavailable: timed out"
    odd = account.performance(a, flows, "account", F.lit(5.0), F.lit(100), source_is_list=F.lit(False), label=F.lit("start")).first()
    assert (odd.blocker, odd.later_cash_flows, odd.baseline, odd.baseline_label, odd.cutoff_ms, odd.cutoff_at) == ("cash-flow source is malformed", None, 5.0, "start", 100, "1970-01-01T00:00:00.100Z")
    wild = account.performance(a.withColumn("equity", F.lit(float("inf"))), flows, "account", F.lit(5.0), F.lit(100)).where("account = 1").first()
    assert wild.blocker == "account equity is unavailable"


def test_portfolio(spark):
    rows = spark.createDataFrame([(1, {"day": [("1", "2.5"), ("x", "3"), ("4", "NaN"), ("5", "0.5")]})], "account long, raw map<string,array<struct<ts:string,val:string>>>")
    clean = account.clean_portfolio(rows, "account")
    assert [(p.ts, p.val) for p in clean.first().curves["day"]] == [(1.0, 2.5), (5.0, 0.5)]
    assert [r.value for r in account.curve(clean, "account", "day").collect()] == [2.5]
    assert account.curve(clean, "account", "week").count() == 0


def test_positions(spark):
    position = "struct<coin:string,szi:string,entryPx:string,positionValue:string,unrealizedPnl:string,marginUsed:string,liquidationPx:string,leverage:struct<value:int>>"
    rows = spark.createDataFrame([(1, (("Z", "-2", "3", "x", None, "1", "", (5,)))), (1, (("Q", "0", "3", "1", None, "1", "", None)))], f"account long, position {position}")
    got = account.positions(rows, "account").collect()
    assert len(got) == 1 and got[0].szi == -2.0 and got[0].positionValue is None and got[0].liquidationPx is None


def test_attribution_parts(spark):
    fills = spark.createDataFrame([(f"c{i:02}", float(i), 0.0) for i in range(20)], "coin string, closed_pnl double, fee double")
    got = account.attribution(fills).collect()
    assert [r.coin for r in got if r.part == "head"] == [f"c{i:02}" for i in range(19, 11, -1)] and {r.coin for r in got if r.part == "tail"} == {f"c{i:02}" for i in range(8)}
    assert {r.part for r in account.attribution(fills.limit(16)).collect()} == {"all"}


def test_orders_cards_and_blockers(spark):
    raw = spark.createDataFrame([(1, None, "B", "x", "2", 7, "5", None, None, True, None, ""), (1, "Z", None, "3", "Infinity", 8, None, "4", "c", None, True, "Stop Market")], "account long, coin string, side string, limitPx string, sz string, oid long, timestamp string, triggerPx string, triggerCondition string, reduceOnly boolean, isTrigger boolean, orderType string")
    public = account.public_orders(raw, "account")
    assert [tuple(r) for r in public.collect()] == [(1, "", "B", None, 2.0, 7, 5.0, None, None, True, False, ""), (1, "Z", "", 3.0, None, 8, None, 4.0, "c", False, True, "Stop Market")]
    assert [tuple(r) for r in account.order_rows(public, "account").collect()] == [(1, "", "B", "2.0", "\u2014", "reduce-only"), (1, "Z", "", "\u2014", "4.0", "Stop Market")]
    accounts = spark.createDataFrame([(1, 50.0, 100.0, 5.0), (2, None, 1.0, None)], "account long, equity double, gross double, margin double")
    held = spark.createDataFrame([(1, 2.5), (1, None)], "account long, unrealized double")
    got = {r.account: tuple(r)[1:] for r in account.cards(accounts, held, public, "account").collect()}
    assert got == {1: (50.0, 2.5, 2.0, 10.0, "2 pos / 2 ord"), 2: (0.0, 0.0, None, 0.0, "FLAT")}
    lists = spark.sql("SELECT array('a', 'b') AS s, array('b') AS a, 'unprotected' AS st, array('a') AS p UNION ALL SELECT array('a'), null, 'protected', array('p')")
    assert [r[0] for r in lists.select(account.all_blockers(F.col("s"), F.col("a"), F.col("st"), F.col("p"))).collect()] == [["a", "b", "b", "a"], ["a"]]


def test_deep_orders_take_few_tables(spark, monkeypatch):
    """A tree of 40 levels: each holds the next and a leaf; a table for the trees and one for each ``LEVELS`` levels, with the taken columns only."""
    from quillbase.operators.stored import Scratch

    tree = '{"oid":40}'
    for n in range(39, 0, -1):
        tree = '{"oid":%d,"cloid":%s,"children":[%s,null,{"oid":-%d}]}' % (n, '"c"' if n % 2 else '""', tree, n)
    tables, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, last=False: tables.append(df.columns) or keep(self, df, last))
    rows = spark.createDataFrame([(1, f"[7,{tree}]"), (2, "{}"), (3, None)], "account long, orders string")
    got = account.flatten_orders(rows, "account", account.order_columns).orderBy("at").collect()
    assert [r.oid for r in got] == [*(n for n in range(1, 40) if n % 2), 40, *(-n for n in range(39, 0, -1))]
    assert [r.at for r in got] == list(range(60)) and got[20].path == [1] + [0] * 39 and got[-1].path == [1, 2]
    assert len(tables) == 1 + -(-40 // account.LEVELS) and all("order" not in columns for columns in tables)
