"""Account analytics: projections of raw rows, protection, exposure, attribution, fills, performance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.functions import untyped
from quillbase.functions.expr import finite_number, iso_ms, not_finite
from quillbase.operators.stored import Scratch


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _number(name: str) -> Column:
    return finite_number(F.col(name).cast("string")).alias(name)


def positions(rows: DataFrame, key: str) -> DataFrame:
    """Eight public fields of each raw ``position`` struct with a size other than zero."""
    inner = rows.select(key, "position.*")
    fields = [_number(n) for n in ("szi", "entryPx", "positionValue", "unrealizedPnl", "marginUsed", "liquidationPx")]
    return inner.select(key, _text("coin"), *fields, "leverage").where(F.abs("szi") > 0)


#: Levels of an order tree that one pass walks, without a table between them.
LEVELS = 16


def _order(order: Column) -> list[Column]:
    return [order.alias("order")]


def flatten_orders(rows: DataFrame, key: str, take: Callable[[Column], list[Column]] = _order) -> DataFrame:
    """(key, at, path, order): the orders of trees of any depth, parents before children, from ``orders``, JSON text or VARIANT.

    An order with children counts itself only if it has a ``cloid``; elements that are neither objects nor arrays are passed over, and so
    is anything but an array. ``path`` holds the positions from the root. ``take`` gives the columns to have in place of ``order``, such as
    ``order_columns``: an order holds all that is below it, so those of a deep tree are together far larger than the tree. One pass for
    ``LEVELS`` levels; the next one takes only what is deeper.
    """
    parsed = F.try_parse_json("orders") if dict(rows.dtypes)["orders"] == "string" else F.col("orders")

    def elements(path: Column, held: Column) -> Column:
        return F.transform(held, lambda x, i: F.struct(F.concat(path, F.array(i)).alias("path"), x.alias("order"), untyped.at(x, "$.children[0]").isNotNull().alias("more")))

    def inner(order: Column) -> Column:
        return F.try_variant_get(order, "$.children", "array<variant>")

    def below(levels: Column) -> Column:
        """The levels and one more: what the last one's elements hold."""
        held = F.transform(F.filter(F.element_at(levels, -1), lambda e: e["more"]), lambda e: elements(e["path"], inner(e["order"])))
        return F.concat(levels, F.array(F.flatten(held)))

    with Scratch(rows.sparkSession) as scratch:
        trees = scratch.keep(rows.select(F.col(key).alias("_key"), parsed.alias("held")))
        roots = trees.select("_key", F.array().cast("array<int>").alias("path"), F.try_variant_get("held", "$", "array<variant>").alias("held")).where(F.size("held") > 0)
        found, depth = None, 0
        while True:
            depth += LEVELS
            walked = F.aggregate(F.sequence(F.lit(2), F.lit(LEVELS)), F.array(elements(F.col("path"), F.col("held"))), lambda levels, _: below(levels))
            # an outer one: the other would be guarded by a filter that walks every tree once more
            each = roots.select("_key", F.explode_outer(F.flatten(walked)).alias("e")).select("_key", "e.*").where(untyped.is_object(F.col("order")) | untyped.is_array(F.col("order")))
            own = ~F.col("more") | untyped.truthy(untyped.at(F.col("order"), "$.cloid"))
            deeper = F.when(F.col("more") & (F.size("path") == depth), F.col("order"))
            kept = scratch.keep(each.select("_key", "path", own.alias("own"), deeper.alias("deeper"), *take(F.col("order"))).where("own OR deeper IS NOT NULL"), last=True)
            mine = kept.where("own").drop("own", "deeper")
            found = mine if found is None else found.unionByName(mine)
            rest = kept.where("deeper IS NOT NULL")
            if rest.isEmpty():
                break
            roots = rest.select("_key", "path", inner(F.col("deeper")).alias("held"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("path")) - 1
    return found.select(F.col("_key").alias(key), place.alias("at"), *found.columns[1:])


def order_columns(order: Column) -> list[Column]:
    """The fields of an order that ``public_orders`` takes, as texts and flags, whatever types they were written with."""
    text = [untyped.text(order, f"$.{n}").alias(n) for n in ("coin", "side", "limitPx", "sz", "timestamp", "triggerPx", "triggerCondition", "orderType")]
    flags = [untyped.truthy(untyped.at(order, f"$.{n}")).alias(n) for n in ("reduceOnly", "isTrigger")]
    return [*text, F.try_variant_get(order, "$.oid", "long").alias("oid"), *flags]


def order_fields(flat: DataFrame, key: str) -> DataFrame:
    """``order_columns`` of flattened orders."""
    return flat.select(key, "at", *order_columns(F.col("order")))


def public_orders(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Eleven public fields of each order row, and the columns ``more``; texts that are missing are empty, numbers that are no numbers null."""
    flag = lambda n: F.coalesce(F.col(n).cast("boolean"), F.lit(False)).alias(n)
    return rows.select(
        key, *more, _text("coin"), _text("side"), _number("limitPx"), _number("sz"), "oid", _number("timestamp"), _number("triggerPx"), "triggerCondition", flag("reduceOnly"), flag("isTrigger"), "orderType"
    )


def order_rows(orders: DataFrame, key: str) -> DataFrame:
    """What a table of orders shows: size, trigger else limit price, and the kind or what stands for it; ``\u2014`` where nothing is known."""
    said = lambda *c: F.coalesce(*(F.col(x).cast("string") for x in c), F.lit("\u2014"))
    kind = F.when(F.coalesce("orderType", F.lit("")) != "", F.col("orderType")).when(F.col("reduceOnly"), "reduce-only").otherwise("limit")
    return orders.select(key, "coin", "side", said("sz").alias("sz"), said("triggerPx", "limitPx").alias("price"), kind.alias("kind"))


def cards(accounts: DataFrame, positions: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """One row per account (key, equity, gross, margin): sum of open results, leverage, margin in per cent, counts and exposure.

    Missing numbers count as zero; leverage is null and the margin share zero without equity.
    """
    held = positions.groupBy(key).agg(F.sum(F.coalesce("unrealized", F.lit(0.0))).alias("unrealized"), F.count(F.lit(1)).alias("n_positions"))
    asked = orders.groupBy(key).agg(F.count(F.lit(1)).alias("n_orders"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = accounts.join(held, key, "left").join(asked, key, "left").withColumns({"n_positions": F.coalesce("n_positions", F.lit(0)), "n_orders": F.coalesce("n_orders", F.lit(0))})
    idle = (F.col("n_positions") == 0) & (F.col("n_orders") == 0)
    return out.select(
        key, zero("equity").alias("equity"), zero("unrealized").alias("unrealized"),
        F.when(zero("equity") != 0, F.round(zero("gross") / zero("equity"), 2)).alias("leverage"),
        F.when(zero("equity") != 0, F.round(zero("margin") / zero("equity") * 100, 1)).otherwise(0.0).alias("margin_pct"),
        F.when(idle, "FLAT").otherwise(F.concat(F.col("n_positions").cast("string"), F.lit(" pos / "), F.col("n_orders").cast("string"), F.lit(" ord"))).alias("exposure"),
    )


def all_blockers(signal: Column, account: Column, protection_status: Column, protection: Column) -> Column:
    """The three lists of reasons one after the other, repeats included; those of protection only where it is missing."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(signal, none), F.coalesce(account, none), F.when(protection_status == "unprotected", F.coalesce(protection, none)).otherwise(none))


def clean_portfolio(rows: DataFrame, key: str) -> DataFrame:
    """``curves``: map of window to points (ts, val) whose both numbers are finite. ``raw``: map of window to points of strings."""
    number = lambda p: F.struct(finite_number(p["ts"]).alias("ts"), finite_number(p["val"]).alias("val"))
    kept = lambda ps: F.filter(F.transform(ps, number), lambda p: p["ts"].isNotNull() & p["val"].isNotNull())
    return rows.select(key, F.transform_values("raw", lambda _, ps: kept(ps)).alias("curves"))


def curve(portfolio: DataFrame, key: str, window: str) -> DataFrame:
    """The points of one window with a value above 1, in long form."""
    return portfolio.select(key, F.explode(F.try_element_at("curves", F.lit(window))).alias("p")).select(key, "p.ts", F.col("p.val").alias("value")).where("value > 1")


def protection(positions: DataFrame, orders: DataFrame, key: str, symbol: str) -> DataFrame:
    """One row per key of either side: status, protected, blockers, position_size, protection_orders.

    positions: key, coin, szi. orders: key, coin, side, sz, reduce_only, is_trigger, order_type.
    """
    here = lambda c: F.upper(F.coalesce(c, F.lit(""))) == symbol.upper()
    active = positions.where(F.abs("szi") > 0).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_active"), F.count_if(here(F.col("coin"))).alias("n_symbol"), F.max(F.when(here(F.col("coin")), F.col("szi"))).alias("szi")
    )
    own = orders.where(here(F.col("coin")))
    both = own.select(key).union(active.select(key)).distinct().join(active, key, "left")
    size = F.abs("szi")
    one = F.coalesce(F.col("n_symbol") == 1, F.lit(False))
    side = F.when(F.col("szi") < 0, "B").otherwise("A")
    fits = one & F.col("reduce_only") & F.col("is_trigger") & (F.upper("side") == side) & (F.abs(F.col("sz") - size) <= F.greatest(F.lit(1e-9), size * 1e-6))
    kind = F.lower(F.coalesce("order_type", F.lit("")))
    seen = both.join(own.withColumn("there", F.lit(True)), key, "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    counts = seen.groupBy(key).agg(
        *(F.first(c).alias(c) for c in ("n_active", "n_symbol", "szi")),
        F.count("there").alias("n_orders"),
        F.count_if("fits").alias("n_fit"),
        F.count_if(F.col("fits") & kind.contains("take profit")).alias("n_take"),
        F.count_if(F.col("fits") & kind.contains("stop")).alias("n_stop"),
    )
    flat = F.col("n_active").isNull()
    # What the record's reader is told, here and in ``performance`` and ``account_gate``.
    say = lambda p, text: F.when(p, text)
    idle = F.array_compact(F.array(say(F.col("n_orders") > 0, F.format_string(f"found %d {symbol} order(s) while the account is flat", "n_orders"))))
    busy = F.array_compact(
        F.array(
            say((F.col("n_active") != 1) | ~one, F.lit(f"expected exactly one open {symbol} position and no other positions")),
            say(F.col("n_orders") != 2, F.lit(f"expected exactly two {symbol} protection orders")),
            say(one & (F.col("n_fit") != 2), F.lit("protection orders must be opposite-side, reduce-only triggers matching the full position size")),
            say(one & (F.col("n_take") != 1), F.lit("exactly one take-profit trigger is required")),
            say(one & (F.col("n_stop") != 1), F.lit("exactly one stop trigger is required")),
        )
    )
    out = counts.withColumn("blockers", F.when(flat, idle).otherwise(busy))
    clear = F.size("blockers") == 0
    return out.select(
        key,
        F.when(~clear, "unprotected").when(flat, "not_required").otherwise("protected").alias("status"),
        F.when(~(clear & flat), clear).alias("protected"),
        "blockers",
        F.when(~flat & one, size).alias("position_size"),
        F.col("n_orders").alias("protection_orders"),
    )


def exposure(positions: DataFrame, key: str) -> DataFrame:
    """Long, short, gross and net value of each key's positions; ``value`` is taken without sign."""
    value = F.abs("value")
    long, short = (F.coalesce(F.sum(F.when(p, value)), F.lit(0)) for p in (F.col("szi") > 0, F.col("szi") < 0))
    return positions.groupBy(key).agg(long.alias("long"), short.alias("short"), (long + short).alias("gross"), (long - short).alias("net"))


def attribution(fills: DataFrame, head: int = 8, tail: int = 8) -> DataFrame:
    """Net result by coin (closed less fees): the ``head`` best and ``tail`` worst, all if they are no more."""
    net = fills.groupBy("coin").agg(F.sum(F.col("closed_pnl") - F.col("fee")).alias("net"))
    n = F.broadcast(net.agg(F.count(F.lit(1)).alias("n")))  # one number decides whether the parts would overlap
    first = net.orderBy(F.desc("net"), "coin").limit(head).withColumn("part", F.lit("head"))
    last = net.orderBy("net", F.desc("coin")).limit(tail).withColumn("part", F.lit("tail"))
    every = net.orderBy(F.desc("net"), "coin").limit(head + tail).withColumn("part", F.lit("all"))
    many = F.col("n") > head + tail
    return first.unionByName(last).crossJoin(n).where(many).unionByName(every.crossJoin(n).where(~many)).drop("n")


def recent_fills(fills: DataFrame, top: int = 250) -> DataFrame:
    """The latest fills with maker or taker; ties by id."""
    return fills.orderBy(F.desc("time"), F.desc("oid")).limit(top).withColumn("liquidity", F.when(F.col("crossed"), "taker").otherwise("maker"))


def performance(accounts: DataFrame, ledger: DataFrame, key: str, baseline: Column, cutoff_ms: Column, source_error: Column | None = None, source_is_list: Column | None = None, label: Column | None = None) -> DataFrame:
    """One row per account: status, cash flows after the cutoff, result and return since the baseline, or why there is none.

    accounts: key, equity. ledger: key, time. A null baseline or cutoff, or a baseline not above zero, is
    invalid; a non-null ``source_error`` says the ledger can't be read, and a false ``source_is_list`` that what
    was read is no list. The baseline, its label and the cutoff are repeated in each row.
    """
    error = source_error if source_error is not None else F.lit(None).cast("string")
    given = {"baseline": baseline.cast("double"), "cutoff": cutoff_ms.cast("long"), "ledger_error": error}
    given |= {"listed": source_is_list if source_is_list is not None else F.lit(True), "baseline_label": label if label is not None else F.lit(None).cast("string")}
    marked = accounts.withColumns(given)
    flows = ledger.where(F.col("time").isNotNull()).select(F.col(key).alias("_k"), "time")
    counts = marked.join(flows, (F.col(key) == F.col("_k")) & (F.col("time") > F.col("cutoff")), "left").groupBy(key).agg(F.count("time").alias("later"))
    out = marked.join(counts, key)
    invalid = not_finite(F.col("baseline")) | (F.col("baseline") <= 0) | F.col("cutoff").isNull()
    blocker = (
        F.when(invalid, "strategy accounting baseline is missing or invalid")
        .when(F.col("ledger_error").isNotNull(), F.concat(F.lit("cash-flow source unavailable: "), "ledger_error"))
        .when(~F.coalesce("listed", F.lit(False)), "cash-flow source is malformed")
        .when(F.col("later") > 0, "a deposit, withdrawal, or transfer occurred after the accounting baseline")
        .when(not_finite(F.col("equity")), "account equity is unavailable")
    )
    out = out.withColumn("blocker", blocker)
    read = ~invalid & F.col("ledger_error").isNull() & F.coalesce("listed", F.lit(False))
    done = F.col("blocker").isNull()
    gain = F.col("equity") - F.col("baseline")
    return out.select(
        key,
        F.when(done, "reconciled").when(read & (F.col("later") > 0), "cash_flow_reconciliation_required").otherwise("unavailable").alias("status"),
        F.when(read, F.col("later")).alias("later_cash_flows"),
        F.when(done, gain).alias("pnl"),
        F.when(done, gain / F.col("baseline") * 100).alias("return_pct"),
        "blocker",
        F.when(~not_finite(F.col("baseline")), F.col("baseline")).alias("baseline"),
        "baseline_label",
        F.col("cutoff").alias("cutoff_ms"),
        iso_ms(F.col("cutoff")).alias("cutoff_at"),
    )


def account_gate(accounts: DataFrame, positions: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Why an account may not open a position: it holds one, or has orders."""
    held, asked = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((positions, "np"), (orders, "no")))
    out = accounts.select(key).join(held, key, "left").join(asked, key, "left")
    blockers = F.array_compact(F.array(F.when(F.col("np") > 0, "account already has exposure"), F.when(F.col("no") > 0, "account already has open orders")))
    return out.select(key, blockers.alias("blockers"), (F.size(blockers) == 0).alias("passes"))


def position_shares(positions: DataFrame, key: str) -> DataFrame:
    """Positions by value, each with its share of the key's equity in per cent and its rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("value").desc(), "coin"))
    return positions.withColumns({"share_pct": F.round(F.try_divide(F.abs("value"), F.col("equity")) * 100, 6), "rank": rank})
