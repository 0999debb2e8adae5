"""Trade tables to ledgers: order costs, settlement, FIFO lots, daily books and checks.

A trade table has keys, `day`, ordering columns, `side` ('buy' or 'sell'), `units` and
`amount`. One key may own any share of all trades, so with `spread` running quantities are scanned
over ranges of trades (scan.ranged). FIFO matching is a merge of two cumulative curves, never a join
of buys with sells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import REDEMPTION_TIERS, floor_to, ordered, tiered_rate
from tidemark.operators.scan import PART, ranged, running
from tidemark.session import materialise


def cap_sells(trades: DataFrame, keys, order: Sequence[str], spread: bool = False) -> DataFrame:
    """Limit each sell to the units held, in order.

    With S the running net and M = min(0, lowest S so far), S - M is what is held, so a sell
    is cut by exactly how far it pushes M down. Needs two running scans and no loop. With
    `spread` hot keys are cut into ranges (PART, which trades may already have), also for `fifo_match`.
    """
    net = F.when(F.col("side") == "buy", F.col("units")).otherwise(-F.col("units"))
    df = (ranged(trades, keys, order) if spread and PART not in trades.columns else trades).withColumn("__net", net)
    df = running(df, keys, order, {"__s": ("sum", "__net")}, chained=True).withColumn("__p", F.col("__s") - F.col("__net"))
    df = running(df, keys, order, {"__low": ("min", "__p")}, chained=True)
    low = F.least(F.col("__low"), F.lit(0.0))
    cut = F.greatest(low - F.col("__s"), F.lit(0.0))
    filled = F.when(F.col("side") == "buy", F.col("units")).otherwise(F.col("units") - cut)
    df = df.withColumn("filled", filled)
    return df.withColumn("held", F.col("__s") - F.least(low, F.col("__s"))).drop("__net", "__s", "__p", "__low")


def fifo_match(trades: DataFrame, keys, order: Sequence[str], units: str = "filled", carry: Sequence[str] | None = None) -> DataFrame:
    """First bought, first sold: one row per (sell, lot) overlap with the units matched.

    On the axis of cumulative units, buys and sells each cut the line into intervals. The
    end points of both are sorted together; every piece between neighbouring ends lies in
    the next buy interval and the next sell interval. The result has at most one row per
    trade. `carry` names the columns of lot and sell (None: all but the keys). Keys with ranges
    (of `cap_sells`) are scanned by range, and so is their axis of units.
    """
    ids = [c for c in trades.columns if c not in keys and c != PART] if carry is None else carry
    live = trades.filter(F.col(units) > 0)
    is_buy = F.col("side") == "buy"
    live = live.withColumns({"__b": F.when(is_buy, F.col(units)).otherwise(0.0), "__s": F.when(is_buy, 0.0).otherwise(F.col(units))})
    live = running(live, keys, order, {"__eb": ("sum", "__b"), "__es": ("sum", "__s")}, chained=True)
    end = F.when(is_buy, F.col("__eb")).otherwise(F.col("__es"))
    interval = F.struct(end.alias("end"), (end - F.col(units)).alias("start"), *[F.col(c) for c in ids])
    part = [PART] if PART in trades.columns else []
    ends = live.select(
        *keys, *part, end.alias("__pos"), is_buy.cast("int").alias("__kind"),
        F.when(is_buy, interval).alias("__lot"), F.when(~is_buy, interval).alias("__sell"),
    )
    if not part:
        return _overlaps(ends, keys, keys)
    # keys that are not cut lie together as they are; the others are written before the ranges of their units are looked for
    whole = ends.where(F.col(PART).isNull()).withColumnRenamed(PART, "__whole")
    cut = ranged(materialise(ends.where(F.col(PART).isNotNull()).drop(PART)), keys, ["__pos", "__kind"])
    return _overlaps(whole, keys, [*keys, "__whole"]).unionByName(_overlaps(cut, keys, keys))


def _overlaps(ends: DataFrame, keys, by) -> DataFrame:
    """The pieces between neighbouring ends that lie in a lot and in a sell; scanned by `by`."""
    ends = running(ends, by, ["__pos", "__kind"], {"lot": ("last", "__lot"), "sell": ("last", "__sell")}, reverse=True)
    overlap = F.least("lot.end", "sell.end") - F.greatest("lot.start", "sell.start")
    # the piece that ends at this row; ends that coincide leave an empty second piece
    first_of_tie = F.col("__pos") == F.least("lot.end", "sell.end")
    pieces = ends.filter(F.col("lot").isNotNull() & F.col("sell").isNotNull() & first_of_tie).withColumn("matched", overlap)
    return pieces.filter(F.col("matched") > 1e-9).select(*keys, "lot", "sell", "matched")


def open_lots(trades: DataFrame, matches: DataFrame, keys, units: str = "filled") -> DataFrame:
    """Units bought less units matched, per key."""
    bought = trades.filter("side = 'buy'").groupBy(*keys).agg(F.sum(units).alias("bought"))
    used = matches.groupBy(*keys).agg(F.sum("matched").alias("used"))
    return bought.join(used, list(keys), "left").select(*keys, (F.col("bought") - F.coalesce("used", F.lit(0.0))).alias("open_units"))


def redemption_fees(matches: DataFrame, keys, price: Column, sell_day: Column, lot_day: Column, tiers=REDEMPTION_TIERS, young: int = 30) -> DataFrame:
    """Tiered fee on matched units by age in calendar days between the two confirmations."""
    df = matches.withColumns({"age": F.datediff(sell_day, lot_day), "__price": price})
    return df.groupBy(*keys).agg(
        F.sum("matched").alias("units"),
        F.sum(F.col("matched") * F.col("__price") * tiered_rate("age", tiers)).alias("fee"),
        F.sum(F.when(F.col("age") < young, F.col("matched")).otherwise(0.0)).alias("young_units"),
    )


def fund_order(purchase, price, fee: float = 0.0015) -> list[Column]:
    """Front-end fee: net = gross / (1 + fee), units floored to 0.01, the rest refunded."""
    gross = floor_to(purchase, 2)
    net = gross / (1 + fee)
    units = floor_to(net / price, 2, 1e-9)
    return [units.alias("units"), (gross - net).alias("fee"), (units * price + (gross - net)).alias("spent")]


def metal_order(purchase, price, half_spread: float = 2.5, slippage: float = 0.0) -> list[Column]:
    """Ask = mid + half spread + slippage, units floored to 0.0001; the fee is the spread paid."""
    ask = price + half_spread + price * slippage
    units = floor_to(floor_to(purchase, 2) / ask, 4, 1e-9)
    return [units.alias("units"), (units * (ask - price)).alias("fee"), (units * ask).alias("spent")]


def session_shift(calendar: DataFrame, t: str, **shifts: int) -> DataFrame:
    """Calendar with, per name, the session k rows later; null (still pending) past the end.

    The shift is looked up once per session, so settling trades is an equality join.
    """
    days = calendar.select(t).distinct().withColumn("__one", F.lit(1))
    w = ordered(["__one"], t)
    return days.select(t, F.row_number().over(w).alias("session"), *[F.lead(t, k).over(w).alias(n) for n, k in shifts.items()])


def settle(trades: DataFrame, calendar: DataFrame, t: str, confirm: int = 1, settle_days: int = 1) -> DataFrame:
    """Confirmation and cash dates of each trade, counted in sessions of the product (one row per day, so they go to the trades)."""
    return trades.join(F.broadcast(session_shift(calendar, t, confirm_date=confirm, cash_date=settle_days)), t)


def daily_books(trades: DataFrame, keys, t: str, cash_date: str, initial: float, units: str = "filled") -> DataFrame:
    """Cash, units, unsettled proceeds, equity and weight on each day with any movement.

    Trade and settlement rows are summed per key and day first; only that daily table is
    scanned in order. Money is summed as decimals (order independent). The price is the day's mean trade price,
    carried forward over days without trades. Proceeds without a cash date stay unsettled.
    """
    money = "decimal(28,8)"
    is_buy = F.col("side") == "buy"
    value = F.col("price") * F.col(units)
    none, no_money = F.lit(0.0), F.lit(0).cast(money)
    buy_value = F.when(is_buy, value).otherwise(0.0).cast(money)
    sell_value = F.when(is_buy, 0.0).otherwise(value).cast(money)
    signed = F.when(is_buy, F.col(units)).otherwise(-F.col(units))

    def move(date, cash, size, due, traded, traded_units):
        fields = {"__d": date, "__cash": cash, "__units": size, "__due": due, "__value": traded, "__size": traded_units}
        return F.struct(*[c.cast(money).alias(n) if n in ("__cash", "__due", "__value") else c.alias(n) for n, c in fields.items()])

    part = [PART] if PART in trades.columns else []
    moves = trades.select(*keys, *part, F.inline(F.array(
        move(F.col(t), -buy_value, signed, sell_value, buy_value + sell_value, F.col(units)),
        move(F.col(cash_date), sell_value, none, -sell_value, no_money, none),
    )))
    names = ["__cash", "__units", "__due", "__value", "__size"]
    moves = moves.where("__d IS NOT NULL")
    if part:
        # a range of a hot key is summed up where it lies, before its days come together
        moves = moves.groupBy(*keys, *part, "__d").agg(*[F.sum(c).alias(c) for c in names]).repartition(*keys)
    daily = moves.groupBy(*keys, "__d").agg(*[F.sum(c).alias(c) for c in names]).withColumnRenamed("__d", t)
    w = ordered(keys, t)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("__size") > 0, F.col("__value").cast("double") / F.col("__size"))
    out = daily.select(
        *keys, t,
        (F.sum("__cash").over(run).cast("double") + initial).alias("cash"), F.sum("__units").over(run).alias("units"),
        F.sum("__due").over(run).cast("double").alias("unsettled"), F.last(own, True).over(run).alias("price"),
    )
    value_now = F.coalesce(F.col("units") * F.col("price"), F.lit(0.0))
    out = out.withColumn("equity", F.col("cash") + F.col("unsettled") + value_now)
    return out.withColumn("weight", F.try_divide(value_now, "equity"))


def ledger_violations(books: DataFrame, keys, t: str, eps: float = 1e-5) -> DataFrame:
    """One row per broken daily invariant."""
    rules = {
        "cash_not_negative": F.col("cash") >= -eps,
        "units_not_negative": F.col("units") >= -eps,
        "unsettled_not_negative": F.col("unsettled") >= -eps,
        "weight_in_unit_interval": (F.col("weight") >= -eps) & (F.col("weight") <= 1 + eps),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return books.select(*keys, t, F.explode(broken).alias("rule"))


def lots_conserved(books: DataFrame, lots: DataFrame, keys, t: str, eps: float = 1e-5) -> DataFrame:
    """Keys whose last unit balance is not the sum of their open lots."""
    last = books.groupBy(*keys).agg(F.max_by("units", t).alias("units"))
    return last.join(lots, list(keys), "full").filter(F.abs(F.coalesce("units", F.lit(0.0)) - F.coalesce("open_units", F.lit(0.0))) > eps)


def rebalance_trigger(df: DataFrame, keys, t: str, target: str, band: float = 0.10) -> DataFrame:
    """Trade if the target moved, or if the weight at the previous known price is off by the band."""
    w = ordered(keys, t)
    previous = F.lag("price").over(w)
    held, money = F.lag("units", 1, 0.0).over(w), F.lag(F.col("cash") + F.col("unsettled")).over(w)
    known = F.try_divide(held * previous, money + held * previous)
    moved = F.abs(F.col(target) - F.lag(target, 1, -1.0).over(w)) > 1e-8
    off = F.abs(F.coalesce(known, F.lit(0.0)) - F.col(target)) >= band
    return df.withColumns({"known_weight": known, "changed": moved, "trigger": moved | off})


def overlay_comparison(bars: DataFrame, keys, episode_keys, t: str, caps, thresholds, policies, spreads, delays) -> DataFrame:
    """Compare all overlay settings over all holding episodes.

    Inside an episode an extra tranche `cap` is bought `delay` rows after the close first
    stands `threshold` below the episode's first close (policy: on an up day) and sold at
    the episode's last close; both sides pay half the spread. The benchmark holds the
    overlay's mean exposure for the whole episode. Row-level work is done once per
    (threshold, policy, delay); caps and spreads only scale the episode sums.
    """
    w = ordered(episode_keys, t)
    df = bars.withColumns({"__k": F.row_number().over(w), "__first": F.first("close").over(w)})
    signals = F.array(*[
        F.struct(F.lit(float(th)).alias("threshold"), F.lit(po).alias("policy"), F.lit(d).alias("delay"),
                 ((F.col("close") <= F.col("__first") * (1 - th)) & (F.lit(not po) | (F.col("close") >= F.col("open")))).alias("hit"))
        for th in thresholds for po in policies for d in delays
    ])
    rows = df.select(*episode_keys, t, "close", "__k", F.inline(signals))
    setting = ["threshold", "policy", "delay"]
    first_hit = F.min(F.when(F.col("hit"), F.col("__k"))).over(Window.partitionBy(*episode_keys, *setting))
    rows = rows.withColumn("__buy", first_hit + F.col("delay"))
    per = rows.groupBy(*episode_keys, *setting).agg(
        F.min_by("close", t).alias("first_close"), F.max_by("close", t).alias("last_close"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("__k") == F.col("__buy"), F.col("close"))).alias("buy"),
        F.count_if(F.col("__k") > F.col("__buy")).alias("days_on"),
    )
    combos = F.array(*[F.struct(F.lit(float(c)).alias("cap"), F.lit(float(s)).alias("spread")) for c in caps for s in spreads])
    per = per.select("*", F.inline(combos))
    gross = F.try_divide(F.col("last_close") - F.col("spread") / 2 - F.col("buy") - F.col("spread") / 2, F.col("buy"))
    net = F.when(F.col("buy").isNotNull(), F.col("cap") * gross).otherwise(0.0)
    exposure = F.when(F.col("buy").isNotNull(), F.col("cap") * F.col("days_on") / F.col("n")).otherwise(0.0)
    per = per.withColumns({"net": net, "exposure": exposure})
    matched = F.col("exposure") * (F.col("last_close") / F.col("first_close") - 1)
    return per.groupBy("cap", *setting, "spread").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("net").alias("mean_net"), F.avg(F.col("net") - matched).alias("mean_matched_excess"),
        F.avg("exposure").alias("mean_exposure"), F.count_if(F.col("net") > 0).alias("positive"), F.count("buy").alias("active"))
