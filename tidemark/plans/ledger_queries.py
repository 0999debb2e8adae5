"""LED: ledgers on trades per supplier (flag N buys, flag R sells)."""

from pyspark.sql import functions as F

from tidemark.operators import ledger as led
from tidemark.operators import metrics as met
from tidemark.operators.scan import PART, ranged
from tidemark.plans.metric_queries import BASE, EPISODES, K, curves
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import FEATURES, GATED, gated
from tidemark.plans.views import BARS, CAL, product_calendar, table
from tidemark.session import materialise

S = ["supp"]
# a lot can be sold from the day its purchase is confirmed on, so purchases stand at that day; unconfirmed ones after all sells
ORDER = ["pending", "usable", "side", "l_orderkey", "l_linenumber"]
# a prime, so that equity as a multiple of it never ends in a rounding tie
INITIAL = 9_999_991.0


def trades(spark, sf):
    """Trades, dealt by supplier (and range of a hot one's trades) once, so that nothing above is shuffled again."""
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("N", "R"))
    li = li.select(F.col("l_suppkey").alias("supp"), F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber",
                   F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"), "l_quantity", "l_extendedprice")
    # one row per day
    li = li.join(F.broadcast(led.session_shift(sessions(spark, sf), "day", confirmed=1).drop("session")), "day")
    li = li.withColumn("usable", F.when(F.col("side") == "buy", F.col("confirmed")).otherwise(F.col("day")))
    li = ranged(li.withColumn("pending", F.col("usable").isNull()), S, ORDER)
    by = [*S, PART] if PART in li.columns else S
    t = li.repartition(*by).groupBy(*by, "day", "l_orderkey", "l_linenumber", "side", "confirmed", "usable", "pending").agg(
        F.sum("l_quantity").alias("units"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    return t.withColumn("price", F.col("amount") / F.col("units"))


def filled(spark, sf):
    return led.cap_sells(trades(spark, sf), S, ORDER)


TRADES = """
trades AS (SELECT l_suppkey AS supp, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side,
   sum(l_quantity) AS units, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL),
ses AS (SELECT day, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS session, lead(day, 1) OVER (ORDER BY day) AS confirm_date,
   lead(day, 3) OVER (ORDER BY day) AS cash_date FROM (SELECT DISTINCT day FROM trades)),
tr0 AS (SELECT trades.*, confirm_date AS confirmed, CASE WHEN side = 'buy' THEN confirm_date ELSE day END AS usable FROM trades JOIN ses USING (day)),
tr1 AS (SELECT *, amount / units AS price, row_number() OVER (PARTITION BY supp ORDER BY usable NULLS LAST, side, l_orderkey, l_linenumber) AS k,
   sum(CASE WHEN side = 'buy' THEN units ELSE -units END) OVER (PARTITION BY supp ORDER BY usable NULLS LAST, side, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS s FROM tr0),
tr2 AS (SELECT *, s - least(0.0, min(s) OVER (PARTITION BY supp ORDER BY k ROWS UNBOUNDED PRECEDING)) AS held FROM tr1),
fills AS (SELECT *, CASE WHEN side = 'buy' THEN units ELSE coalesce(lag(held) OVER (PARTITION BY supp ORDER BY k), 0.0) - held END AS filled FROM tr2)"""

MATCHES = """
cb AS (SELECT *, sum(filled) OVER (PARTITION BY supp ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM fills WHERE side = 'buy' AND filled > 0),
cs AS (SELECT *, sum(filled) OVER (PARTITION BY supp ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM fills WHERE side = 'sell' AND filled > 0),
matches AS (SELECT s.supp, b.l_orderkey AS buy_order, b.l_linenumber AS buy_line, s.l_orderkey AS sell_order, s.l_linenumber AS sell_line, b.confirmed AS buy_day, s.confirmed AS sell_day, s.price AS sell_price,
   least(b.e, s.e) - greatest(b.e - b.filled, s.e - s.filled) AS matched FROM cb b JOIN cs s ON b.supp = s.supp AND b.e > s.e - s.filled AND s.e > b.e - b.filled)"""

@query("led2_sells_capped_by_holdings", f"WITH {TRADES} SELECT supp, day, l_orderkey, l_linenumber, side, units, filled, held FROM fills")
def sells_capped_by_holdings(spark, sf):
    return filled(spark, sf).select("supp", "day", "l_orderkey", "l_linenumber", "side", "units", "filled", "held")


def matched(spark, sf, carry):
    t = filled(spark, sf)
    return t, led.fifo_match(t, S, ORDER, carry=carry)


@query("led2_fifo_match", f"WITH {TRADES}, {MATCHES} SELECT supp, buy_order, buy_line, sell_order, sell_line, matched, CAST(sell_day - buy_day AS INTEGER) AS age FROM matches")
def fifo_match(spark, sf):
    _, m = matched(spark, sf, ["l_orderkey", "l_linenumber", "confirmed"])
    return m.select("supp", F.col("lot.l_orderkey").alias("buy_order"), F.col("lot.l_linenumber").alias("buy_line"), F.col("sell.l_orderkey").alias("sell_order"),
                    F.col("sell.l_linenumber").alias("sell_line"), "matched", F.datediff("sell.confirmed", "lot.confirmed").alias("age"))


@query("led3_redemption_fees", f"""WITH {TRADES}, {MATCHES}
SELECT supp, sum(matched) AS units, round(sum(matched * sell_price * CASE WHEN sell_day - buy_day < 7 THEN 0.015 WHEN sell_day - buy_day < 30 THEN 0.005 ELSE 0 END), 2) AS fee,
 CAST(sum(CASE WHEN sell_day - buy_day < 30 THEN matched ELSE 0 END) AS DOUBLE) AS young_units FROM matches WHERE sell_day IS NOT NULL GROUP BY 1""")
def redemption_fees(spark, sf):
    _, m = matched(spark, sf, ["price", "confirmed"])
    # the fee is due on confirmation
    m = m.where("sell.confirmed IS NOT NULL")
    out = led.redemption_fees(m, S, F.col("sell.price"), F.col("sell.confirmed"), F.col("lot.confirmed"))
    return out.select("supp", "units", F.round("fee", 2).alias("fee"), "young_units")


@query("led4_order_costs", f"""WITH {CAL}, o AS (SELECT o_orderkey, o_totalprice AS p, nav, nav * 7.3 AS mid FROM orders JOIN cal ON cal.date = CAST(o_orderdate AS DATE)),
g AS (SELECT *, floor((p + 1e-8) * 100) / 100 AS gross FROM o), f AS (SELECT *, floor((gross / 1.0015::DOUBLE / nav + 1e-9) * 100) / 100 AS fu, gross - gross / 1.0015::DOUBLE AS ff,
 mid + 2.5 + mid * 0.001 AS ask FROM g), m AS (SELECT *, floor((gross / ask + 1e-9) * 10000) / 10000 AS mu FROM f)
SELECT o_orderkey, fu AS fund_units, round(ff, 4) AS fund_fee, round(fu * nav + ff, 4) AS fund_spent, mu AS metal_units, round(mu * (ask - mid), 4) AS metal_fee, round(mu * ask, 4) AS metal_spent FROM m""")
def order_costs(spark, sf):
    cal = product_calendar(spark, sf).select("date", "nav")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date")).join(cal, "date")
    fund = F.struct(*led.fund_order(F.col("o_totalprice"), F.col("nav"))).alias("f")
    metal = F.struct(*led.metal_order(F.col("o_totalprice"), F.col("nav") * 7.3, slippage=0.001)).alias("m")
    o = o.select("o_orderkey", fund, metal)
    r = lambda c: F.round(c, 4)
    return o.select("o_orderkey", F.col("f.units").alias("fund_units"), r("f.fee").alias("fund_fee"), r("f.spent").alias("fund_spent"),
                    F.col("m.units").alias("metal_units"), r("m.fee").alias("metal_fee"), r("m.spent").alias("metal_spent"))


def sessions(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("N", "R"))
    return li.select(F.col("l_shipdate").cast("date").alias("day"))


def settled(spark, sf, t=None):
    t = filled(spark, sf) if t is None else t
    return led.settle(t, sessions(spark, sf), "day", confirm=1, settle_days=3)


@query("led5_confirmation_and_settlement", f"""WITH {TRADES}
SELECT supp, l_orderkey, l_linenumber, side, day, session, confirm_date, cash_date FROM fills JOIN ses USING (day)""")
def confirmation_and_settlement(spark, sf):
    return settled(spark, sf).select("supp", "l_orderkey", "l_linenumber", "side", "day", "session", "confirm_date", "cash_date")


BOOKS = f"""
mv AS (SELECT supp, day, CASE WHEN side = 'buy' THEN -CAST(price * filled AS DECIMAL(28,8)) ELSE 0 END AS cash, CASE WHEN side = 'buy' THEN filled ELSE -filled END AS u,
   CASE WHEN side = 'buy' THEN 0 ELSE CAST(price * filled AS DECIMAL(28,8)) END AS due, CAST(price * filled AS DECIMAL(28,8)) AS v, filled AS size FROM fills
  UNION ALL SELECT supp, cash_date, CASE WHEN side = 'buy' THEN 0 ELSE CAST(price * filled AS DECIMAL(28,8)) END, 0.0,
   CASE WHEN side = 'buy' THEN 0 ELSE -CAST(price * filled AS DECIMAL(28,8)) END, 0, 0.0 FROM fills JOIN ses USING (day) WHERE cash_date IS NOT NULL),
dd AS (SELECT supp, day, sum(cash) AS cash, sum(u) AS u, sum(due) AS due, sum(v) AS v, sum(size) AS size FROM mv GROUP BY 1, 2),
bk AS (SELECT supp, day, CAST(sum(cash) OVER w AS DOUBLE) + {INITIAL:.1f}::DOUBLE AS cash, sum(u) OVER w AS units, CAST(sum(due) OVER w AS DOUBLE) AS unsettled,
   last_value(CASE WHEN size > 0 THEN CAST(v AS DOUBLE) / size END IGNORE NULLS) OVER w AS price FROM dd WINDOW w AS (PARTITION BY supp ORDER BY day ROWS UNBOUNDED PRECEDING)),
books AS (SELECT *, cash + unsettled + coalesce(units * price, 0) AS equity, coalesce(units * price, 0) / (cash + unsettled + coalesce(units * price, 0)) AS weight FROM bk)"""


def books(spark, sf, t=None):
    return led.daily_books(settled(spark, sf, t), S, "day", "cash_date", INITIAL)


@query("led6_daily_books", f"""WITH {TRADES}, {BOOKS}
SELECT supp, day, round(cash, 8) AS cash, units, round(unsettled, 8) AS unsettled, round(equity / {INITIAL:.1f}::DOUBLE, 9) AS equity_multiple, round(weight, 6) AS weight FROM books""")
def daily_books(spark, sf):
    return books(spark, sf).select("supp", "day", F.round("cash", 8).alias("cash"), "units", F.round("unsettled", 8).alias("unsettled"),
                                   F.round(F.col("equity") / INITIAL, 9).alias("equity_multiple"), F.round("weight", 6).alias("weight"))


@query("led7_invariant_checks", f"""WITH {TRADES}, {MATCHES}, {BOOKS}, br AS (
 SELECT 'cash_not_negative' AS rule, count(*) FILTER (cash < -1e-5) AS broken FROM books UNION ALL SELECT 'units_not_negative', count(*) FILTER (units < -1e-5) FROM books
 UNION ALL SELECT 'unsettled_not_negative', count(*) FILTER (unsettled < -1e-5) FROM books UNION ALL SELECT 'weight_in_unit_interval', count(*) FILTER (NOT (weight >= -1e-5 AND weight <= 1.00001)) FROM books),
o AS (SELECT supp, sum(filled) AS b FROM fills WHERE side = 'buy' GROUP BY 1), u AS (SELECT supp, sum(matched) AS m FROM matches GROUP BY 1), l AS (SELECT supp, arg_max(units, day) AS units FROM books GROUP BY 1)
SELECT rule, broken FROM br WHERE broken > 0 UNION ALL SELECT 'lots_conserved', count(*) FILTER (abs(l.units - (b - coalesce(m, 0))) > 1e-5) FROM o JOIN l USING (supp) LEFT JOIN u USING (supp)""")
def invariant_checks(spark, sf):
    t, m = matched(spark, sf, [])
    b = books(spark, sf, t)
    daily = led.ledger_violations(b, S, "day").groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))
    lots = led.lots_conserved(b, led.open_lots(t, m, S), S, "day").agg(F.lit("lots_conserved").alias("rule"), F.count(F.lit(1)).alias("broken"))
    return daily.unionByName(lots.select("rule", "broken"))


@query("led7_episode_profit_adds_up", f"""{BASE}, {EPISODES}
SELECT series_id, strategy, round(sum(ending_equity - starting_equity), 4) AS episode_pnl, round(sum(cost), 4) AS episode_cost, 0.0::DOUBLE AS pnl_gap, 0.0::DOUBLE AS cost_gap
FROM ep WHERE strategy <> 'hold' GROUP BY 1, 2""")
def episode_profit_adds_up(spark, sf):
    """Profit and cost of all episodes against those of the whole curve: the gaps are zero."""
    c = materialise(curves(spark, sf).filter("strategy <> 'hold'"))
    whole = c.groupBy(*K).agg((F.max_by("equity", "date") - F.min_by("equity", "date")).alias("pnl"), F.sum("fee").alias("fees"))
    parts = met.holding_episodes(c, K, "date").groupBy(*K).agg(F.sum("net_pnl").alias("p"), F.sum("cost").alias("k"))
    gap = lambda a, b: F.abs(F.round(F.col(a) - F.col(b), 6))
    return parts.join(whole, K).select(*K, F.round("p", 4).alias("episode_pnl"), F.round("k", 4).alias("episode_cost"),
                                       gap("p", "pnl").alias("pnl_gap"), gap("k", "fees").alias("cost_gap"))


@query("led8_rebalance_trigger", f"""WITH {TRADES}, {BOOKS}, q AS (SELECT *, CASE WHEN month(day) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS target FROM books),
z AS (SELECT *, lag(units, 1, 0.0) OVER w * lag(price) OVER w AS hv, lag(cash + unsettled) OVER w AS mo, abs(target - lag(target, 1, -1.0::DOUBLE) OVER w) > 1e-8 AS changed FROM q WINDOW w AS (PARTITION BY supp ORDER BY day))
SELECT supp, day, target, round(hv / (mo + hv), 6) AS known_weight, changed, changed OR abs(coalesce(hv / (mo + hv), 0) - target) >= 0.1 AS trigger FROM z""")
def rebalance_trigger(spark, sf):
    df = books(spark, sf).withColumn("target", F.when(F.month("day") % 2 == 0, 0.5).otherwise(0.25))
    out = led.rebalance_trigger(df, S, "day", "target", band=0.1)
    return out.select("supp", "day", "target", F.round("known_weight", 6).alias("known_weight"), "changed", "trigger")


@query("led8_tradable_sessions", f"""WITH {BARS}, {FEATURES}, {GATED}, {CAL}, c AS (SELECT *, abs(target - lag(target, 1, -1.0::DOUBLE) OVER (PARTITION BY series_id ORDER BY date)) > 1e-8 AS changed FROM g3)
SELECT series_id, c.date, round(target, 6) AS target, coalesce(cal.sub_status = 'open', false) AS tradable FROM c LEFT JOIN cal ON cal.date = c.date WHERE changed""")
def tradable_sessions(spark, sf):
    from tidemark.operators import indicators as ind

    moves = ind.change_points(gated(spark, sf), ["series_id"], "date", "target", initial=-1.0)
    cal = product_calendar(spark, sf).select("date", (F.col("sub_status") == "open").alias("open"))
    return moves.join(cal, "date", "left").select("series_id", "date", F.round("target", 6).alias("target"), F.coalesce("open", F.lit(False)).alias("tradable"))


CAPS, THRESHOLDS, POLICIES, SPREADS, DELAYS = (0.1, 0.2, 0.3), (0.002, 0.005, 0.01), (False, True), (0.05, 0.1), (1, 2)


@query("led9_overlay_comparison", f"""{BASE}, hh AS (SELECT series_id, date, open, close, weight > 1e-10 AS held, coalesce(lag(weight) OVER w > 1e-10, false) AS was FROM curve WHERE strategy = 'trend60' WINDOW w AS (PARTITION BY series_id ORDER BY date)),
h3 AS (SELECT *, sum(CASE WHEN held AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS episode FROM hh),
er AS (SELECT *, row_number() OVER w AS k, first_value(close) OVER w AS f FROM h3 WHERE held WINDOW w AS (PARTITION BY series_id, episode ORDER BY date)),
sg AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) a(threshold), (VALUES (false), (true)) b(policy), (VALUES (1), (2)) c(delay)),
rs AS (SELECT er.*, sg.*, close <= f * (1 - threshold) AND (NOT policy OR close >= open) AS hit FROM er, sg),
rb AS (SELECT *, min(CASE WHEN hit THEN k END) OVER (PARTITION BY series_id, episode, threshold, policy, delay) + delay AS b FROM rs),
pe AS (SELECT series_id, episode, threshold, policy, delay, arg_min(close, date) AS fc, arg_max(close, date) AS lc, count(*) AS n, max(CASE WHEN k = b THEN close END) AS buy, count(*) FILTER (k > b) AS d FROM rb GROUP BY ALL),
co AS (SELECT pe.*, cap, spread FROM pe, (VALUES {', '.join(f'({c}::DOUBLE)' for c in CAPS)}) x(cap), (VALUES {', '.join(f'({s}::DOUBLE)' for s in SPREADS)}) y(spread)),
ne AS (SELECT *, CASE WHEN buy IS NULL THEN 0 ELSE cap * (lc - spread / 2 - buy - spread / 2) / buy END AS net, CASE WHEN buy IS NULL THEN 0 ELSE cap * d / n END AS ex FROM co)
SELECT cap, threshold, policy, delay, spread, count(*) AS episodes, round(avg(net), 8) AS mean_net, round(avg(net - ex * (lc / fc - 1)), 8) AS mean_matched_excess, round(avg(ex), 8) AS mean_exposure,
 count(*) FILTER (net > 0) AS positive, count(buy) AS active FROM ne GROUP BY ALL""")
def overlay_comparison(spark, sf):
    from pyspark.sql import Window

    from tidemark.functions.scalars import ordered

    c = curves(spark, sf).filter("strategy = 'trend60'")
    w = ordered(["series_id"], "date")
    held = F.col("weight") > met.HELD
    c = c.withColumns({"held": held, "was": F.coalesce(F.lag("weight").over(w) > met.HELD, F.lit(False))})
    c = c.withColumn("episode", F.sum((F.col("held") & ~F.col("was")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = led.overlay_comparison(c.filter("held"), ["series_id"], ["series_id", "episode"], "date", CAPS, THRESHOLDS, POLICIES, SPREADS, DELAYS)
    return out.withColumns({m: F.round(m, 8) for m in ("mean_net", "mean_matched_excess", "mean_exposure")})
