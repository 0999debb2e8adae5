"""JN and SET: alignment of calendars and merges of sources."""

from pyspark.sql import functions as F

from tidemark.functions.scalars import convert_unit
from tidemark.operators import align
from tidemark.operators import indicators as ind
from tidemark.plans.registry import query
from tidemark.plans.views import (BARS, CAL, FX, PHASES, PHASES_SQL, RAW, fx_rates, index_bars, kept_bars,
                                  product_calendar, raw_bars, table)
from tidemark.session import materialise

K = ["series_id"]


def _closes(spark, sf, keep=False):
    return (kept_bars if keep else index_bars)(spark, sf).select("series_id", "date", "close")


@query("jn1_exact_then_forward_fill", f"""
WITH {RAW}, {FX}, j AS (SELECT r.series_id, r.date, f.fx FROM raw r LEFT JOIN fx f ON f.date = r.date)
SELECT series_id, date, last_value(fx IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS fx FROM j""")
def exact_then_forward_fill(spark, sf):
    left = raw_bars(spark, sf).select("series_id", "date")
    return align.align_exact_ffill(left, fx_rates(spark, sf), K, "date", ["fx"], on=["date"])


@query("jn2_backward_asof", f"""
WITH {BARS}, {CAL}
SELECT b.series_id, b.date, round(c.nav, 6) AS nav FROM bars b ASOF LEFT JOIN cal c ON b.date >= c.date""")
def backward_asof(spark, sf):
    return _product_asof(spark, sf, strict=False).select("series_id", "date", F.round("nav", 6).alias("nav"))


def _product_asof(spark, sf, **kw):
    bars = _closes(spark, sf, keep=True).drop("close")
    return align.asof_shared(bars, product_calendar(spark, sf).select("date", "nav"), "date", ["nav"], **kw)


@query("jn3_strict_backward_asof", f"""
WITH {BARS}, {CAL}
SELECT b.series_id, b.date, round(coalesce(c.nav, 0), 6) AS nav FROM bars b ASOF LEFT JOIN cal c ON b.date > c.date""")
def strict_backward_asof(spark, sf):
    return _product_asof(spark, sf, strict=True, default=0.0).select("series_id", "date", F.round("nav", 6).alias("nav"))


@query("jn4_asof_with_match_date", f"""
WITH {BARS}, {CAL}
SELECT b.series_id, b.date, c.date AS quote_date, CAST(b.date - c.date AS INTEGER) AS stale_days, round(c.nav, 6) AS nav
FROM bars b ASOF LEFT JOIN cal c ON b.date >= c.date""")
def asof_with_match_date(spark, sf):
    out = _product_asof(spark, sf, match_time="quote_date")
    return out.select("series_id", "date", "quote_date", F.datediff("date", "quote_date").alias("stale_days"), F.round("nav", 6).alias("nav"))


@query("jn2_asof_on_ticks", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, v.ts AS view_ts, v.value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_on_ticks(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "view"))
    buys = ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = ev.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    out = align.asof_join(buys, views, ["user_id"], "ts", ["value"], match_time="view_ts", spread=True)
    return out.select("event_id", "user_id", "view_ts", "value")


@query("jn5_calendar_membership", f"""
WITH {RAW}, {FX}
SELECT r.series_id, r.date, f.date IS NOT NULL AS has_fx FROM raw r LEFT JOIN fx f ON f.date = r.date""")
def calendar_membership(spark, sf):
    left = raw_bars(spark, sf).select("series_id", "date")
    return align.calendar_flag(left, fx_rates(spark, sf), ["date"], "has_fx").select("series_id", "date", "has_fx")


@query("jn6_drop_excluded_dates", f"""
WITH {BARS}, {FX}
SELECT series_id, date, close FROM bars WHERE date NOT IN (SELECT date FROM fx)""")
def drop_excluded_dates(spark, sf):
    return align.exclude(_closes(spark, sf), fx_rates(spark, sf), ["date"]).select("series_id", "date", "close")


@query("jn7_common_dates", f"""
WITH {BARS}
SELECT a.date, a.close AS close_a, b.close AS close_b FROM bars a JOIN bars b USING (date)
WHERE a.series_id = 'AF' AND b.series_id = 'RF'""")
def common_dates(spark, sf):
    closes = _closes(spark, sf, keep=True)
    a = closes.filter("series_id = 'AF'").select("date", F.col("close").alias("close_a"))
    b = closes.filter("series_id = 'RF'").select("date", F.col("close").alias("close_b"))
    return a.join(b, "date")


@query("jn8_lagged_features", f"""
WITH {BARS}, {CAL}, {FX},
a AS (SELECT date, nav FROM (SELECT date, lag(nav) OVER (ORDER BY date) AS nav FROM cal) WHERE nav IS NOT NULL),
b AS (SELECT date, fx FROM (SELECT date, lag(fx) OVER (ORDER BY date) AS fx FROM fx) WHERE fx IS NOT NULL),
x AS (SELECT s.series_id, s.date, a.nav FROM bars s ASOF LEFT JOIN a ON s.date >= a.date)
SELECT x.series_id, x.date, round(x.nav, 6) AS nav, b.fx FROM x ASOF LEFT JOIN b ON x.date >= b.date""")
def lagged_features(spark, sf):
    days = _closes(spark, sf, keep=True).select("series_id", "date")
    sources = {"nav": product_calendar(spark, sf).select("date", F.col("nav").alias("v")),
               "fx": fx_rates(spark, sf).select("date", F.col("fx").alias("v"))}
    out = align.lagged_features(days, sources, "date", "v")
    return out.select("series_id", "date", F.round("nav", 6).alias("nav"), "fx")


@query("jn9_phase_join", f"""
WITH {BARS}, {PHASES_SQL}
SELECT series_id, phase, count(*) AS days, min(date) AS first_day, max(date) AS last_day
FROM bars JOIN phases ON date BETWEEN p_start AND p_end GROUP BY 1, 2""")
def phase_join(spark, sf):
    return align.to_phases(_closes(spark, sf), PHASES, "date").groupBy("series_id", "phase").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("jn9_sessions_within_orders", f"""
WITH {CAL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, count(*) AS sessions, min(date) AS first_session, max(date) AS last_session FROM o JOIN cal ON date BETWEEN a AND b GROUP BY 1""")
def sessions_within_orders(spark, sf):
    """Product sessions inside each order's own term of up to 399 days."""
    day = F.col("o_orderdate").cast("date")
    terms = table(spark, sf, "orders").select("o_orderkey", day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 400).cast("int")).alias("b"))
    found = align.interval_join(product_calendar(spark, sf).select("date"), terms, "date", "a", "b")
    return found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first_session"), F.max("date").alias("last_session"))


@query("jn10_series_by_parameter_set", f"""
WITH {BARS}, specs(spec_id, horizon, cap) AS (VALUES (1, 60, 0.55), (2, 120, 0.65), (3, 180, 0.85))
SELECT series_id, spec_id, count(*) FILTER (i >= horizon) AS usable, CAST(max(cap) AS DOUBLE) AS cap
FROM bars CROSS JOIN specs GROUP BY 1, 2""")
def series_by_parameter_set(spark, sf):
    specs = [dict(spec_id=i, horizon=h, cap=c) for i, (h, c) in enumerate([(60, 0.55), (120, 0.65), (180, 0.85)], 1)]
    df = _closes(spark, sf).withColumn("i", ind.row_index(K, "date"))
    return align.with_specs(df, specs).groupBy("series_id", "spec_id").agg(
        F.count_if(F.col("i") >= F.col("horizon")).alias("usable"), F.max("cap").alias("cap"))


@query("jn11_trade_to_daily_lookup", f"""
WITH {BARS}, d AS (SELECT series_id, date, close / (close + open) AS weight FROM bars),
t AS (SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT t.series_id, t.l_orderkey, t.l_linenumber, t.l_quantity, round(d.weight, 6) AS weight_after FROM t JOIN d USING (series_id, date)""")
def trade_to_daily_lookup(spark, sf):
    detail = index_bars(spark, sf).select("series_id", "date", (F.col("close") / (F.col("close") + F.col("open"))).alias("weight"))
    trades = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"),
        "l_orderkey", "l_linenumber", "l_quantity")
    return trades.join(detail, ["series_id", "date"]).select(
        "series_id", "l_orderkey", "l_linenumber", "l_quantity", F.round("weight", 6).alias("weight_after"))


BLACKOUT = ("1997-03-01", "1997-05-31")


@query("jn12_release_lag_join", f"""
WITH {BARS}, {RAW}, rep AS (
  SELECT CAST(date_trunc('week', date) AS DATE) + 10 AS date, CAST(sum(n) AS BIGINT) AS positions FROM raw GROUP BY 1)
SELECT b.series_id, b.date,
  CASE WHEN b.date BETWEEN DATE '{BLACKOUT[0]}' AND DATE '{BLACKOUT[1]}' THEN NULL ELSE r.positions END AS positions,
  CASE WHEN b.date BETWEEN DATE '{BLACKOUT[0]}' AND DATE '{BLACKOUT[1]}' THEN NULL ELSE r.date END AS released
FROM bars b ASOF LEFT JOIN rep r ON b.date >= r.date""")
def release_lag_join(spark, sf):
    days = _closes(spark, sf, keep=True).select("series_id", "date")
    weekly = raw_bars(spark, sf).groupBy(F.date_add(F.date_trunc("week", "date").cast("date"), 10).alias("release_date")).agg(
        F.sum("n").alias("positions"))
    return align.asof_release(days, weekly, [], "date", "release_date", ["positions"], [BLACKOUT])


# sets


@query("set1_union_with_precedence", f"""
WITH {RAW}, a AS (SELECT date, max(close) AS price FROM raw WHERE series_id = '1-URGENT' GROUP BY 1),
b AS (SELECT date, CASE WHEN n > 2 THEN close END AS price FROM raw WHERE series_id = '2-HIGH')
SELECT date, coalesce(b.price, a.price) AS price FROM a FULL JOIN b USING (date)""")
def union_with_precedence(spark, sf):
    raw = raw_bars(spark, sf)
    a = raw.filter("series_id = '1-URGENT'").select("date", F.col("close").alias("price"))
    b = raw.filter("series_id = '2-HIGH'").select("date", F.when(F.col("n") > 2, F.col("close")).alias("price"))
    return align.merge_precedence([a, b], ["date"], "price")


@query("set2_append_after_cutoff", f"""
WITH {RAW}, a AS (SELECT date, close, 'frozen' AS origin FROM raw WHERE series_id = '1-URGENT' AND date <= DATE '1998-06-30')
SELECT * FROM a UNION ALL
SELECT date, close, 'new' AS origin FROM raw WHERE series_id = '2-HIGH' AND date > (SELECT max(date) FROM a)""")
def append_after_cutoff(spark, sf):
    raw = raw_bars(spark, sf)
    frozen = raw.filter("series_id = '1-URGENT' AND date <= DATE '1998-06-30'").select("date", "close", F.lit("frozen").alias("origin"))
    new = raw.filter("series_id = '2-HIGH'").select("date", "close", F.lit("new").alias("origin"))
    return align.append_after(frozen, new, "date")


@query("set3_newest_snapshot_wins", """
SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS snapshot FROM orders GROUP BY 1""")
def newest_snapshot_wins(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("snapshot"))
    return align.newest_per_key(rows, ["id"], ["snapshot"])


@query("set4_upsert_by_id", """
WITH a AS (SELECT c_custkey AS id, c_acctbal AS value, CAST(-1 AS BIGINT) AS version FROM customer),
n AS (SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS version FROM orders GROUP BY 1)
SELECT id, coalesce(n.value, a.value) AS value, coalesce(n.version, a.version) AS version FROM a FULL JOIN n USING (id)""")
def upsert_by_id(spark, sf):
    archive = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(-1).cast("long").alias("version"))
    new = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("version"))
    return align.upsert(archive, new, "id", "version")


@query("set5_calendar_intersection", f"""
WITH {RAW}, {FX}, {CAL}
SELECT date FROM fx INTERSECT SELECT date FROM cal""")
def calendar_intersection(spark, sf):
    return fx_rates(spark, sf).select("date").intersect(product_calendar(spark, sf).select("date"))


@query("set6_distinct_first_seen", """
SELECT source, min(doc_id) AS first_position FROM documents GROUP BY 1""")
def distinct_first_seen(spark, sf):
    return align.first_seen(table(spark, sf, "documents"), "source", "doc_id")


@query("set7_two_way_difference", """
WITH t AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_quantity, l_returnflag FROM lineitem),
a AS (SELECT l_suppkey, day, l_quantity FROM t WHERE l_returnflag = 'N'), b AS (SELECT l_suppkey, day, l_quantity FROM t WHERE l_returnflag = 'R'),
x AS (SELECT *, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT *, count(*) AS n FROM b GROUP BY ALL)
SELECT l_suppkey, day, l_quantity, CASE WHEN coalesce(x.n, 0) > coalesce(y.n, 0) THEN 'first' ELSE 'second' END AS side,
  abs(coalesce(x.n, 0) - coalesce(y.n, 0)) AS copies
FROM x FULL JOIN y USING (l_suppkey, day, l_quantity) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def two_way_difference(spark, sf):
    t = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_quantity", "l_returnflag")
    a, b = (t.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "NR")
    return align.two_way_difference(a, b)


@query("jn1_product_mid_price", f"""
WITH {RAW}, {FX}, {CAL},
g AS (SELECT r.series_id, r.date, r.close, last_value(f.fx IGNORE NULLS) OVER (PARTITION BY r.series_id ORDER BY r.date ROWS UNBOUNDED PRECEDING) AS fx
      FROM raw r LEFT JOIN fx f USING (date)),
s AS (SELECT DISTINCT series_id, date_trunc('month', date) AS month FROM raw),
j AS (SELECT s.series_id, c.date, g.close * g.fx / 31.1034768 AS mid, g.date IS NOT NULL AS hit, c.sub_status, c.red_status
      FROM cal c JOIN s ON s.month = date_trunc('month', c.date) LEFT JOIN g ON g.date = c.date AND g.series_id = s.series_id)
SELECT series_id, date, round(last_value(mid IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS mid,
  hit AND sub_status = 'open' AS tradable FROM j""")
def product_mid_price(spark, sf):
    """Price of each series in product units on the product's own calendar, carried over source holidays."""
    raw = raw_bars(spark, sf).select("series_id", "date", "close")
    gold = materialise(align.align_exact_ffill(raw, fx_rates(spark, sf), K, "date", ["fx"], on=["date"]))
    mid = gold.select("series_id", "date", convert_unit("close", "fx").alias("mid"))
    sessions = align.expected_sessions(product_calendar(spark, sf).select("date", "sub_status"), gold, K, "date")
    frame = align.calendar_flag(sessions, gold, [*K, "date"], "hit")
    frame = align.align_exact_ffill(frame, mid, K, "date", ["mid"])
    return frame.select("series_id", "date", F.round("mid", 4).alias("mid"), (F.col("hit") & (F.col("sub_status") == "open")).alias("tradable"))
