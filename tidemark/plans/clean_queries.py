"""PRJ and DQ: scalar expressions and data-quality checks."""

from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import align, clean
from tidemark.operators import indicators as ind
from tidemark.plans.registry import query
from tidemark.plans.views import (BARS, CAL, FX, NEWS, RAW, fx_rates, index_bars, kept_bars, news, product_calendar, raw_bars,
                                  table)
from tidemark.session import materialise

K = ["series_id"]


def by_date():
    return sc.ordered(K, "date")


@query("prj1_unit_conversion", f"""
WITH {RAW}, {FX} SELECT series_id, date, round(close * fx / 31.1034768, 4) AS per_gram FROM raw JOIN fx USING (date)""")
def unit_conversion(spark, sf):
    df = raw_bars(spark, sf).join(fx_rates(spark, sf), "date")
    return df.select("series_id", "date", F.round(sc.convert_unit("close", "fx"), 4).alias("per_gram"))


@query("prj2_simple_return", f"""
WITH {BARS} SELECT series_id, date, round(close / lag(close, 60) OVER w - 1, 6) AS r60, round(close / lag(close, 1) OVER w - 1, 6) AS r1
FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
def simple_return(spark, sf):
    return index_bars(spark, sf).select("series_id", "date", F.round(sc.simple_return("close", 60, by_date()), 6).alias("r60"),
                                        F.round(sc.simple_return("close", 1, by_date()), 6).alias("r1"))


@query("prj3_difference", f"""
WITH {BARS} SELECT series_id, date, round(close - lag(close, 60) OVER (PARTITION BY series_id ORDER BY date), 6) AS d60 FROM bars""")
def difference(spark, sf):
    return index_bars(spark, sf).select("series_id", "date", F.round(sc.difference("close", 60, by_date()), 6).alias("d60"))


@query("prj4_clip", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_discount IS NULL THEN NULL ELSE least(greatest(l_discount, 0.02), 0.08) END AS clipped,
  round(CASE WHEN l_tax = 0 THEN 1.0 ELSE least(greatest(0.03 / l_tax, 0.2), 1.0) END, 6) AS scaled FROM lineitem""")
def clip(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.clip("l_discount", 0.02, 0.08).alias("clipped"),
        F.round(sc.ratio_clip(F.lit(0.03), "l_tax", 0.2, 1.0), 6).alias("scaled"))


@query("prj5_quantise", """
SELECT o_orderkey, round(round_even(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 700001.0 END, 0.0) / 0.05, 0) * 0.05, 6) AS weight
FROM orders""")
def quantise(spark, sf):
    share = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 700001.0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(sc.quantise(share), 6).alias("weight"))


@query("prj6_floor_to_lot", """
SELECT o_orderkey, floor((o_totalprice / 31.1034768 + 1e-8) * 100) / 100 AS cents,
  floor((o_totalprice / 31.1034768 + 1e-8) * 10000) / 10000 AS metal FROM orders""")
def floor_to_lot(spark, sf):
    x = F.col("o_totalprice") / 31.1034768
    return table(spark, sf, "orders").select("o_orderkey", sc.floor_to(x, 2).alias("cents"), sc.floor_to(x, 4).alias("metal"))


@query("prj7_tiered_rate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CASE WHEN l_quantity < 7 THEN 0.015 WHEN l_quantity < 30 THEN 0.005 ELSE 0 END AS DOUBLE) AS rate FROM lineitem""")
def tiered_rate(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.tiered_rate("l_quantity").alias("rate"))


_VOLUME_TEXT = """CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey AS VARCHAR) || '.25K'
  WHEN o_orderpriority = '2-HIGH' THEN CAST(o_custkey AS VARCHAR) || 'm' WHEN o_orderpriority = '3-MEDIUM' THEN '-'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '1,' || CAST(o_custkey AS VARCHAR) ELSE 'n.a.' END"""


@query("prj8_scaled_number_text", f"""
WITH t AS (SELECT o_orderkey, upper(replace({_VOLUME_TEXT}, ',', '')) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v LIKE '%K' THEN TRY_CAST(v[:-2] AS DOUBLE) * 1e3 WHEN v LIKE '%M' THEN TRY_CAST(v[:-2] AS DOUBLE) * 1e6
  ELSE TRY_CAST(v AS DOUBLE) END AS volume FROM t""")
def scaled_number_text(spark, sf):
    text = F.expr(_VOLUME_TEXT.replace("VARCHAR", "STRING"))
    return table(spark, sf, "orders").select("o_orderkey", sc.parse_scaled_number(text).alias("volume"))


@query("prj9_time_to_utc", """
WITH e AS (SELECT event_id, date_trunc('second', ts) AS s, date_trunc('minute', ts) AS m, event_type, event_id % 4 AS form FROM events)
SELECT event_id,
  CASE event_type
    WHEN 'click' THEN s - INTERVAL 8 HOUR
    WHEN 'view' THEN s + INTERVAL 210 MINUTE
    WHEN 'error' THEN NULL
    WHEN 'purchase' THEN CASE form WHEN 0 THEN s WHEN 1 THEN m + INTERVAL 5 HOUR WHEN 2 THEN s + INTERVAL 7 HOUR ELSE m END
    ELSE s END AS utc,
  CASE event_type WHEN 'error' THEN 'not a time' END AS kept_text FROM e""")
def time_to_utc(spark, sf):
    s = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    form = F.col("event_id") % 4
    mail = lambda pattern, zone: F.concat(F.date_format(s, pattern), F.lit(zone))
    bought = (
        F.when(form == 0, F.date_format(s, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, mail("d MMM yy HH:mm", " EST"))
        .when(form == 2, mail("EEE, dd MMM yyyy HH:mm:ss", " PDT"))
        .otherwise(mail("EEE, dd MMM yyyy HH:mm", " +0000"))
    )
    text = (
        F.when(F.col("event_type") == "click", mail("yyyy-MM-dd'T'HH:mm:ss", "+08:00"))
        .when(F.col("event_type") == "view", mail("EEE, dd MMM yyyy HH:mm:ss", " -0330"))
        .when(F.col("event_type") == "signup", mail("EEE, dd MMM yyyy HH:mm:ss", " GMT"))
        .when(F.col("event_type") == "purchase", bought)
        .otherwise(F.lit("not a time"))
    )
    df = table(spark, sf, "events").select("event_id", text.alias("raw")).withColumn("utc", sc.to_utc("raw"))
    return df.select("event_id", "utc", F.when(F.col("utc").isNull(), F.col("raw")).alias("kept_text"))


@query("prj10_stable_id", f"WITH {NEWS} SELECT doc_id, substr(sha256(source || '|' || link), 1, 20) AS id FROM news")
def stable_id(spark, sf):
    return news(spark, sf).select("doc_id", sc.stable_id("source", "link").alias("id"))


@query("prj11_language_tag", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM documents""")
def language_tag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.cjk_lang("text").alias("language"))


@query("prj12_period_keys", f"""
WITH {RAW} SELECT DISTINCT date, CAST(date_trunc('month', date) AS DATE) AS month,
  date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS week_end FROM raw""")
def period_keys(spark, sf):
    return raw_bars(spark, sf).select("date", sc.month_key("date").alias("month"), sc.week_ending_friday("date").alias("week_end")).distinct()


@query("prj13_midnight_bars_only", """
SELECT event_id, d AS ts FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN ts ELSE date_trunc('day', ts) END AS d FROM events)
WHERE d = date_trunc('day', d)""")
def midnight_bars_only(spark, sf):
    ts = F.when(F.col("event_type") == "view", F.col("ts")).otherwise(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
    return table(spark, sf, "events").select("event_id", ts.alias("ts")).filter(sc.is_local_midnight("ts"))


@query("prj14_asof_cut", """
SELECT count(*) FILTER (o_orderdate < DATE '1998-01-05') AS before_run, count(*) FILTER (o_orderdate <= DATE '1998-01-05') AS through_run
FROM orders WHERE o_orderdate <= DATE '1998-01-05'""")
def asof_cut(spark, sf):
    run = F.lit("1998-01-05").cast("timestamp_ntz")
    rows = table(spark, sf, "orders").filter(F.col("o_orderdate") <= run)
    return rows.agg(F.count_if(F.col("o_orderdate") < run).alias("before_run"), F.count(F.lit(1)).alias("through_run"))


@query("prj15_bar_shape", f"""
WITH {BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM bars)
SELECT series_id, date, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction, least(open, close) AS body_low,
  round(greatest(abs(close - open), 0.15), 6) AS body_height, back = 1 AS pending FROM b""")
def bar_shape(spark, sf):
    newest = F.row_number().over(sc.ordered(K, F.desc("date"))) == 1
    return index_bars(spark, sf).select(
        "series_id", "date", F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("direction"),
        F.least("open", "close").alias("body_low"),
        F.round(F.greatest(F.abs(F.col("close") - F.col("open")), F.lit(0.15)), 6).alias("body_height"), newest.alias("pending"))


@query("prj16_tradable_flags", f"""
WITH {CAL} SELECT date, sub_status = 'open' AS can_buy, red_status = 'open' AS can_sell, sub_status = 'open' AND red_status = 'open' AS both_open FROM cal""")
def tradable_flags(spark, sf):
    buy, sell = F.col("sub_status") == "open", F.col("red_status") == "open"
    return product_calendar(spark, sf).select("date", buy.alias("can_buy"), sell.alias("can_sell"), (buy & sell).alias("both_open"))


@query("prj17_common_cutoff", f"""
WITH {BARS}, {CAL}, {FX}, c AS (SELECT least((SELECT max(date) FROM bars WHERE series_id = 'AF'), (SELECT max(date) FROM cal), (SELECT max(date) FROM fx)) AS d)
SELECT series_id, date, close FROM bars WHERE date <= (SELECT d FROM c)""")
def common_cutoff(spark, sf):
    bars = kept_bars(spark, sf)
    cut = align.common_cutoff([bars.filter("series_id = 'AF'").select("date"), product_calendar(spark, sf).select("date"),
                               fx_rates(spark, sf).select("date")], "date")
    return bars.filter(F.col("date") <= cut).select("series_id", "date", "close")


@query("prj18_target_cap_and_scale", """
WITH t AS (SELECT o_orderkey, o_totalprice / 500003.0 AS w FROM orders)
SELECT o_orderkey, round(round_even(least(w, 0.85) / 0.05, 0) * 0.05, 6) AS capped, round(round_even(w * 0.85 / 0.05, 0) * 0.05, 6) AS scaled FROM t""")
def target_cap_and_scale(spark, sf):
    w = F.col("o_totalprice") / 500003.0
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(sc.quantise(F.least(w, F.lit(0.85))), 6).alias("capped"), F.round(sc.quantise(w * 0.85), 6).alias("scaled"))


@query("prj19_basis_point_spread", f"""
WITH {BARS} SELECT a.date, round((a.close - b.close) * 100, 4) AS spread_bp FROM bars a JOIN bars b USING (date) WHERE a.series_id = 'AO' AND b.series_id = 'RO'""")
def basis_point_spread(spark, sf):
    pick = lambda s: F.max(F.when(F.col("series_id") == s, F.col("close")))
    both = index_bars(spark, sf).filter(F.col("series_id").isin("AO", "RO")).groupBy("date").agg(pick("AO").alias("a"), pick("RO").alias("b"))
    return both.dropna().select("date", F.round((F.col("a") - F.col("b")) * 100, 4).alias("spread_bp"))


@query("prj20_range_mid", f"""
WITH {RAW} SELECT series_id, date, (low + high) / 2 AS mid, low <> high AS is_range FROM raw""")
def range_mid(spark, sf):
    return raw_bars(spark, sf).select("series_id", "date", ((F.col("low") + F.col("high")) / 2).alias("mid"), (F.col("low") != F.col("high")).alias("is_range"))


# data quality


@query("dq1_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return clean.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_BENT = "CASE WHEN n = 3 THEN low * 0.5 ELSE high END"


@query("dq2_ohlc_envelope", f"""
WITH {RAW}, b AS (SELECT * REPLACE ({_BENT} AS high) FROM raw)
SELECT 'ohlc_envelope' AS rule, series_id, date FROM b WHERE NOT (high >= greatest(open, close, low) AND low <= least(open, close, high))""")
def ohlc_envelope(spark, sf):
    bars = raw_bars(spark, sf).withColumn("high", F.expr(_BENT))
    return clean.violations(bars, "ohlc_envelope", clean.envelope_ok(), ["series_id", "date"])


@query("dq3_dividend_screen", f"""
WITH {CAL}, a AS (SELECT date, nav, CASE WHEN red_status = 'closed' THEN nav * 1.01 ELSE nav * 1.000001 END AS acc FROM cal)
SELECT 'nav_equals_accumulated' AS rule, date FROM a WHERE NOT abs(nav - acc) <= 1e-8 + 1e-5 * abs(acc)""")
def dividend_screen(spark, sf):
    acc = F.when(F.col("red_status") == "closed", F.col("nav") * 1.01).otherwise(F.col("nav") * 1.000001)
    return clean.violations(product_calendar(spark, sf).withColumn("acc", acc), "nav_equals_accumulated", clean.close_to("nav", "acc"), ["date"])


@query("dq4_quarantine", f"""
WITH {BARS}, {CAL}, x AS (SELECT date FROM cal WHERE sub_status = 'closed')
SELECT series_id, date, close, CASE WHEN date IN (SELECT date FROM x) THEN 'previously_excluded_observation' ELSE 'not_independently_verified' END AS quality_flag FROM bars""")
def quarantine(spark, sf):
    bars = kept_bars(spark, sf).select("series_id", "date", "close")
    good, flagged = clean.quarantine(bars, product_calendar(spark, sf).filter("sub_status = 'closed'"), ["date"])
    return good.withColumn("quality_flag", F.lit("not_independently_verified")).unionByName(
        flagged.withColumn("quality_flag", F.lit("previously_excluded_observation")))


@query("dq5_parse_drop_dedupe", """
WITH t AS (SELECT o_orderkey AS pos, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT d AS date, arg_min(price, pos) AS price FROM t WHERE price IS NOT NULL GROUP BY 1""")
def parse_drop_dedupe(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.date_format("o_orderdate", "dd. MMMM yyyy").alias("date_text"),
        F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2)).alias("price_text"))
    parsed = {"date": sc.try_date("date_text", "d. MMMM yyyy"), "price": sc.to_number("price_text")}
    return clean.parse_and_dedupe(o, ["date"], parsed, "pos").select("date", "price")


@query("dq6_cross_source_conflicts", f"""
WITH {RAW}, a AS (SELECT date, close AS a FROM raw WHERE series_id = '1-URGENT'), b AS (SELECT date, close AS b FROM raw WHERE series_id = '2-HIGH')
SELECT date, a, b, round(abs(a - b) / b, 6) AS gap, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' WHEN abs(a - b) / b > 0.1 THEN 'conflict' ELSE 'match' END AS status
FROM a FULL JOIN b USING (date)""")
def cross_source_conflicts(spark, sf):
    raw = raw_bars(spark, sf).select("series_id", "date", "close")
    out = clean.source_conflicts(raw.filter("series_id = '1-URGENT'"), raw.filter("series_id = '2-HIGH'"), ["date"], "close", 0.1)
    return out.select("date", "a", "b", F.round("gap", 6).alias("gap"), "status")


@query("dq7_jump_screen", f"""
WITH {RAW}, j AS (SELECT *, lag(close) OVER (PARTITION BY series_id ORDER BY date) AS previous FROM raw)
SELECT series_id, date, previous, close, round(close / previous - 1, 6) AS move FROM j WHERE abs(close / previous - 1) > 0.1""")
def jump_screen(spark, sf):
    return clean.jump_flags(raw_bars(spark, sf), K, "date", "close", 0.1).select("series_id", "date", "previous", "close", F.round("move", 6).alias("move"))


@query("dq8_missing_dates", f"""
WITH {RAW}, {CAL}, s AS (SELECT DISTINCT series_id, date_trunc('month', date) AS month FROM raw)
SELECT s.series_id, cal.date FROM cal JOIN s ON s.month = date_trunc('month', cal.date) ANTI JOIN raw ON raw.series_id = s.series_id AND raw.date = cal.date""")
def missing_dates(spark, sf):
    """Product sessions on which a series that traded in that month has no bar."""
    raw = materialise(raw_bars(spark, sf).select("series_id", "date"))
    return clean.missing_dates(align.expected_sessions(product_calendar(spark, sf).select("date"), raw, K, "date"), raw, ["series_id", "date"])


@query("dq9_weekday_coverage", f"""
WITH {RAW}, s AS (SELECT series_id, min(date) AS a, max(date) AS b FROM raw GROUP BY 1),
e AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT series_id, date FROM e ANTI JOIN raw USING (series_id, date) WHERE isodow(date) < 6""")
def weekday_coverage(spark, sf):
    raw = raw_bars(spark, sf)
    return clean.missing_dates(clean.expected_weekdays(raw, K, "date"), raw, ["series_id", "date"])


DQ11_COLUMNS = """l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag l_shipdate l_suppkey
    l_tax""".split()
DQ11_SQL = ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in DQ11_COLUMNS)


@query("dq11_table_fingerprint", f"""
WITH l AS (
  SELECT * REPLACE (CAST(l_discount AS DECIMAL(18,4)) AS l_discount, CAST(l_extendedprice AS DECIMAL(18,4)) AS l_extendedprice,
    CAST(l_quantity AS DECIMAL(18,4)) AS l_quantity, CAST(l_tax AS DECIMAL(18,4)) AS l_tax, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate)
  FROM lineitem),
r AS (SELECT l_returnflag, md5(concat({DQ11_SQL})) AS h FROM l)
SELECT l_returnflag, count(*) AS rows, CAST(sum(CAST('0x' || h[1:8] AS BIGINT)) AS VARCHAR) AS digest_a,
  CAST(sum(CAST('0x' || h[9:16] AS BIGINT)) AS VARCHAR) AS digest_b FROM r GROUP BY 1""")
def table_fingerprint(spark, sf):
    rows = table(spark, sf, "lineitem").select(*DQ11_COLUMNS).withColumns({
        **{c: F.col(c).cast("decimal(18,4)") for c in ("l_discount", "l_extendedprice", "l_quantity", "l_tax")},
        "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")})
    return clean.fingerprint(rows, ["l_returnflag"])


@query("dq12_intraday_completeness", """
WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, arg_max(value, (ts, event_id)) AS value,
  CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS volume FROM events GROUP BY 1, 2)
SELECT series_id, CAST(hour AS DATE) AS day, count(*) AS bars, count(*) FILTER (volume = 0) AS zero_volume,
  arg_max(value, hour) AS last_value, count(*) = 24 AS complete FROM h GROUP BY 1, 2""")
def intraday_completeness(spark, sf):
    hourly = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts")).alias("hour")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count_if(F.col("value") > 20).alias("volume"))
    hourly = hourly.withColumn("day", F.col("hour").cast("date"))
    return clean.intraday_completeness(hourly, K, "day", "hour", "value", 24)


@query("dq13_month_coverage", """
WITH d AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_suppkey, min(month) AS a, max(month) AS b FROM d GROUP BY 1),
e AS (SELECT l_suppkey, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM s)
SELECT l_suppkey, month, CASE WHEN d.month IS NULL THEN 'missing' ELSE 'ok' END AS status FROM e LEFT JOIN d USING (l_suppkey, month)""")
def month_coverage(spark, sf):
    months = table(spark, sf, "lineitem").select("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month")).distinct()
    want = clean.expected_months(months, ["l_suppkey"], "month")
    flagged = align.calendar_flag(want, months, ["l_suppkey", "month"], "seen")
    return flagged.select("l_suppkey", "month", F.when(F.col("seen"), "ok").otherwise("missing").alias("status"))


@query("dq14_payload_sanity", """
WITH p AS (SELECT page_id, lower(html) AS h FROM pages)
SELECT page_id, regexp_matches(h, 'verify you are human|enable javascript|captcha|access denied|cf-chl') AS challenge,
  contains(h, '<script') AND NOT contains(h, '<p') AS script_only, length(trim(h)) = 0 AS empty FROM p""")
def payload_sanity(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in clean.payload_flags("html").items()])


@query("dq15_override_sensitivity", f"""
WITH {BARS}, o AS (SELECT series_id, max(date) AS date FROM bars WHERE date < DATE '1999-01-01' GROUP BY 1),
n AS (SELECT b.series_id, b.date, b.close, CASE WHEN o.date IS NULL THEN b.close ELSE b.close * 1.5 END AS c2 FROM bars b LEFT JOIN o USING (series_id, date)),
d AS (SELECT *, close / max(close) OVER w - 1 AS d1, c2 / max(c2) OVER w - 1 AS d2 FROM n WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT series_id, round(min(d1), 6) AS max_drawdown, round(min(d2), 6) AS max_drawdown_after, round(min(d2) - min(d1), 6) AS max_drawdown_change FROM d GROUP BY 1""")
def override_sensitivity(spark, sf):
    bars = kept_bars(spark, sf).select("series_id", "date", "close")
    one = bars.filter(F.col("date") < "1999-01-01").groupBy("series_id").agg(
        F.max("date").alias("date"), (F.max_by("close", "date") * 1.5).alias("close"))

    def worst(df):
        return ind.drawdown(df, K, "date", "close").groupBy("series_id").agg(F.min("drawdown").alias("max_drawdown"))

    out = clean.override_and_diff(bars, one, ["series_id", "date"], "close", worst, K, ["max_drawdown"])
    return out.select("series_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "series_id"])
