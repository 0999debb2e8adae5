"""WIN: windows over daily bars."""

from pyspark.sql import functions as F

from tidemark.functions.scalars import month_key, ordered, simple_return, week_ending_friday
from tidemark.operators import indicators as ind
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, NEWS, index_bars, news, table

K = ["series_id"]


@query("win1_rolling_mean", f"""
WITH {BARS}
SELECT series_id, date,
  round(CASE WHEN i >= 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 9) AS ma20,
  round(CASE WHEN i >= 120 THEN avg(close) OVER (w ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) END, 9) AS ma120
FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
def rolling_mean(spark, sf):
    df = ind.moving_means(index_bars(spark, sf), K, "date", "close", [20, 120])
    return df.select("series_id", "date", F.round("ma_20", 9).alias("ma20"), F.round("ma_120", 9).alias("ma120"))


@query("win2_rolling_max", f"""
WITH {BARS}
SELECT series_id, date, close,
  CASE WHEN i >= 60 THEN max(close) OVER (PARTITION BY series_id ORDER BY date
       ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS high60 FROM bars""")
def rolling_max(spark, sf):
    df = ind.rolling(index_bars(spark, sf), K, "date", "close", "max", 60, "high60")
    return df.select("series_id", "date", "close", "high60")


@query("win3_prior_extremes", f"""
WITH {BARS}
SELECT series_id, date,
  CASE WHEN i > 60 THEN max(close) OVER (PARTITION BY series_id ORDER BY date
       ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS prior_high,
  CASE WHEN i > 20 THEN min(close) OVER (PARTITION BY series_id ORDER BY date
       ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS prior_low FROM bars""")
def prior_extremes(spark, sf):
    df = ind.rolling(index_bars(spark, sf), K, "date", "close", "max", 60, "prior_high", prior=True)
    df = ind.rolling(df, K, "date", "close", "min", 20, "prior_low", prior=True)
    return df.select("series_id", "date", "prior_high", "prior_low")


@query("win4_annual_volatility", f"""
WITH {BARS}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM bars)
SELECT series_id, date, round(CASE WHEN i > 40 THEN stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY date
   ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) END * sqrt(252.0), 6) AS vol FROM r""")
def annual_volatility(spark, sf):
    df = index_bars(spark, sf).withColumn("ret", simple_return("close", 1, ordered(K, "date")))
    return df.select("series_id", "date", F.round(ind.annual_volatility("ret", 40, K, "date"), 6).alias("vol"))


@query("win5_rolling_drawdown", f"""
WITH {BARS}
SELECT series_id, date, round(close / CASE WHEN i >= 60 THEN max(close) OVER (PARTITION BY series_id ORDER BY date
   ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END - 1, 6) AS dd FROM bars""")
def rolling_drawdown(spark, sf):
    df = ind.rolling_drawdown(index_bars(spark, sf), K, "date", "close", 60, "dd")
    return df.select("series_id", "date", F.round("dd", 6).alias("dd"))


@query("win6_drawdown_from_base", f"""
WITH {BARS}
SELECT series_id, date, round(close / greatest(100.0, max(close) OVER (PARTITION BY series_id ORDER BY date
   ROWS UNBOUNDED PRECEDING)) - 1, 6) AS dd FROM bars""")
def drawdown_from_base(spark, sf):
    df = ind.drawdown(index_bars(spark, sf), K, "date", "close", base=100.0, out="dd")
    return df.select("series_id", "date", F.round("dd", 6).alias("dd"))


@query("win7_review_rows", f"""
WITH {BARS}
SELECT series_id, date,
  coalesce(date_trunc('month', date) <> lag(date_trunc('month', date)) OVER w, true) AS new_month,
  coalesce(date_trunc('week', date + 2) <> lag(date_trunc('week', date + 2)) OVER w, true) AS new_week
FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
def review_rows(spark, sf):
    return index_bars(spark, sf).select(
        "series_id", "date",
        ind.period_change(K, "date", month_key("date")).alias("new_month"),
        ind.period_change(K, "date", week_ending_friday("date")).alias("new_week"),
    )


@query("win8_month_end_rows", f"""
WITH {BARS}, m AS (
  SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS mo, max(date) AS date, arg_max(close, date) AS close
  FROM bars GROUP BY 1, 2)
SELECT series_id, date, close FROM m WHERE mo < (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem)""")
def month_end_rows(spark, sf):
    bars = index_bars(spark, sf).select("series_id", "date", "close")
    newest = table(spark, sf, "lineitem").agg(F.trunc(F.max("l_shipdate").cast("date"), "MM"))
    return ind.last_of_period(bars, K, "date", month_key("date"), newest.scalar()).select("series_id", "date", "close")


STATE = """
st AS (SELECT series_id, date, i, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS state FROM bars)"""


def _state(spark, sf):
    bars = index_bars(spark, sf)
    return bars.select("series_id", "date", F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0).alias("state"))


@query("win9_change_points", f"""
WITH {BARS}, {STATE}, c AS (
  SELECT series_id, date, CAST(state AS DOUBLE) AS state,
    CAST(lag(state, 1, 0.0) OVER w AS DOUBLE) AS previous, lag(date) OVER w AS previous_date
  FROM st WINDOW w AS (PARTITION BY series_id ORDER BY date))
SELECT series_id, count(*) AS changes, max(CASE WHEN state = 0 THEN previous_date END) AS last_exit_signal
FROM c WHERE state <> previous GROUP BY 1""")
def change_points(spark, sf):
    moves = ind.change_points(_state(spark, sf), K, "date", "state")
    return moves.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("changes"),
        F.max(F.when(F.col("state") == 0, F.col("previous_date"))).alias("last_exit_signal"),
    )


@query("win10_execution_delay", f"""
WITH {BARS}
SELECT series_id, date, lag(close, 1, 0.0) OVER w AS next_bar,
  CASE WHEN i > 3 THEN lag(close, 3) OVER w ELSE first_value(close) OVER w END AS three_sessions
FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
def execution_delay(spark, sf):
    return index_bars(spark, sf).select(
        "series_id", "date",
        ind.delay("close", 1, K, "date", fill=0.0).alias("next_bar"),
        ind.delay("close", 3, K, "date").alias("three_sessions"),
    )


@query("win11_tail_means", f"""
WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM bars)
SELECT series_id, max(date) AS date, round(avg(close) FILTER (back <= 20), 9) AS ma20,
  round(avg(close) FILTER (back <= 120), 9) AS ma120, round(sum(close) FILTER (back <= 19), 9) AS sum19
FROM t GROUP BY 1""")
def tail_means(spark, sf):
    df = ind.moving_means(index_bars(spark, sf), K, "date", "close", [19, 20, 120])
    last = ind.last_row(df.select("series_id", "date", "ma_19", "ma_20", "ma_120"), K, "date")
    return last.select("series_id", "date", F.round("ma_20", 9).alias("ma20"), F.round("ma_120", 9).alias("ma120"),
                       F.round(F.col("ma_19") * 19, 9).alias("sum19"))


@query("win12_daily_return_with_base", f"""
WITH {BARS}
SELECT series_id, date, round(close / lag(close, 1, 100.0) OVER (PARTITION BY series_id ORDER BY date) - 1, 6) AS ret
FROM bars""")
def daily_return_with_base(spark, sf):
    w = ordered(K, "date")
    ret = F.col("close") / F.lag("close", 1, 100.0).over(w) - 1
    return index_bars(spark, sf).select("series_id", "date", F.round(ret, 6).alias("ret"))


@query("win13_rolling_line_fit", f"""
WITH {BARS}, f AS (
  SELECT series_id, date, i, regr_slope(ln(close), CAST(i AS DOUBLE)) OVER w AS slope,
         regr_r2(ln(close), CAST(i AS DOUBLE)) OVER w AS r2
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
SELECT series_id, date, round(CASE WHEN i >= 120 THEN slope * 252 END, 4) AS annual_slope,
  round(CASE WHEN i >= 120 THEN r2 END, 4) AS r2,
  coalesce(i >= 120 AND r2 >= 0.1 AND slope * 252 >= 0.05, false) AS gate FROM f""")
def rolling_line_fit(spark, sf):
    df = ind.rolling_linreg(index_bars(spark, sf), K, "date", "close", 120)
    gate = (F.col("r2") >= 0.1) & (F.col("annual_slope") >= 0.05)
    return df.select("series_id", "date", F.round("annual_slope", 4).alias("annual_slope"),
                     F.round("r2", 4).alias("r2"), F.coalesce(gate, F.lit(False)).alias("gate"))


@query("win14_rolling_quadratic_fit", f"""
WITH {BARS}, p AS (SELECT a.series_id, a.date, b.i - a.i + 89 AS x, ln(b.close) AS y
    FROM bars a JOIN bars b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 89 AND a.i WHERE a.i >= 90),
s AS (SELECT series_id, date, avg(y) AS ym, sum(y) AS sy, sum((x - 44.5) * y) AS s1,
        sum((x - 44.5) * (x - 44.5) * y) AS s2y, sum((x-44.5)*(x-44.5)) AS u2, sum(pow(x-44.5, 4)) AS u4,
        var_pop(y) * 90 AS tss FROM p GROUP BY 1, 2),
k AS (SELECT *, s1 / u2 AS b, (90 * s2y - u2 * sy) / (90 * u4 - u2 * u2) AS a FROM s)
SELECT series_id, date, round((b + 2 * a * 44.5) * 252, 4) AS annual_end_slope,
  round((b * s1 + a * (s2y - u2 / 90 * sy)) / tss, 4) AS quad_r2 FROM k""")
def rolling_quadratic_fit(spark, sf):
    df = ind.rolling_quadfit(index_bars(spark, sf), K, "date", "close", 90)
    return df.filter(F.col("end_slope").isNotNull()).select(
        "series_id", "date", F.round("annual_end_slope", 4).alias("annual_end_slope"), F.round("quad_r2", 4).alias("quad_r2"))


TREND = """
tr AS (SELECT series_id, date, i,
    CASE WHEN i >= 5 THEN avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS last5,
    CASE WHEN i >= 10 THEN avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END AS previous5,
    CASE WHEN i >= 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS last20
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)),
tf AS (SELECT *, last5 < previous5 AND last5 < last20 AS falling FROM tr)"""


@query("win15_trend_test", f"""
WITH {BARS}, {TREND}
SELECT series_id, date, round(last5, 9) AS last5, round(previous5, 9) AS previous5, round(last20, 9) AS last20,
  coalesce(falling, false) AS falling FROM tf""")
def trend_test(spark, sf):
    df = ind.trend_5_5_20(index_bars(spark, sf), K, "date", "close")
    return df.select("series_id", "date", *[F.round(c, 9).alias(c) for c in ("last5", "previous5", "last20")],
                     F.coalesce("falling", F.lit(False)).alias("falling"))


@query("win16_run_length", f"""
WITH {BARS}, {TREND}, g AS (
  SELECT *, sum(CASE WHEN coalesce(falling, false) THEN 0 ELSE 1 END)
            OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS grp FROM tf)
SELECT series_id, date, CAST(sum(CASE WHEN coalesce(falling, false) THEN 1 ELSE 0 END)
   OVER (PARTITION BY series_id, grp ORDER BY date ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run FROM g""")
def run_length(spark, sf):
    df = ind.trend_5_5_20(index_bars(spark, sf), K, "date", "close")
    return ind.run_length(df, K, "date", "falling").select("series_id", "date", "run")


@query("win17_labour_trigger", """
WITH m AS (
  SELECT o_orderstatus AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(count(*) AS DOUBLE) AS payroll,
         100.0 * count(*) FILTER (o_orderpriority = '5-LOW') / count(*) AS unemployment
  FROM orders GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER w AS i, payroll - lag(payroll) OVER w AS d
      FROM m WINDOW w AS (PARTITION BY series_id ORDER BY month)),
a AS (SELECT *, CASE WHEN i >= 4 THEN avg(d) OVER w END AS payroll_3m,
             CASE WHEN i >= 3 THEN avg(unemployment) OVER w END AS unemployment_3m
      FROM d WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, unemployment_3m - CASE WHEN i >= 15 THEN min(unemployment_3m) OVER (PARTITION BY series_id ORDER BY month
        ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS gap FROM a)
SELECT series_id, month, round(payroll_3m, 4) AS payroll_3m, round(gap, 4) AS gap,
  coalesce(payroll_3m < 0 AND gap >= 0.5 - 1e-9, false) AS triggered FROM g""")
def labour_trigger(spark, sf):
    monthly = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderstatus").alias("series_id"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"))
        .agg(F.count(F.lit(1)).cast("double").alias("payroll"),
             (100.0 * F.count_if(F.col("o_orderpriority") == "5-LOW") / F.count(F.lit(1))).alias("unemployment"))
    )
    df = ind.labour_trigger(monthly, K, "month", "payroll", "unemployment")
    return df.select("series_id", "month", F.round("payroll_3m", 4).alias("payroll_3m"), F.round("gap", 4).alias("gap"), "triggered")


@query("win18_attention_z", f"""
WITH {NEWS}, c AS (SELECT source, CAST(published AS DATE) AS day, count(*) AS n FROM news GROUP BY 1, 2),
s AS (SELECT *, coalesce(sum(n) OVER w, 0) AS s, coalesce(sum(n * n) OVER w, 0) AS q FROM c
  WINDOW w AS (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
v AS (SELECT *, s / 90.0 AS m, (q - s * s / 90.0) / 89.0 AS var FROM s)
SELECT source, day, n, round(m, 4) AS mean_before, round(CASE WHEN var > 1e-12 THEN (n - m) / sqrt(var) END, 4) AS z FROM v""")
def attention_z(spark, sf):
    counts = news(spark, sf).groupBy("source", F.col("published").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    df = ind.attention_z(counts, ["source"], "day", "n")
    return df.select("source", "day", "n", F.round("mean_before", 4).alias("mean_before"), F.round("z", 4).alias("z"))
