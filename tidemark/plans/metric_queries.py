"""AGG and TOP: performance of simple rules on the daily bars."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import month_key, ordered
from tidemark.operators import align
from tidemark.operators import indicators as ind
from tidemark.operators import metrics as met
from tidemark.operators import signals as sig
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import FEATURES, W
from tidemark.plans.views import BARS, PHASES, PHASES_SQL, RAW, index_bars, raw_bars
from tidemark.session import materialise

K = ["series_id", "strategy"]
TREND_DAYS = {"trend30": 30, "trend60": 60, "trend120": 120}
COST = 0.003


def strategy_weights(spark, sf, trends=tuple(TREND_DAYS)):
    """Bars with the delayed weight of the named trend rules and of holding."""
    df = index_bars(spark, sf).select("series_id", "date", "open", "high", "low", "close")
    df = ind.moving_means(df, ["series_id"], "date", "close", [TREND_DAYS[t] for t in trends])
    w = ordered(["series_id"], "date")
    rules = {t: sig.latest_event(sig.hysteresis_event("close", f"ma_{TREND_DAYS[t]}", 0.02), ["series_id"], "date") for t in trends}
    df = df.withColumns(rules)
    df = df.withColumns({name: F.lag(name, 1, 0.0).over(w) for name in rules}).withColumn("hold", F.lit(1.0))
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("weight")) for n in [*rules, "hold"]])
    return df.select("series_id", "date", "open", "high", "low", "close", F.inline(pairs))


def curves(spark, sf, cost=COST):
    return met.equity_curve(strategy_weights(spark, sf), K, "date", cost=cost)


def weights_sql():
    parts = [f"SELECT series_id, date, i, '{n}' AS strategy, lag(tr{d}, 1, 0.0::DOUBLE) OVER ({W}) AS weight FROM f2" for n, d in TREND_DAYS.items()]
    parts.append("SELECT series_id, date, i, 'hold' AS strategy, 1.0::DOUBLE AS weight FROM f2")
    return f"wts AS (SELECT x.*, b.open, b.close, b.high, b.low FROM ({' UNION ALL '.join(parts)}) x JOIN bars b USING (series_id, date))"


def curve_sql(src="wts", out="curve", keys="series_id, strategy", cost=COST):
    return f"""
{out}_a AS (SELECT *, lag(weight, 1, 0.0::DOUBLE) OVER w AS old, lag(close) OVER w AS pc FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY date)),
{out}_b AS (SELECT *, coalesce(1 + old * (open / pc - 1), 1.0) AS ov, {cost}::DOUBLE * abs(weight - old) AS c, abs(weight - old) > 1e-12 AS traded FROM {out}_a),
{out}_c AS (SELECT *, 100.0::DOUBLE * exp(sum(ln(ov * (1 - c) * (1 + weight * (close / open - 1)))) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM {out}_b),
{out} AS (SELECT *, lag(equity, 1, 100.0::DOUBLE) OVER (PARTITION BY {keys} ORDER BY date) AS prior, lag(equity, 1, 100.0::DOUBLE) OVER (PARTITION BY {keys} ORDER BY date) * ov * c AS fee FROM {out}_c)"""


def perf_sql(src, out="perf", keys="series_id, strategy, phase"):
    """src has equity, prior, weight, fee, traded, phase and p_start."""
    return f"""
{out}_d AS (SELECT *, equity / max(greatest(prior, equity)) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {src}),
{out}_g AS (SELECT {keys}, arg_max(equity, date) / arg_min(prior, date) AS g, greatest((max(date) - min(p_start)) / 365.25, 1 / 365.25) AS y, min(dd) AS dd,
   avg(weight) AS aw, max(weight) AS mw, arg_max(equity, date) AS final, sum(fee) AS fees, count(*) FILTER (traded) AS trade_days FROM {out}_d GROUP BY ALL),
{out} AS (SELECT {keys}, (g - 1) * 100 AS return_pct, (pow(g, 1 / y) - 1) * 100 AS cagr_pct, least(dd, 0) * 100 AS max_drawdown_pct, aw * 100 AS average_weight_pct,
   mw * 100 AS max_weight_pct, final, fees, trade_days FROM {out}_g)"""


METRICS = ["return_pct", "cagr_pct", "max_drawdown_pct", "average_weight_pct", "max_weight_pct", "final", "fees"]


def rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in METRICS], "trade_days")


def rounded_sql(keys, src="perf"):
    return f"SELECT {keys}, {', '.join(f'round({c}, 4) AS {c}' for c in METRICS)}, trade_days FROM {src}"


BASE = f"WITH {BARS}, {FEATURES}, {weights_sql()}, {curve_sql()}"
IN_PHASES = f"{PHASES_SQL}, ph AS (SELECT c.*, phase, p_start FROM curve c JOIN phases ON date BETWEEN p_start AND p_end), {perf_sql('ph')}"


@query("led1_equity_curve", f"{BASE} SELECT series_id, strategy, date, weight, round(equity, 4) AS equity, round(fee, 4) AS fee, traded FROM curve")
def equity_curve(spark, sf):
    return curves(spark, sf).select("series_id", "strategy", "date", "weight", F.round("equity", 4).alias("equity"), F.round("fee", 4).alias("fee"), "traded")


@query("agg1_trend_against_hold", f"{BASE}, {IN_PHASES} {rounded_sql('series_id, strategy, phase')} WHERE strategy IN ('trend120', 'hold') AND phase = 'full'")
def trend_against_hold(spark, sf):
    """Per series: return, CAGR and drawdown of a 120-day trend rule and of holding."""
    df = strategy_weights(spark, sf, ["trend120"])
    perf = met.performance(met.equity_curve(df, K, "date", cost=COST), K, "date", [PHASES[-1]])
    return rounded(perf, *K, "phase")


@query("agg1_phase_metrics", f"{BASE}, {IN_PHASES} {rounded_sql('series_id, strategy, phase')}")
def phase_metrics(spark, sf):
    return rounded(met.performance(curves(spark, sf), K, "date", PHASES), *K, "phase")


YEARS_SQL = "yr AS (SELECT c.*, CAST(year(date) AS VARCHAR) AS phase, greatest(CAST(date_trunc('year', date) AS DATE), DATE '1995-03-01') AS p_start FROM curve c)"


@query("agg2_phase_and_year_metrics", f"""{BASE}, {PHASES_SQL}, {YEARS_SQL},
al AS (SELECT c.*, phase, p_start FROM curve c JOIN phases ON date BETWEEN p_start AND p_end UNION ALL BY NAME SELECT * FROM yr), {perf_sql('al')} {rounded_sql('series_id, strategy, phase')}""")
def phase_and_year_metrics(spark, sf):
    return rounded(met.performance(curves(spark, sf), K, "date", PHASES, years=True, run_start="1995-03-01"), *K, "phase")


@query("agg3_excess_over_hold", f"""{BASE}, {YEARS_SQL}, {perf_sql('yr')}
SELECT p.series_id, p.strategy, p.phase, round(p.return_pct, 4) AS return_pct, round(p.return_pct - h.return_pct, 4) AS excess_return_pp, round(p.cagr_pct - h.cagr_pct, 4) AS excess_cagr_pp
FROM perf p JOIN perf h ON h.series_id = p.series_id AND h.phase = p.phase AND h.strategy = 'hold' WHERE p.strategy <> 'hold'""")
def excess_over_hold(spark, sf):
    perf = met.performance(curves(spark, sf), K, "date", years=True, run_start="1995-03-01")
    out = met.excess(perf, ["series_id", "phase"], F.col("strategy") == "hold")
    return out.select(*K, "phase", *[F.round(c, 4).alias(c) for c in ("return_pct", "excess_return_pp", "excess_cagr_pp")])


@query("agg4_windows_with_capital_reset", f"""WITH {BARS}, {FEATURES}, {weights_sql()}, {PHASES_SQL},
wp AS (SELECT x.*, phase, p_start FROM wts x JOIN phases ON date BETWEEN p_start AND p_end), {curve_sql('wp', 'curve', 'series_id, strategy, phase')}, {perf_sql('curve')} {rounded_sql('series_id, strategy, phase')}""")
def windows_with_capital_reset(spark, sf):
    return rounded(met.reset_performance(strategy_weights(spark, sf), K, "date", PHASES, cost=COST), *K, "phase")


@query("agg5_rolling_year_audit", f"""{BASE}, mm AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS m FROM curve),
mb AS (SELECT series_id, strategy, min(m) AS f, max(m) AS l FROM mm GROUP BY ALL),
en AS (SELECT DISTINCT mm.series_id, mm.strategy, CAST(m + to_months(k) AS DATE) AS phase FROM mm, range(12) r(k)),
rw AS (SELECT mm.*, en.phase, CAST(en.phase - INTERVAL 11 MONTH AS DATE) AS p_start FROM mm JOIN en ON en.series_id = mm.series_id AND en.strategy = mm.strategy AND mm.m BETWEEN en.phase - INTERVAL 11 MONTH AND en.phase
  JOIN mb ON mb.series_id = mm.series_id AND mb.strategy = mm.strategy AND en.phase - INTERVAL 11 MONTH >= mb.f AND en.phase <= mb.l), {perf_sql('rw')}
SELECT series_id, strategy, count(*) AS windows, count(*) FILTER (max_drawdown_pct < -3) AS risk_breaches, count(*) FILTER (average_weight_pct > 70) AS exposure_breaches FROM perf GROUP BY 1, 2""")
def rolling_year_audit(spark, sf):
    return met.rolling_year_audit(curves(spark, sf), K, "date", worst_drawdown=-3.0)


@query("agg6_feasible_rules", f"""{BASE}, {IN_PHASES}
SELECT strategy, bool_and(max_drawdown_pct > -15 AND average_weight_pct <= 70) AS feasible FROM perf WHERE phase IN ('early', 'middle') GROUP BY 1""")
def feasible_rules(spark, sf):
    return met.feasible(met.performance(curves(spark, sf), K, "date", PHASES), ["strategy"], ["early", "middle"])


SCORE = """sp AS (SELECT strategy, series_id, sum(ln(return_pct / 100 + 1)) AS g, bool_and(max_drawdown_pct > -60 AND average_weight_pct <= 100) AS ok FROM perf WHERE phase IN ('early', 'middle') GROUP BY 1, 2),
sc AS (SELECT strategy, bool_and(ok) AS feasible, CASE WHEN bool_and(ok) THEN exp(min(g) / 4.0) - 1 ELSE -999.0 END AS score FROM sp GROUP BY 1)"""


def _scores(spark, sf):
    perf = met.performance(curves(spark, sf), K, "date", PHASES)
    return met.worst_product_score(perf, ["strategy"], "series_id", ["early", "middle"], limits=(-60.0, 100.0))


@query("agg7_worst_product_score", f"{BASE}, {IN_PHASES}, {SCORE} SELECT strategy, feasible, round(score, 6) AS score FROM sc")
def worst_product_score(spark, sf):
    return _scores(spark, sf).select("strategy", "feasible", F.round("score", 6).alias("score"))


EPISODES = """h1 AS (SELECT *, weight > 1e-10 AS held, coalesce(lag(weight) OVER w > 1e-10, false) AS was, lag(equity) OVER w AS before FROM curve WINDOW w AS (PARTITION BY series_id, strategy ORDER BY date)),
h2 AS (SELECT *, sum(CASE WHEN held AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS episode FROM h1),
ep AS (SELECT series_id, strategy, CAST(episode AS BIGINT) AS episode, min(date) AS buy_date, max(CASE WHEN NOT held THEN date END) AS sell_date, arg_min(coalesce(before, equity), date) AS starting_equity,
  arg_max(equity, date) AS ending_equity, sum(fee) AS cost, count(*) FILTER (traded) AS trade_days, CAST(max(date) - min(date) AS INTEGER) AS calendar_days FROM h2 WHERE held OR was GROUP BY ALL)"""
EPISODE_COLS = ["starting_equity", "ending_equity", "cost", "net_pnl", "return_pct"]


@query("agg8_holding_episodes", f"""{BASE}, {EPISODES}, e2 AS (SELECT *, ending_equity - starting_equity AS net_pnl, (ending_equity - starting_equity) / starting_equity * 100 AS return_pct FROM ep)
SELECT series_id, strategy, episode, buy_date, sell_date, trade_days, calendar_days, {', '.join(f'round({c}, 4) AS {c}' for c in EPISODE_COLS)} FROM e2""")
def holding_episodes(spark, sf):
    out = met.holding_episodes(curves(spark, sf), K, "date")
    return out.select(*K, "episode", "buy_date", "sell_date", "trade_days", "calendar_days", *[F.round(c, 4).alias(c) for c in EPISODE_COLS])


@query("agg9_source_coverage", f"""WITH {RAW}, v AS (SELECT *, CASE WHEN n > 1 THEN close END AS value FROM raw)
SELECT series_id, count(*) AS rows, count(value) AS valid, min(CASE WHEN value IS NOT NULL THEN date END) AS first, max(CASE WHEN value IS NOT NULL THEN date END) AS last FROM v GROUP BY 1""")
def source_coverage(spark, sf):
    df = raw_bars(spark, sf).withColumn("value", F.when(F.col("n") > 1, F.col("close")))
    return met.coverage_report(df, ["series_id"], "date", "value")


@query("agg10_monthly_index", f"""WITH {BARS}, m AS (SELECT series_id, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY series_id, date_trunc('month', date))
SELECT series_id, date, round(close / first_value(close) OVER (PARTITION BY series_id ORDER BY date) * 100, 4) AS rebased FROM m""")
def monthly_index(spark, sf):
    bars = index_bars(spark, sf).select("series_id", "date", "close")
    monthly = ind.last_of_period(bars, ["series_id"], "date", month_key("date"))
    return ind.rebase(monthly, ["series_id"], "date", "close").select("series_id", "date", F.round("rebased", 4).alias("rebased"))


@query("agg11_portfolio_roll_up", f"""{BASE}, l AS (SELECT series_id, strategy, arg_max(equity, date) AS final, sum(fee) AS fees, avg(weight) AS aw FROM curve GROUP BY 1, 2)
SELECT strategy, round(sum(final), 4) AS final, round(sum(fees), 4) AS fees, round(avg(aw) * 100, 4) AS average_weight_pct FROM l GROUP BY 1""")
def portfolio_roll_up(spark, sf):
    per = curves(spark, sf).groupBy(*K).agg(F.max_by("equity", "date").alias("final"), F.sum("fee").alias("fees"), F.avg("weight").alias("aw"))
    return per.groupBy("strategy").agg(F.round(F.sum("final"), 4).alias("final"), F.round(F.sum("fees"), 4).alias("fees"), F.round(F.avg("aw") * 100, 4).alias("average_weight_pct"))


@query("agg12_unbalanced_sleeves", f"""{BASE} SELECT a.series_id, a.date, round(0.5 * a.equity + 0.5 * b.equity, 4) AS equity,
 round((0.5 * a.equity * a.weight + 0.5 * b.equity * b.weight) / (0.5 * a.equity + 0.5 * b.equity), 6) AS weight
FROM curve a JOIN curve b USING (series_id, date) WHERE a.strategy = 'trend60' AND b.strategy = 'hold'""")
def unbalanced_sleeves(spark, sf):
    out = met.sleeves(curves(spark, sf), ["series_id", "date"], F.col("strategy") == "trend60", F.col("strategy") == "hold")
    return out.select("series_id", "date", F.round("equity", 4).alias("equity"), F.round("weight", 6).alias("weight"))


BANDS = [dict(id="A", start="1996-01-01", end="1996-01-31", lower=95, upper=105), dict(id="B", start="1997-06-01", end="1997-07-31", lower=90, upper=120),
         dict(id="C", start="1999-01-01", end="1999-12-31", lower=80, upper=101), dict(id="D", start="2000-01-01", end="2000-01-07", lower=99, upper=200)]


@query("agg13_forecast_band_scoring", f"""WITH {BARS}, bands(band, a, z, lower, upper) AS (VALUES {', '.join(f"('{b['id']}', DATE '{b['start']}', DATE '{b['end']}', {b['lower']}, {b['upper']})" for b in BANDS)})
SELECT series_id, band, count(*) AS n, arg_max(close, date) AS last, round(min(low), 6) AS low, round(max(high), 6) AS high, count(*) FILTER (close BETWEEN lower AND upper) AS close_inside,
 arg_max(close BETWEEN lower AND upper, date) AS endpoint_inside, bool_and(bars.low >= lower AND bars.high <= upper) AS all_intraday_inside, min(CASE WHEN NOT (bars.low >= lower AND bars.high <= upper) THEN date END) AS first_breach
FROM bars JOIN bands ON date BETWEEN a AND z GROUP BY 1, 2""")
def forecast_band_scoring(spark, sf):
    out = met.score_bands(index_bars(spark, sf), ["series_id"], "date", BANDS)
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("agg14_neighbourhood_summary", f"""{BASE}, {IN_PHASES}, x AS (SELECT p.series_id, p.phase, p.return_pct, p.return_pct > h.return_pct AS beat FROM perf p JOIN perf h ON h.series_id = p.series_id AND h.phase = p.phase AND h.strategy = 'hold' WHERE p.strategy <> 'hold')
SELECT phase, count(*) AS candidates, round(avg(return_pct), 4) AS mean_return, round(median(return_pct), 4) AS median_return, count(*) FILTER (beat) AS beating FROM x GROUP BY 1""")
def neighbourhood_summary(spark, sf):
    perf = met.performance(curves(spark, sf), K, "date", PHASES)
    x = met.excess(perf, ["series_id", "phase"], F.col("strategy") == "hold")
    return x.groupBy("phase").agg(F.count(F.lit(1)).alias("candidates"), F.round(F.avg("return_pct"), 4).alias("mean_return"),
                                  F.round(F.median("return_pct"), 4).alias("median_return"), F.count_if(F.col("excess_return_pp") > 0).alias("beating"))


@query("top1_best_per_family", f"""{BASE}, {IN_PHASES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, phase ORDER BY round(return_pct, 6) DESC, strategy) AS rn FROM perf)
SELECT series_id, phase, strategy, round(return_pct, 4) AS return_pct FROM r WHERE rn = 1""")
def best_per_family(spark, sf):
    perf = met.performance(curves(spark, sf), K, "date", PHASES)
    best = align.first_in_group(perf, ["series_id", "phase"], F.round("return_pct", 6).desc(), "strategy")
    return best.select("series_id", "phase", "strategy", F.round("return_pct", 4).alias("return_pct"))


@query("top2_three_feasible_in_frozen_order", f"""{BASE}, {IN_PHASES}, {SCORE} SELECT strategy, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, strategy) AS INTEGER) AS place
FROM sc WHERE feasible ORDER BY score DESC, strategy LIMIT 3""")
def three_feasible_in_frozen_order(spark, sf):
    top = _scores(spark, sf).filter("feasible").orderBy(F.desc("score"), "strategy").limit(3)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "strategy"))
    return top.select("strategy", F.round("score", 6).alias("score"), place.alias("place"))


@query("top3_last_sessions", f"""WITH {RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM raw)
SELECT series_id, date, close, CAST(back AS INTEGER) AS back FROM r WHERE back <= 30""")
def last_sessions(spark, sf):
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))
    return raw_bars(spark, sf).select("series_id", "date", "close", back.alias("back")).filter("back <= 30")


@query("top4_best_return_within_drawdown", f"""{BASE}, {IN_PHASES}, c AS (SELECT p.* FROM perf p JOIN perf b ON b.series_id = p.series_id AND b.phase = p.phase AND b.strategy = 'trend120'
  WHERE p.strategy <> 'trend120' AND round(p.max_drawdown_pct, 6) >= round(b.max_drawdown_pct, 6)), r AS (SELECT *, rank() OVER (PARTITION BY phase ORDER BY round(return_pct, 6) DESC) AS place FROM c)
SELECT phase, series_id, strategy, round(return_pct, 4) AS return_pct, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def best_return_within_drawdown(spark, sf):
    perf = met.performance(curves(spark, sf), K, "date", PHASES)
    limit = F.max(F.when(F.col("strategy") == "trend120", F.round("max_drawdown_pct", 6))).over(Window.partitionBy("series_id", "phase"))
    kept = perf.withColumn("floor", limit).filter("strategy <> 'trend120'").filter(F.round("max_drawdown_pct", 6) >= F.col("floor"))
    kept = materialise(kept.select("phase", "series_id", "strategy", "return_pct", F.round("return_pct", 6).alias("score")))
    return align.top_ranked(kept, ["phase"], "score", 10).select("phase", "series_id", "strategy", F.round("return_pct", 4).alias("return_pct"), "place")


@query("top5_all_combinations_ranked", f"""{BASE}, {IN_PHASES}
SELECT series_id, strategy, phase, CAST(dense_rank() OVER (PARTITION BY phase ORDER BY round(return_pct, 6) DESC) AS INTEGER) AS place FROM perf""")
def all_combinations_ranked(spark, sf):
    perf = materialise(met.performance(curves(spark, sf), K, "date", PHASES).select(*K, "phase", F.round("return_pct", 6).alias("r")))
    return align.dense_rank_all(perf, ["phase"], "r", spread=True).drop("r")
