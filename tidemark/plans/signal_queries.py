"""SIG: signals over daily bars."""

from pyspark.sql import functions as F

from tidemark.functions.scalars import ordered
from tidemark.operators import indicators as ind
from tidemark.operators import signals as sig
from tidemark.operators.machines import states_by_jumps
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, RAW, index_bars, kept_bars, raw_bars

K = ["series_id"]
RUN = "OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)"


def bars_of(spark, sf):
    return index_bars(spark, sf).select("series_id", "date", "close")


def mean(n):
    return f"CASE WHEN i >= {n} THEN avg(close) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


def hyst(n, b=0.02, ma=None):
    ma = ma or f"ma{n}"
    return (f"coalesce(last_value(CASE WHEN close > {ma} * CAST({1 + b} AS DOUBLE) THEN 1.0::DOUBLE WHEN close < {ma} * CAST({1 - b} AS DOUBLE) "
            f"THEN 0.0::DOUBLE END IGNORE NULLS) {RUN}, 0.0::DOUBLE)")


W = "PARTITION BY series_id ORDER BY date"
FEATURES = f"""
f1 AS (SELECT series_id, date, i, close, {", ".join(f"{mean(n)} AS ma{n}" for n in (30, 60, 90, 120))},
    close / lag(close) OVER ({W}) - 1 AS ret, close / lag(close, 60) OVER ({W}) - 1 AS m60,
    close / lag(close, 120) OVER ({W}) - 1 AS m120, close / lag(close, 252) OVER ({W}) - 1 AS m252,
    CASE WHEN i > 60 THEN max(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS hi60,
    CASE WHEN i > 20 THEN min(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS lo20,
    close / CASE WHEN i >= 60 THEN max(close) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END - 1 AS dd60,
    coalesce(date_trunc('week', date + 2) <> lag(date_trunc('week', date + 2)) OVER ({W}), true) AS new_week,
    coalesce(date_trunc('month', date) <> lag(date_trunc('month', date)) OVER ({W}), true) AS new_month FROM bars),
f2 AS (SELECT *, CASE WHEN i > 40 THEN stddev_samp(ret) OVER ({W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) END * sqrt(252.0) AS vol40,
    CASE WHEN i > 60 THEN stddev_samp(ret) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END * sqrt(252.0) AS vol60,
    {hyst(30)} AS tr30, {hyst(60)} AS tr60, {hyst(120)} AS tr120, {hyst(90, 0.04)} AS tr90w,
    coalesce(last_value(CASE WHEN close >= hi60 THEN 1.0::DOUBLE WHEN close <= lo20 THEN 0.0::DOUBLE END IGNORE NULLS) {RUN}, 0.0::DOUBLE) AS ch FROM f1)"""


def grid(expr):
    return f"round(round_even(coalesce({expr}, 0.0) / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6)"


def scale(target, vol, lo):
    return f"CASE WHEN {vol} IS NULL THEN NULL ELSE least(greatest({target}::DOUBLE / {vol}, {lo}::DOUBLE), 1.0::DOUBLE) END"


CAP = "0.65::DOUBLE"
FAMILY_SQL = {
    "channel": f"ch * {CAP}",
    "trend_trail": f"tr60 * {CAP}",
    "vol_trend": f"tr60 * {CAP} * ({scale(0.12, 'vol40', 0.2)})",
    "ensemble": f"(tr30 + tr60 + tr120) / 3 * {CAP}",
    "dual_momentum": f"(CAST(coalesce(m60 > 0, false) AS INTEGER) + CAST(coalesce(m120 > 0, false) AS INTEGER)) / 2.0::DOUBLE * {CAP} * ({scale(0.12, 'vol40', 0.2)})",
    "pullback": f"tr60 * CASE WHEN close < ma60 * 1.03::DOUBLE THEN {CAP} ELSE {CAP} * 0.5::DOUBLE END",
    "legacy_momentum": f"CASE WHEN m252 > 0 THEN {CAP} * ({scale(0.14, 'vol60', 0.25)}) ELSE 0 END",
    "hold": CAP,
}


def family_sql(name):
    return f"WITH {BARS}, {FEATURES} SELECT series_id, date, {grid(FAMILY_SQL[name])} AS raw FROM f2"


def family(spark, sf, name, **extra):
    spec = dict(spec_id=1, family=name, horizon=60, **extra)
    out = sig.raw_signal(bars_of(spark, sf), K, "date", "close", [spec], spread=False)
    return out.select("series_id", "date", F.round("raw", 6).alias("raw"))


@query("sig1_hysteresis_band", f"WITH {BARS}, {FEATURES} SELECT series_id, date, tr120 AS state FROM f2")
def hysteresis_band(spark, sf):
    return sig.hysteresis(bars_of(spark, sf), K, "date", "close", 120).select("series_id", "date", "state")


@query("sig2_channel_breakout", f"WITH {BARS}, {FEATURES} SELECT series_id, date, round(ch * 0.65, 6) AS state FROM f2")
def channel_breakout(spark, sf):
    df = sig.channel(bars_of(spark, sf), K, "date", "close", 60, 20, cap=0.65)
    return df.select("series_id", "date", F.round("state", 6).alias("state"))


query("sig2_channel_family", family_sql("channel"))(lambda spark, sf: family(spark, sf, "channel"))
query("sig3_trend_times_cap", family_sql("trend_trail"))(lambda spark, sf: family(spark, sf, "trend_trail"))
query("sig4_volatility_targeted_trend", family_sql("vol_trend"))(lambda spark, sf: family(spark, sf, "vol_trend"))
query("sig5_ensemble_of_horizons", family_sql("ensemble"))(lambda spark, sf: family(spark, sf, "ensemble"))
query("sig6_dual_momentum", family_sql("dual_momentum"))(lambda spark, sf: family(spark, sf, "dual_momentum"))
query("sig7_pullback", family_sql("pullback"))(lambda spark, sf: family(spark, sf, "pullback"))
query("sig8_legacy_momentum", family_sql("legacy_momentum"))(lambda spark, sf: family(spark, sf, "legacy_momentum"))
query("sig10_buy_and_hold", family_sql("hold"))(lambda spark, sf: family(spark, sf, "hold"))


def _lagged(name, priority):
    return (f"{name} AS (SELECT date, v FROM (SELECT date, lag(close) OVER (ORDER BY date) AS v FROM raw WHERE series_id = '{priority}') WHERE v IS NOT NULL)")


@query("sig9_legacy_macro_vote", f"""
WITH {BARS}, {FEATURES}, {RAW}, {_lagged('s0', '1-URGENT')}, {_lagged('s1', '2-HIGH')}, {_lagged('s2', '3-MEDIUM')},
j0 AS (SELECT f2.*, s0.v AS v0 FROM f2 ASOF LEFT JOIN s0 ON f2.date >= s0.date),
j1 AS (SELECT j0.*, s1.v AS v1 FROM j0 ASOF LEFT JOIN s1 ON j0.date >= s1.date),
j2 AS (SELECT j1.*, s2.v AS v2 FROM j1 ASOF LEFT JOIN s2 ON j1.date >= s2.date),
v AS (SELECT *, CAST(coalesce(v0 / lag(v0, 60) OVER ({W}) - 1 < 0, false) AS INTEGER) + CAST(coalesce(v1 - lag(v1, 60) OVER ({W}) < 0, false) AS INTEGER)
  + CAST(coalesce(v2 / lag(v2, 10) OVER ({W}) - 1 <= 0.30, false) AS INTEGER) AS votes FROM j2)
SELECT series_id, date, votes, {grid("tr90w * CASE WHEN votes >= 1 THEN 1 ELSE 0 END * " + CAP)} AS raw FROM v""")
def legacy_macro_vote(spark, sf):
    raw = raw_bars(spark, sf).select("series_id", "date", "close")
    one = lambda p: raw.filter(F.col("series_id") == p).select("date", "close")
    df = kept_bars(spark, sf).select("series_id", "date", F.col("close").alias("price"))
    df = sig.macro_votes(df, one("1-URGENT"), one("2-HIGH"), one("3-MEDIUM"), K, "date", "close")
    spec = dict(spec_id=1, family="legacy_macro", horizon=60)
    out = sig.raw_signal(df, K, "date", "price", [spec], spread=False, carry=["votes"])
    return out.select("series_id", "date", "votes", F.round("raw", 6).alias("raw"))


GATED = f"""
g1 AS (SELECT series_id, date, i, close, {grid(FAMILY_SQL['trend_trail'])} AS raw, coalesce(dd60 < -0.03, false) AS danger, new_week FROM f2),
g2 AS (SELECT *, max(CASE WHEN danger THEN i END) {RUN} AS bad FROM g1),
g3 AS (SELECT series_id, date, i, close, coalesce(last_value(CASE WHEN danger THEN 0.0::DOUBLE WHEN new_week AND (bad IS NULL OR i >= bad + 10) THEN raw END IGNORE NULLS) {RUN}, 0.0::DOUBLE) AS target FROM g2)"""


def gated(spark, sf, **carry):
    spec = dict(spec_id=1, family="trend_trail", horizon=60, stop=0.03)
    raw = sig.raw_signal(bars_of(spark, sf), K, "date", "close", [spec], spread=False, **carry)
    return sig.gated_target(raw, K, "date")


@query("sig11_risk_gate", f"WITH {BARS}, {FEATURES}, {GATED} SELECT series_id, date, target FROM g3")
def risk_gate(spark, sf):
    return gated(spark, sf).select("series_id", "date", F.round("target", 6).alias("target"))


@query("sig12_month_end_signal", f"""
WITH {BARS}, {FEATURES}, e AS (SELECT series_id, date, CASE WHEN date_trunc('month', lead(date) OVER ({W})) <> date_trunc('month', date)
  THEN {grid(FAMILY_SQL['legacy_momentum'])} END AS e FROM f2)
SELECT series_id, date, coalesce(last_value(e IGNORE NULLS) {RUN}, 0.0::DOUBLE) AS target FROM e""")
def month_end_signal(spark, sf):
    spec = dict(spec_id=1, family="legacy_momentum", horizon=60)
    raw = sig.raw_signal(bars_of(spark, sf), K, "date", "close", [spec], spread=False)
    return sig.month_end_target(raw, K, "date", "raw").select("series_id", "date", F.round("target", 6).alias("target"))


# the entry/exit rule. Stops are tightened because the test series move little.
RULES = [dict(spec_id=1, slow=60, fast=20, buffer=0.005, exit_buffer=0.005, breakout=40, entry_mode="either", stop=0.02, cooldown=5),
         dict(spec_id=2, slow=60, fast=20, buffer=0.005, exit_buffer=0.005, breakout=40, entry_mode="breakout", stop=0.03, cooldown=0, reentry_filter="ma20"),
         dict(spec_id=3, slow=60, fast=20, buffer=0.002, exit_buffer=0.010, breakout=20, entry_mode="both", stop=0.015, cooldown=8, reentry_filter="rising_ma20")]


def rule_sql():
    def prior(n):
        return f"CASE WHEN i > {n} THEN max(close) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"

    parts = []
    for r in RULES:
        trend = f"coalesce(ma20 > ma60 * CAST({1 + r['buffer']} AS DOUBLE), false)"
        top = f"coalesce(close > top{r['breakout']} AND close > ma60, false)"
        entry = {"either": f"{trend} OR {top}", "both": f"{trend} AND {top}", "breakout": top}[r["entry_mode"]]
        flt = {"none": "true", "ma20": "close > ma20", "rising_ma20": "close > ma20 AND ma20 > ago"}[r.get("reentry_filter", "none")]
        parts.append(f"SELECT series_id, date, i, close, {r['spec_id']} AS spec_id, coalesce(({entry}) AND ({flt}), false) AS entry, "
                     f"coalesce(ma20 < ma60 * CAST({1 - r['exit_buffer']} AS DOUBLE), false) AS leave, CAST({r['stop']} AS DOUBLE) AS stop, {r['cooldown']} AS cooldown FROM c2")
    return f"""
c1 AS (SELECT series_id, date, i, close, {mean(20)} AS ma20, {mean(60)} AS ma60, {prior(20)} AS top20, {prior(40)} AS top40 FROM bars),
c2 AS (SELECT *, lag(ma20, 5) OVER ({W}) AS ago FROM c1),
cond AS MATERIALIZED ({' UNION ALL '.join(parts)})"""


MACHINE = """
st(series_id, spec_id, i, on_, peak, free_from) AS (
  SELECT series_id, spec_id, i, entry, CASE WHEN entry THEN close ELSE 0.0::DOUBLE END, -1 FROM cond WHERE i = 1
  UNION ALL
  SELECT c.series_id, c.spec_id, c.i,
    CASE WHEN s.on_ THEN NOT (c.leave OR c.close < greatest(s.peak, c.close) * (1 - c.stop)) ELSE c.i >= s.free_from AND c.entry END,
    CASE WHEN s.on_ THEN greatest(s.peak, c.close) WHEN c.i >= s.free_from AND c.entry THEN c.close ELSE s.peak END,
    CASE WHEN s.on_ AND (c.leave OR c.close < greatest(s.peak, c.close) * (1 - c.stop)) THEN c.i + c.cooldown ELSE s.free_from END
  FROM st s JOIN cond c ON c.series_id = s.series_id AND c.spec_id = s.spec_id AND c.i = s.i + 1),
states AS (SELECT c.series_id, c.date, c.spec_id, c.i, c.close, CAST(s.on_ AS INTEGER)::DOUBLE AS state FROM st s JOIN cond c USING (series_id, spec_id, i))"""


@query("sig13_entry_conditions", f"""
WITH {BARS}, {rule_sql()} SELECT series_id, date, spec_id, entry, leave FROM cond""")
def entry_conditions(spark, sf):
    df, machines = sig.breakout_conditions(bars_of(spark, sf), K, "date", "close", RULES)
    no = F.lit(False)
    rows = F.array(*[F.struct(F.lit(m["spec_id"]).alias("spec_id"), F.coalesce(m["entry"], no).alias("entry"), F.coalesce(m["leave"], no).alias("leave")) for m in machines])
    return df.select("series_id", "date", F.inline(rows))


@query("sig14_entry_exit_machine", f"""
WITH RECURSIVE {BARS}, {rule_sql()}, {MACHINE}
SELECT series_id, date, spec_id, state, lag(state, 1, 0.0::DOUBLE) OVER (PARTITION BY series_id, spec_id ORDER BY date) AS target FROM states""")
def entry_exit_machine(spark, sf):
    return sig.ma_breakout(bars_of(spark, sf), K, "date", "close", RULES)


@query("sig14_machine_by_jumps", f"""
WITH RECURSIVE {BARS}, {rule_sql()}, {MACHINE} SELECT series_id, date, spec_id, state FROM states""")
def machine_by_jumps(spark, sf):
    df, machines = sig.breakout_conditions(bars_of(spark, sf), K, "date", "close", RULES)
    return states_by_jumps(df, K, "date", "close", machines)


@query("sig14_episodes", f"""
WITH RECURSIVE {BARS}, {rule_sql()}, {MACHINE},
e AS (SELECT *, sum(CASE WHEN state > 0 AND prev <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, spec_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS episode
  FROM (SELECT *, lag(state, 1, 0.0::DOUBLE) OVER (PARTITION BY series_id, spec_id ORDER BY date) AS prev FROM states))
SELECT series_id, spec_id, CAST(episode AS BIGINT) AS episode, min(date) AS entry_date, min(CASE WHEN state <= 0 THEN date END) AS exit_date FROM e WHERE episode > 0 GROUP BY 1, 2, 3""")
def machine_episodes(spark, sf):
    return sig.episodes(sig.ma_breakout(bars_of(spark, sf), K, "date", "close", RULES), ["series_id", "spec_id"], "date")


@query("sig15_next_bar_thresholds", f"""
WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM bars),
s AS (SELECT series_id, max(date) AS date, arg_max(close, date) AS close, sum(close) FILTER (back <= 19) AS f, sum(close) FILTER (back <= 119) AS s, max(close) FILTER (back <= 90) AS top FROM t GROUP BY 1)
SELECT series_id, date, close, round((1.02 * 20 * s - 120 * f) / (120 - 1.02 * 20), 5) AS next_ma, round(greatest(top, s / 119), 5) AS next_breakout FROM s""")
def next_bar_thresholds(spark, sf):
    out = sig.next_bar_thresholds(bars_of(spark, sf), K, "date", "close")
    return out.select("series_id", "date", "close", F.round("next_ma", 5).alias("next_ma"), F.round("next_breakout", 5).alias("next_breakout"))


@query("sig16_scenario_sweep")
def scenario_sweep(spark, sf):
    return sig.scenario_sweep(bars_of(spark, sf), K, "date", "close")


@query("sig17_target_after_last_bar", f"""
WITH RECURSIVE {BARS}, {rule_sql()}, {MACHINE}
SELECT series_id, spec_id, max(date) AS date, arg_max(state, date) AS next_target FROM states GROUP BY 1, 2""")
def target_after_last_bar(spark, sf):
    states = sig.ma_breakout(bars_of(spark, sf), K, "date", "close", RULES)
    return states.groupBy("series_id", "spec_id").agg(F.max("date").alias("date"), F.max_by("state", "date").alias("next_target"))


@query("sig18_combined_modules", f"""
WITH {BARS}, {FEATURES}
SELECT series_id, date, greatest(tr60, ch) AS any_on, least(tr60, ch) AS all_on, round(0.3 * tr60 + 0.7 * ch, 6) AS blend FROM f2""")
def combined_modules(spark, sf):
    df = sig.hysteresis(bars_of(spark, sf), K, "date", "close", 60, out="a")
    df = sig.channel(df, K, "date", "close", 60, 20, out="b")
    ab = ["a", "b"]
    return df.select("series_id", "date", sig.combine(ab, "union").alias("any_on"), sig.combine(ab, "filter").alias("all_on"),
                     F.round(sig.combine(ab, "blend", 0.3), 6).alias("blend"))


@query("sig19_three_module_union", f"""
WITH RECURSIVE {BARS},
b1 AS (SELECT *, {mean(20)} AS ma20, {mean(120)} AS ma120, CASE WHEN i > 90 THEN max(close) OVER ({W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) END AS top,
   regr_slope(ln(close), CAST(i AS DOUBLE)) OVER fit AS slope, regr_r2(ln(close), CAST(i AS DOUBLE)) OVER fit AS r2,
   coalesce(date_trunc('week', date + 2) <> lag(date_trunc('week', date + 2)) OVER ({W}), true) AS new_week
   FROM bars WINDOW fit AS ({W} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
px AS (SELECT a.series_id, a.date, b.i - a.i + 89 AS x, ln(b.close) AS y FROM bars a JOIN bars b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 89 AND a.i WHERE a.i >= 90),
mo AS (SELECT series_id, date, sum(y) AS sy, sum((x - 44.5) * y) AS s1, sum((x - 44.5) * (x - 44.5) * y) AS s2y, sum((x-44.5)*(x-44.5)) AS u2,
   sum(pow(x-44.5, 4)) AS u4, var_pop(y) * 90 AS tss FROM px GROUP BY 1, 2),
co AS (SELECT *, s1 / u2 AS b, (90 * s2y - u2 * sy) / (90 * u4 - u2 * u2) AS a FROM mo),
qf AS (SELECT series_id, date, (b + 2 * a * 44.5) * 252 AS qs, (b * s1 + a * (s2y - u2 / 90 * sy)) / tss AS qr FROM co),
fl AS (SELECT b1.series_id, b1.date, b1.i, b1.close, b1.new_week,
   coalesce(ma20 > ma120 * 1.02::DOUBLE, false) OR coalesce(b1.close > top AND b1.close > ma120, false) AS e0, coalesce(ma20 < ma120 * 0.98::DOUBLE, false) AS l0,
   coalesce(b1.i >= 120 AND r2 >= 0.1 AND slope * 252 >= 0.05, false) AS ln_, coalesce(qr >= 0.5 AND qs >= 0.05, false) AS qd FROM b1 LEFT JOIN qf USING (series_id, date)),
cond AS MATERIALIZED (SELECT series_id, date, i, close, 0 AS spec_id, e0 AS entry, l0 AS leave, 0.08::DOUBLE AS stop, 5 AS cooldown FROM fl
  UNION ALL SELECT series_id, date, i, close, 1, ln_, NOT ln_, 0.08::DOUBLE, 0 FROM fl
  UNION ALL SELECT series_id, date, i, close, 2, qd AND new_week, NOT qd AND new_week, 0.08::DOUBLE, 0 FROM fl), {MACHINE}
SELECT series_id, date, max(state) FILTER (spec_id = 0) AS rule, max(state) FILTER (spec_id = 1) AS line, max(state) FILTER (spec_id = 2) AS curve, max(state) AS "union" FROM states GROUP BY 1, 2""")
def three_module_union(spark, sf):
    return sig.baseline_union(bars_of(spark, sf), K, "date", "close")


@query("sig20_profit_lock", f"""
WITH {BARS}, {FEATURES}, p AS (SELECT *, coalesce(lag(close / ma90) OVER ({W}) > 1.02, false) AS locked FROM f2),
g1 AS (SELECT series_id, date, i, {grid(FAMILY_SQL['trend_trail'])} AS raw, locked OR coalesce(dd60 < -0.03, false) AS danger, new_week FROM p),
g2 AS (SELECT *, max(CASE WHEN danger THEN i END) {RUN} AS bad FROM g1)
SELECT series_id, date, coalesce(last_value(CASE WHEN danger THEN 0.0::DOUBLE WHEN new_week AND (bad IS NULL OR i >= bad + 10) THEN raw END IGNORE NULLS) {RUN}, 0.0::DOUBLE) AS target FROM g2""")
def profit_lock(spark, sf):
    df = ind.moving_means(bars_of(spark, sf), K, "date", "close", [90]).withColumn("locked", sig.profit_lock("close", "ma_90", K, "date", 1.02)).drop("ma_90")
    spec = dict(spec_id=1, family="trend_trail", horizon=60, stop=0.03)
    raw = sig.raw_signal(df, K, "date", "close", [spec], carry=["locked"], spread=False)
    raw = raw.withColumn("danger", F.col("danger") | F.col("locked"))
    return sig.gated_target(raw, K, "date").select("series_id", "date", F.round("target", 6).alias("target"))


@query("sig21_joint_confirmation", f"""
WITH {BARS}, p AS (SELECT date, max(CASE WHEN series_id = 'AF' THEN close END) AS a, max(CASE WHEN series_id = 'NF' THEN close END) AS b, max(CASE WHEN series_id = 'RF' THEN close END) AS c FROM bars GROUP BY 1),
t AS (SELECT *, a <= 100 AS c1, b < avg(b) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c2, c > 100 AS c3 FROM p)
SELECT date, CASE WHEN c1 AND c2 AND c3 THEN 'met' WHEN NOT (c1 AND c2 AND c3) THEN 'not_met' ELSE 'unknown' END AS status FROM t""")
def joint_confirmation(spark, sf):
    pick = lambda s: F.max(F.when(F.col("series_id") == s, F.col("close")))
    wide = bars_of(spark, sf).groupBy("date").agg(pick("AF").alias("a"), pick("NF").alias("b"), pick("RF").alias("c")).withColumn("one", F.lit(1))
    mean20 = F.avg("b").over(ordered(["one"], "date").rowsBetween(-19, 0))
    conds = [F.col("a") <= 100, F.col("b") < mean20, F.col("c") > 100]
    wide = wide.withColumns({f"c{i}": c for i, c in enumerate(conds)})
    return wide.select("date", sig.confirm_all([F.col("c0"), F.col("c1"), F.col("c2")]).alias("status"))


@query("sig22_condition_panel", f"""
WITH {BARS}, {FEATURES}, c AS (SELECT series_id, date, m60 < 0 AS a, m252 < 0 AS b, vol40 > 0.2 AS c, dd60 < -0.02 AS d, close < ma120 AS e FROM f2),
n AS (SELECT *, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END + CASE WHEN c THEN 1 ELSE 0 END + CASE WHEN d THEN 1 ELSE 0 END + CASE WHEN e THEN 1 ELSE 0 END AS triggered,
 CAST(a IS NULL AS INTEGER) + CAST(b IS NULL AS INTEGER) + CAST(c IS NULL AS INTEGER) + CAST(d IS NULL AS INTEGER) + CAST(e IS NULL AS INTEGER) AS unknown FROM c)
SELECT series_id, date, triggered, unknown, CASE WHEN triggered = 5 THEN 'triggered' WHEN triggered > 0 THEN 'partial' WHEN unknown > 0 THEN 'unknown' ELSE 'clear' END AS verdict FROM n""")
def condition_panel(spark, sf):
    w = ordered(K, "date")
    df = bars_of(spark, sf)
    df = ind.moving_means(df, K, "date", "close", [120])
    df = ind.rolling_drawdown(df, K, "date", "close", 60, "dd")
    lag = lambda n: F.col("close") / F.lag("close", n).over(w) - 1
    df = df.withColumns({"r": lag(1), "m60": lag(60), "m252": lag(252)}).withColumn("vol", ind.annual_volatility("r", 40, K, "date"))
    conds = {"a": F.col("m60") < 0, "b": F.col("m252") < 0, "c": F.col("vol") > 0.2, "d": F.col("dd") < -0.02, "e": F.col("close") < F.col("ma_120")}
    return df.select("series_id", "date", *sig.condition_panel(conds))
