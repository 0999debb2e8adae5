"""SWP: sweeps over the daily bars."""

from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.operators import indicators as ind
from tidemark.operators import signals as sig
from tidemark.operators import sweep as swp
from tidemark.plans.metric_queries import curve_sql, perf_sql, rounded, rounded_sql
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import RULES, RUN, W, hyst, mean
from tidemark.plans.views import BARS, PHASES, PHASES_SQL, index_bars, kept_bars
from tidemark.session import materialise

K = ["series_id"]
TRAIN = ["early", "middle"]
LIMITS = (-15.0, 70.0)
# the test indices move about 1% a day or less, so gates are tighter than the registered ones
SMALL_GRID = dict(family=swp.GRID["family"], horizon=[60, 120], cap=[0.65, 0.85], stop=[0.03], frequency=["weekly", "monthly"])


def bars_of(spark, sf, keep=False):
    return (kept_bars if keep else index_bars)(spark, sf).select("series_id", "date", "open", "high", "low", "close")


def lit(v):
    return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)


def specs_sql(specs):
    specs = [{**sig.SPEC_DEFAULTS, **s} for s in specs]
    cols = ["spec_id", "family", "horizon", "cap", "vol_target", "stop", "frequency", "cooldown"]
    return f"specs({', '.join(cols)}) AS (VALUES {', '.join('(' + ', '.join(lit(s[c]) for c in cols) + ')' for s in specs)})"


def sweep_sql(specs, extra=""):
    """CTEs up to `tg`: the target of each parameter set on each series and day."""
    hs = sorted({s["horizon"] for s in specs})
    ns = sorted({n for h in hs for n in (max(20, h // 2), h, 2 * h)})
    flags = ", ".join(f"{hyst(n)} AS tr{n}" for n in ns)
    longs = " UNION ALL ".join(f"""SELECT series_id, date, i, open, close, new_week, new_month, vol40, {h} AS h, tr{h} AS tr, (tr{max(20, h // 2)} + tr{h} + tr{2 * h}) / 3 AS vote,
  (CAST(coalesce(close / lag(close, {h}) OVER ({W}) - 1 > 0, false) AS INTEGER) + CAST(coalesce(close / lag(close, {2 * h}) OVER ({W}) - 1 > 0, false) AS INTEGER)) / 2.0::DOUBLE AS mom,
  coalesce(last_value(CASE WHEN close >= hi{h} THEN 1.0::DOUBLE WHEN close <= lo20 THEN 0.0::DOUBLE END IGNORE NULLS) {RUN}, 0.0::DOUBLE) AS ch, close / top{h} - 1 AS dd, coalesce(close < ma{h} * 1.03::DOUBLE, false) AS near FROM s2""" for h in hs)
    prior = lambda fn, n: f"CASE WHEN i > {n} THEN {fn}(close) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    return f"""{BARS}, {specs_sql(specs)},
s1 AS (SELECT series_id, date, i, open, close, close / lag(close) OVER ({W}) - 1 AS ret, {', '.join(f'{mean(n)} AS ma{n}' for n in ns)}, {prior('min', 20)} AS lo20,
  {', '.join(f"{prior('max', h)} AS hi{h}, CASE WHEN i >= {h} THEN max(close) OVER ({W} ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) END AS top{h}" for h in hs)},
  coalesce(date_trunc('week', date + 2) <> lag(date_trunc('week', date + 2)) OVER ({W}), true) AS new_week, coalesce(date_trunc('month', date) <> lag(date_trunc('month', date)) OVER ({W}), true) AS new_month FROM bars),
s2 AS (SELECT *, CASE WHEN i > 40 THEN stddev_samp(ret) OVER ({W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) END * sqrt(252.0) AS vol40, {flags} FROM s1),
s3 AS ({longs}),
s4 AS (SELECT s3.*, specs.*, CASE family WHEN 'channel' THEN ch * cap WHEN 'trend_trail' THEN tr * cap WHEN 'vol_trend' THEN tr * cap * ({scale_expr()}) WHEN 'ensemble' THEN vote * cap
  WHEN 'dual_momentum' THEN mom * cap * ({scale_expr()}) WHEN 'pullback' THEN tr * CASE WHEN near THEN cap ELSE cap * 0.5::DOUBLE END END AS rawx FROM s3 JOIN specs ON specs.horizon = s3.h),
s5 AS (SELECT *, round_even(coalesce(rawx, 0.0) / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS raw, coalesce(dd < -stop, false) AS danger, CASE frequency WHEN 'monthly' THEN new_month ELSE new_week END AS review FROM s4),
s6 AS (SELECT *, max(CASE WHEN danger THEN i END) OVER (PARTITION BY series_id, spec_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS bad FROM s5),
tg AS (SELECT series_id, spec_id, family, date, i, open, close, coalesce(last_value(CASE WHEN danger THEN 0.0::DOUBLE WHEN review AND (bad IS NULL OR i >= bad + cooldown) THEN raw END IGNORE NULLS)
  OVER (PARTITION BY series_id, spec_id ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS target FROM s6)"""


def scale_expr():
    return "CASE WHEN vol40 IS NULL THEN NULL ELSE least(greatest(vol_target / vol40, 0.2::DOUBLE), 1.0::DOUBLE) END"


WEIGHTED = "wt AS (SELECT *, lag(target, 1, 0.0::DOUBLE) OVER (PARTITION BY series_id, spec_id ORDER BY date) AS weight FROM tg)"
CURVE = curve_sql("wt", "curve", "series_id, spec_id")
PHASED = f"{PHASES_SQL}, ph AS (SELECT c.*, phase, p_start FROM curve c JOIN phases ON date BETWEEN p_start AND p_end), {perf_sql('ph', 'perf', 'series_id, spec_id, phase')}"


@query("swp1_grid_coverage", f"""WITH {BARS}, {specs_sql(swp.grid())} SELECT spec_id, family, horizon, count(*) FILTER (i >= horizon) AS usable FROM bars CROSS JOIN specs GROUP BY 1, 2, 3""")
def grid_coverage(spark, sf):
    specs = swp.grid()
    counts = index_bars(spark, sf).select("series_id", "date").withColumn("i", ind.row_index(K, "date"))
    # the copies are made of daily row numbers; usable rows are counted per set
    n = counts.groupBy("i").agg(F.count(F.lit(1)).alias("series"))
    rows = align.with_specs(n, [{c: s[c] for c in ("spec_id", "family", "horizon")} for s in specs])
    return rows.groupBy("spec_id", "family", "horizon").agg(F.sum(F.when(F.col("i") >= F.col("horizon"), F.col("series")).otherwise(0)).alias("usable"))


@query("swp2_full_grid_sweep", f"WITH {sweep_sql(swp.grid())}, {WEIGHTED}, {CURVE}, {PHASED} {rounded_sql('series_id, spec_id, phase')} WHERE phase IN ('early', 'middle', 'late')")
def full_grid_sweep(spark, sf):
    return rounded(swp.sweep(bars_of(spark, sf), K, "date", swp.grid(), PHASES[:3]), "series_id", "spec_id", "phase")


SMALL = swp.grid(SMALL_GRID)
FROZEN = f"""sp AS (SELECT spec_id, series_id, sum(ln(return_pct / 100 + 1)) AS g, bool_and(max_drawdown_pct > {LIMITS[0]} AND average_weight_pct <= {LIMITS[1]}) AS ok FROM perf WHERE phase IN ('early', 'middle') GROUP BY 1, 2),
sc AS (SELECT spec_id, round(exp(min(g) / 4.0) - 1, 9) AS score FROM sp GROUP BY 1 HAVING bool_and(ok)),
fz AS (SELECT family, spec_id, score FROM (SELECT family, sc.*, row_number() OVER (PARTITION BY family ORDER BY score DESC, spec_id) AS rn FROM sc JOIN specs USING (spec_id)) WHERE rn = 1)"""


@query("swp3_select_freeze_validate", f"""WITH {sweep_sql(SMALL)}, {WEIGHTED}, {CURVE}, {PHASED}, {FROZEN},
el AS (SELECT spec_id, bool_and(max_drawdown_pct > {LIMITS[0]} AND average_weight_pct <= {LIMITS[1]}) AS eligible FROM perf WHERE phase IN ('early', 'middle', 'late') GROUP BY 1),
rk AS (SELECT fz.*, eligible, row_number() OVER (ORDER BY score DESC, spec_id) AS frozen_rank FROM fz JOIN el USING (spec_id))
SELECT family, spec_id, round(score, 6) AS score, eligible, CAST(frozen_rank AS INTEGER) AS frozen_rank, eligible AND sum(CAST(eligible AS INTEGER)) OVER (ORDER BY frozen_rank) <= 3 AS chosen FROM rk""")
def select_freeze_validate(spark, sf):
    """Selection sees only bars up to the split; validation replays the winners alone."""
    bars = bars_of(spark, sf, keep=True)
    train = swp.sweep(bars.filter(F.col("date") <= "1998-12-31"), K, "date", SMALL, PHASES[:2])
    frozen = materialise(swp.select_frozen(train, SMALL, "series_id", TRAIN, 4.0, LIMITS))
    later = swp.sweep(bars, K, "date", SMALL, PHASES[:3], keep=frozen)
    out = swp.validate_frozen(frozen, later, ["early", "middle", "late"], LIMITS)
    return out.select("family", "spec_id", F.round("score", 6).alias("score"), "eligible", "frozen_rank", "chosen")


BEST = [dict(spec_id=0, family="ensemble", horizon=60, cap=0.85, stop=0.03, frequency="weekly")]
STRESS_SQL = ", ".join(f"('{n}', {c}::DOUBLE, {d})" for n, c, d in swp.STRESS)


@query("swp4_cost_delay_stress", f"""WITH {sweep_sql(BEST)}, wt AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS scenario, {c}::DOUBLE AS cost, lag(target, {d + 1}, 0.0::DOUBLE) OVER (PARTITION BY series_id ORDER BY date) AS weight FROM tg" for n, c, d in swp.STRESS)}),
{curve_sql('wt', 'curve', 'series_id, scenario', cost='cost * 1.0')}, {PHASES_SQL}, ph AS (SELECT c.*, phase, p_start FROM curve c JOIN phases ON date BETWEEN p_start AND p_end), {perf_sql('ph', 'perf', 'series_id, scenario, phase')}
{rounded_sql('series_id, scenario, phase')}""")
def cost_delay_stress(spark, sf):
    return rounded(swp.sweep(bars_of(spark, sf), K, "date", BEST, PHASES, stress=swp.STRESS), "series_id", "scenario", "phase")


NEAR = swp.neighbours(BEST[0], {"horizon": [54, 66], "cap": [0.80, 0.90], "stop": [0.027, 0.033]})


@query("swp5_neighbour_sensitivity", f"""WITH {sweep_sql(NEAR)}, {WEIGHTED}, {CURVE}, {PHASED}, nm(spec_id, changed) AS (VALUES {', '.join(f"({s['spec_id']}, '{s['changed']}')" for s in NEAR)})
SELECT changed, series_id, phase, round(return_pct, 4) AS return_pct, round(max_drawdown_pct, 4) AS max_drawdown_pct FROM perf JOIN nm USING (spec_id) WHERE phase = 'full'""")
def neighbour_sensitivity(spark, sf):
    perf = swp.sweep(bars_of(spark, sf), K, "date", NEAR, [PHASES[-1]])
    return perf.select(swp.spec_column(NEAR, "changed").alias("changed"), "series_id", "phase", F.round("return_pct", 4).alias("return_pct"), F.round("max_drawdown_pct", 4).alias("max_drawdown_pct"))


def _states(df, keys):
    return sig.ma_breakout(df, keys, "date", "close", RULES).select(*keys, "date", "spec_id", "state", "target")


@query("swp6_future_change_leaves_past", f"""WITH {BARS} SELECT count(*) * {len(RULES)} AS compared, CAST(0 AS BIGINT) AS changed_before_cut FROM bars WHERE date < DATE '1998-06-15'""")
def future_change_leaves_past(spark, sf):
    bars = bars_of(spark, sf, keep=True).select("series_id", "date", "close")
    diff = swp.causality_diff(lambda d: _states(d, K), bars, "date", "1998-06-15", "close")
    n = bars.filter(F.col("date") < F.lit("1998-06-15").cast("date")).agg((F.count(F.lit(1)) * len(RULES)).alias("compared"))
    return n.select("compared", F.lit(diff.agg(F.count(F.lit(1))).scalar()).alias("changed_before_cut"))


CUTS = ["1996-05-01", "1997-11-03", "2000-02-29"]


@query("swp7_prefix_replay", f"""WITH {BARS}, c(cut) AS (VALUES {', '.join(f"(DATE '{c}')" for c in CUTS)}) SELECT cut, count(*) * {len(RULES)} AS compared, CAST(0 AS BIGINT) AS differing FROM bars JOIN c ON date < cut GROUP BY 1""")
def prefix_replay(spark, sf):
    bars = bars_of(spark, sf, keep=True).select("series_id", "date", "close")
    diff = swp.prefix_replay(_states, bars, K, "date", CUTS).groupBy("cut").agg(F.count(F.lit(1)).alias("d"))
    points = F.array(*[F.lit(c).cast("date") for c in CUTS])
    n = bars.select(F.explode(F.filter(points, lambda c: F.col("date") < c)).alias("cut")).groupBy("cut").agg((F.count(F.lit(1)) * len(RULES)).alias("compared"))
    return n.join(diff, "cut", "left").select("cut", "compared", F.coalesce("d", F.lit(0)).alias("differing"))


@query("swp8_walk_forward_selection", f"""WITH {sweep_sql(SMALL)}, {WEIGHTED}, {CURVE}, {PHASED}, fo(fold, a, b) AS (VALUES ('early>middle', 'early', 'middle'), ('middle>late', 'middle', 'late')),
p AS (SELECT series_id, fold, spec_id, max(CASE WHEN phase = a THEN round(return_pct, 6) END) AS t, max(CASE WHEN phase = b THEN round(return_pct, 6) END) AS n FROM perf, fo WHERE phase IN (a, b) GROUP BY ALL)
SELECT series_id, fold, spec_id, round(t, 4) AS train_return, round(n, 4) AS next_return FROM (SELECT *, row_number() OVER (PARTITION BY series_id, fold ORDER BY t DESC, spec_id) AS rn FROM p WHERE t IS NOT NULL AND n IS NOT NULL) WHERE rn = 1""")
def walk_forward_selection(spark, sf):
    perf = swp.sweep(bars_of(spark, sf), K, "date", SMALL, PHASES[:3])
    out = swp.walk_forward(perf, K, [("early", "middle"), ("middle", "late")])
    return out.select("series_id", "fold", "spec_id", F.round("train_return", 4).alias("train_return"), F.round("next_return", 4).alias("next_return"))


@query("swp9_ridge_walk_forward")
def ridge_walk_forward(spark, sf):
    out = swp.ridge_walk_forward(bars_of(spark, sf), K, "date")
    return out.select("series_id", "date", "train_rows", F.round("forecast", 6).alias("forecast"), "signal")
