"""Equity curves, window metrics, holding episodes and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ordered
from tidemark.operators.align import to_phases

INITIAL = 100.0
HELD = 1e-10


def equity_curve(df: DataFrame, keys, t: str, weight: str = "weight", cost=0.003, initial: float = INITIAL) -> DataFrame:
    """Equity of holding `weight` from each open on, in cash otherwise.

    The weight must already be delayed: it is what was decided before this session. Each
    session multiplies the overnight move of the old weight, the cost of the change at the
    open and the intraday move of the new weight. Nothing is sold at the end. `prior` is the
    equity of the session before.
    """
    cost = F.lit(cost) if isinstance(cost, (int, float)) else F.col(cost)
    w = ordered(keys, t)
    old = F.lag(weight, 1, 0.0).over(w)
    before = F.lag("close").over(w)
    df = df.withColumns({"__old": old, "__before": before})
    overnight = F.coalesce(1 + F.col("__old") * (F.col("open") / F.col("__before") - 1), F.lit(1.0))
    change = F.abs(F.col(weight) - F.col("__old"))
    df = df.withColumns({"__on": overnight, "__cost": cost * change, "traded": change > 1e-12})
    factor = F.col("__on") * (1 - F.col("__cost")) * (1 + F.col(weight) * (F.col("close") / F.col("open") - 1))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # nothing is left after a factor of 0 or less, and nothing comes back
    ruined = F.min(factor).over(run) <= 0
    df = df.withColumn("equity", F.when(ruined, 0.0).otherwise(F.exp(F.sum(F.ln(factor)).over(run)) * F.lit(initial)))
    df = df.withColumn("prior", F.lag("equity", 1, initial).over(w))
    df = df.withColumn("fee", F.col("prior") * F.col("__on") * F.col("__cost"))
    return df.drop("__old", "__before", "__on", "__cost")


def to_windows(df: DataFrame, t: str, phases=(), years: bool = False, run_start=None) -> DataFrame:
    """Copy rows to the named phases and, if asked, to calendar years clipped to the run."""
    parts = []
    if phases:
        parts.append(to_phases(df, phases, t).drop("phase_end"))
    if years:
        start = F.trunc(F.col(t), "YEAR")
        if run_start is not None:
            start = F.greatest(start, F.lit(run_start).cast("date"))
        parts.append(df.withColumns({"phase": F.year(t).cast("string"), "phase_start": start}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_prior(equity: DataFrame, keys, t: str, initial: float = INITIAL) -> DataFrame:
    if "prior" in equity.columns:
        return equity
    return equity.withColumn("prior", F.lag("equity", 1, initial).over(ordered(keys, t)))


def performance(equity: DataFrame, keys, t: str, phases=(), years: bool = False, run_start=None, initial: float = INITIAL) -> DataFrame:
    """Return, CAGR, drawdown, exposure, cost and trade days per (keys, phase).

    The base of a window is the last equity before it, else `initial`. As rows are
    consecutive that is the previous equity of the window's first row, so one lag over the
    whole history serves all windows. A window without rows gives no row.
    """
    df = with_prior(equity, keys, t, initial).select(*keys, t, "equity", "weight", "fee", "traded", "prior")
    return window_metrics(to_windows(df, t, phases, years, run_start), [*keys, "phase"], t)


def window_metrics(df: DataFrame, keys, t: str) -> DataFrame:
    """Metrics of rows already copied to windows, with columns prior and phase_start."""
    run = ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.greatest("prior", "equity")).over(run)
    df = df.withColumn("dd", F.col("equity") / top - 1)
    out = df.groupBy(*keys).agg(
        F.min("phase_start").alias("a"), F.max(t).alias("last_date"),
        F.min_by("prior", t).alias("base"), F.max_by("equity", t).alias("final"),
        F.min("dd").alias("dd"), F.avg("weight").alias("aw"), F.max("weight").alias("mw"),
        F.sum("fee").alias("fees"), F.count_if("traded").alias("trade_days"),
    )
    growth = F.col("final") / F.col("base")
    years = F.greatest(F.datediff("last_date", "a") / 365.25, F.lit(1 / 365.25))
    return out.select(
        *keys, ((growth - 1) * 100).alias("return_pct"), ((F.pow(growth, 1 / years) - 1) * 100).alias("cagr_pct"),
        (F.least("dd", F.lit(0.0)) * 100).alias("max_drawdown_pct"), (F.col("aw") * 100).alias("average_weight_pct"),
        (F.col("mw") * 100).alias("max_weight_pct"), "final", "fees", "trade_days",
    )


def reset_performance(df: DataFrame, keys, t: str, phases, cost=0.003, initial: float = INITIAL) -> DataFrame:
    """Metrics of windows that each start in cash, with signals warmed by earlier history."""
    copies = to_phases(df, phases, t)
    curve = equity_curve(copies, [*keys, "phase"], t, cost=cost, initial=initial)
    return window_metrics(curve, [*keys, "phase"], t)


def rolling_year_audit(equity: DataFrame, keys, t: str, worst_drawdown=-15.0, most_weight=70.0, months: int = 12, initial: float = INITIAL) -> DataFrame:
    """Breaches over all windows of `months` full months, one ending with each month.

    Each month is summed up once (its top, bottom and worst drawdown, weights); a window folds the summaries of its months in
    order, where a later bottom also falls from the earlier months' top. Months without rows count, windows without rows don't.
    """
    df = with_prior(equity, keys, t, initial).withColumn("__m", F.trunc(t, "MM"))
    top = F.max(F.greatest("prior", "equity")).over(ordered([*keys, "__m"], t).rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("__top", top).groupBy(*keys, "__m").agg(
        F.max("__top").alias("top"), F.min("equity").alias("low"), F.min(F.col("equity") / F.col("__top") - 1).alias("dd"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).cast("double").alias("w"), F.count("weight").alias("n"))
    # one row per calendar month, the summary on the first of each gap
    until = F.add_months(F.coalesce(F.lead("__m").over(ordered(keys, "__m")), F.add_months("__m", 1)), -1)
    parts = parts.withColumn("__to", until).select(
        *keys, F.struct("top", "low", "dd", "w", "n").alias("__s"), F.posexplode(F.sequence("__m", "__to", F.expr("INTERVAL 1 MONTH"))).alias("__k", "__month"))
    frame = ordered(keys, "__month").rowsBetween(1 - months, 0)
    windows = parts.select(*keys, F.collect_list(F.when(F.col("__k") == 0, F.col("__s"))).over(frame).alias("__in"), F.count(F.lit(1)).over(frame).alias("__months"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("dd"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate("__in", start, lambda s, x: F.struct(
        F.greatest(s["top"], x["top"]).alias("top"), F.least(s["dd"], x["dd"], x["low"] / s["top"] - 1).alias("dd"),
        (s["w"] + x["w"]).alias("w"), (s["n"] + x["n"]).alias("n")))
    m = windows.where((F.col("__months") == months) & (F.size("__in") > 0)).select(*keys, fold.alias("__s"))
    return m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("__s.dd") * 100 < worst_drawdown).alias("risk_breaches"),
        F.count_if(F.try_divide("__s.w", "__s.n") * 100 > most_weight).alias("exposure_breaches"),
    )


def excess(perf: DataFrame, on: Sequence[str], is_benchmark: Column) -> DataFrame:
    """Return and CAGR less those of the benchmark row with the same `on`, in points.

    The benchmark is picked inside the group (one row per rule), so the sweep behind `perf`
    is evaluated once and not joined with itself.
    """
    group = Window.partitionBy(*on)
    mine = lambda c: F.col(c) - F.max(F.when(is_benchmark, F.col(c))).over(group)
    out = perf.withColumns({"excess_return_pp": mine("return_pct"), "excess_cagr_pp": mine("cagr_pct")})
    return out.filter(~is_benchmark & F.col("excess_return_pp").isNotNull())


def within_limits(worst_drawdown: float = -15.0, most_weight: float = 70.0) -> Column:
    return (F.col("max_drawdown_pct") > worst_drawdown) & (F.col("average_weight_pct") <= most_weight)


def feasible(perf: DataFrame, spec_keys: Sequence[str], phases: Sequence[str], worst_drawdown=-15.0, most_weight=70.0) -> DataFrame:
    """Whether every product in each of the given phases keeps both limits."""
    ok = within_limits(worst_drawdown, most_weight)
    return perf.filter(F.col("phase").isin(*phases)).groupBy(*spec_keys).agg(F.every(ok).alias("feasible"))


def worst_product_score(perf: DataFrame, spec_keys, product: str, phases: Sequence[str], years: float = 4.0, limits=(-15.0, 70.0)) -> DataFrame:
    """CAGR over consecutive phases of the weakest product; -999 if a limit is broken."""
    ok = within_limits(*limits)
    per = perf.filter(F.col("phase").isin(*phases)).groupBy(*spec_keys, product).agg(
        F.sum(F.ln(F.col("return_pct") / 100 + 1)).alias("g"), F.every(ok).alias("ok"))
    out = per.groupBy(*spec_keys).agg((F.exp(F.min("g") / years) - 1).alias("s"), F.every("ok").alias("feasible"))
    return out.select(*spec_keys, "feasible", F.when(F.col("feasible"), F.col("s")).otherwise(-999.0).alias("score"))


def holding_episodes(df: DataFrame, keys, t: str) -> DataFrame:
    """Flat-to-flat holdings from daily (equity, weight, fee, traded).

    An episode starts from the equity of the row before it and includes the row on which the
    weight is back at zero. An unfinished one has no sell_date and is valued at the last row.
    """
    w = ordered(keys, t)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        "__held": F.col("weight") > HELD,
        "__was": F.coalesce(F.lag("weight").over(w) > HELD, F.lit(False)),
        "__before": F.lag("equity").over(w),
    })
    df = df.withColumn("episode", F.sum((F.col("__held") & ~F.col("__was")).cast("int")).over(run))
    part = df.filter(F.col("__held") | F.col("__was"))
    out = part.groupBy(*keys, "episode").agg(
        F.min(t).alias("buy_date"), F.max(F.when(~F.col("__held"), F.col(t))).alias("sell_date"),
        F.min_by(F.coalesce("__before", "equity"), t).alias("starting_equity"), F.max_by("equity", t).alias("ending_equity"),
        F.sum("fee").alias("cost"), F.count_if("traded").alias("trade_days"), F.max(t).alias("__last"),
    )
    pnl = F.col("ending_equity") - F.col("starting_equity")
    return out.withColumns({
        "net_pnl": pnl, "return_pct": pnl / F.col("starting_equity") * 100,
        "calendar_days": F.datediff("__last", "buy_date"),
    }).drop("__last")


def coverage_report(df: DataFrame, keys, t: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("valid"),
        F.min(F.when(F.col(value).isNotNull(), F.col(t))).alias("first"), F.max(F.when(F.col(value).isNotNull(), F.col(t))).alias("last"))


def sleeves(curves: DataFrame, on: Sequence[str], is_a: Column, is_b: Column, share: float = 0.5) -> DataFrame:
    """Two sleeves side by side, never rebalanced; weight is equity weighted."""
    pick = lambda hit, c: F.max(F.when(hit, F.col(c)))
    both = curves.filter(is_a | is_b).groupBy(*on).agg(
        pick(is_a, "equity").alias("__ea"), pick(is_a, "weight").alias("__wa"), pick(is_b, "equity").alias("__eb"), pick(is_b, "weight").alias("__wb")).dropna()
    ea, eb = F.col("__ea") * share, F.col("__eb") * (1 - share)
    return both.select(*on, (ea + eb).alias("equity"), ((ea * F.col("__wa") + eb * F.col("__wb")) / (ea + eb)).alias("weight"))


def score_bands(bars: DataFrame, keys, t: str, bands: Sequence[dict]) -> DataFrame:
    """How the price kept to published bands (id, start, end, lower, upper)."""
    rows = F.array(*[F.struct(F.lit(b["id"]).alias("band"), F.lit(b["start"]).cast("date").alias("a"), F.lit(b["end"]).cast("date").alias("z"),
                              F.lit(float(b["lower"])).alias("lower"), F.lit(float(b["upper"])).alias("upper")) for b in bands])
    df = bars.select(*keys, t, "high", "low", "close", F.inline(rows)).filter((F.col(t) >= F.col("a")) & (F.col(t) <= F.col("z")))
    inside = (F.col("close") >= F.col("lower")) & (F.col("close") <= F.col("upper"))
    all_in = (F.col("low") >= F.col("lower")) & (F.col("high") <= F.col("upper"))
    return df.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("close", t).alias("last"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count_if(inside).alias("close_inside"), F.max_by(inside, t).alias("endpoint_inside"),
        F.every(all_in).alias("all_intraday_inside"), F.min(F.when(~all_in, F.col(t))).alias("first_breach"),
    )
