"""Event studies: what followed, what came before, and how cases compare.

Outcomes are computed once per bar with windows and looked up by equality or as-of, so the
cost does not depend on how many events fall on the same days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ordered
from tidemark.operators.align import asof_join

HORIZONS = (1, 5, 10, 20)


def forward_returns(bars: DataFrame, keys, t: str, x: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Return over the next k sessions per bar, and the same minus the mean of the other series
    that have one from that date on (the control); null without any."""
    w = ordered(keys, t)
    cols = {f"fwd_{k}": F.lead(x, k).over(w) / F.col(x) - 1 for k in horizons}
    out = bars.select(*keys, t, F.col(x).alias("base"), *[c.alias(n) for n, c in cols.items()], *[F.lead(t, k).over(w).alias(f"known_{k}") for k in horizons])
    all_ = out.groupBy(t).agg(*[f(f"fwd_{k}").alias(f"__{n}{k}") for k in horizons for n, f in (("s", F.sum), ("n", F.count))])
    out = out.join(all_, t)
    own = lambda k: F.col(f"fwd_{k}")
    others = {k: F.try_divide(F.col(f"__s{k}") - own(k), F.col(f"__n{k}") - 1) for k in horizons}
    return out.withColumns({f"abn_{k}": own(k) - others[k] for k in horizons}).drop(*[f"__{n}{k}" for k in horizons for n in "sn"])


def event_returns(events: DataFrame, bars: DataFrame, keys, t: str, x: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward and abnormal returns of the session on or before each event date.

    Outcomes are joined to the distinct event dates of a series; events follow by equality.
    """
    cols = [c for k in horizons for c in (f"fwd_{k}", f"abn_{k}", f"known_{k}")]
    outcome = forward_returns(bars, keys, t, x, horizons)
    days = events.select(*keys, t).distinct()
    matched = asof_join(days, outcome, keys, t, ["base", *cols], match_time="session")
    return events.join(matched, [*keys, t])


def earlier_analogs(returns: DataFrame, keys, t: str, category: str, k: int) -> DataFrame:
    """Mean abnormal return of earlier events of the same series and category whose outcome
    was already known before the event date.

    Outcomes are summed by the day they became known; a strict as-of join reads the totals.
    """
    by = [*keys, category]
    known = returns.filter(F.col(f"abn_{k}").isNotNull()).groupBy(*by, F.col(f"known_{k}").alias(t)).agg(
        F.sum(f"abn_{k}").alias("__s"), F.count(F.lit(1)).alias("__n"))
    run = ordered(by, t).rowsBetween(Window.unboundedPreceding, 0)
    totals = known.select(*by, t, F.sum("__s").over(run).alias("__s"), F.sum("__n").over(run).alias("analogs"))
    days = returns.select(*by, t).distinct()
    out = asof_join(days, totals, by, t, ["__s", "analogs"], strict=True)
    out = out.select(*by, t, F.coalesce("analogs", F.lit(0)).alias("analogs"), (F.col("__s") / F.col("analogs")).alias("analog_mean"))
    return returns.join(out, [*by, t])


def day_number(t: str):
    return F.datediff(F.col(t), F.lit("1970-01-01").cast("date"))


def post_event_min(events: DataFrame, bars: DataFrame, keys, t: str, x: str, days: int = 365) -> DataFrame:
    """Lowest value from the event session to `days` later: date, days and percent from the event.

    The forward minimum is a range frame over bars (one row per day, so at most days + 1 rows).
    """
    ahead = Window.partitionBy(*keys).orderBy(day_number(t)).rangeBetween(0, days)
    low = F.min(F.struct(F.col(x).alias("v"), F.col(t).alias("d"))).over(ahead)
    outcome = bars.select(*keys, t, F.col(x).alias("event_value"), low.alias("__low"))
    matched = asof_join(events.select(*keys, t).distinct(), outcome, keys, t, ["event_value", "__low"], match_time="session")
    out = events.join(matched, [*keys, t])
    return out.withColumns({
        "min_date": F.col("__low.d"), "min_value": F.col("__low.v"), "days_to_min": F.datediff("__low.d", t),
        "min_pct": (F.col("__low.v") / F.col("event_value") - 1) * 100,
    }).drop("__low")


def pre_event_peak(events: DataFrame, bars: DataFrame, keys, t: str, x: str) -> DataFrame:
    """Highest value up to the event session (the latest such day), its age and the drop since."""
    run = ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct(F.col(x).alias("v"), F.col(t).alias("d"))).over(run)
    outcome = bars.select(*keys, t, F.col(x).alias("event_value"), top.alias("__top"))
    matched = asof_join(events.select(*keys, t).distinct(), outcome, keys, t, ["event_value", "__top"])
    out = events.join(matched, [*keys, t])
    return out.withColumns({
        "peak_date": F.col("__top.d"), "peak_value": F.col("__top.v"), "days_since_peak": F.datediff(t, "__top.d"),
        "drawdown_pct": (F.col("event_value") / F.col("__top.v") - 1) * 100,
    }).drop("__top")


def event_deltas(stages: DataFrame, keys, t: str, prices: Sequence[str] = (), rates: Sequence[str] = ()) -> DataFrame:
    """Change from the previous stage of the case: percent for prices, basis points for rates."""
    w = ordered(keys, t)
    cols = {f"{c}_delta_pct": (F.try_divide(F.col(c), F.lag(c).over(w)) - 1) * 100 for c in prices}
    cols |= {f"{c}_delta_bp": (F.col(c) - F.lag(c).over(w)) * 100 for c in rates}
    return stages.withColumns(cols)


def case_endpoints(stages: DataFrame, keys, t: str, values: Sequence[str]) -> DataFrame:
    """First against last stage of each case, and days between."""
    aggs = [F.min(t).alias("start_date"), F.max(t).alias("end_date"), F.count(F.lit(1)).alias("stages")]
    for v in values:
        aggs += [F.min_by(v, t).alias(f"start_{v}"), F.max_by(v, t).alias(f"end_{v}")]
    out = stages.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"{v}_change_pct": (F.try_divide(F.col(f"end_{v}"), F.col(f"start_{v}")) - 1) * 100 for v in values}).withColumn("days", F.datediff("end_date", "start_date"))


def segment_returns(bars: DataFrame, keys, t: str, x: str, points: Sequence[str]) -> DataFrame:
    """Return between neighbouring listed dates, each valued at the last bar on or before it."""
    dates = F.array(*[F.lit(p).cast("date") for p in sorted(points)])
    # each bar keeps only the points it may serve: the latest bar per point wins
    value = bars.select(*keys, t, x, F.explode(F.filter(dates, lambda d: F.col(t) <= d)).alias("point"))
    at = value.groupBy(*keys, "point").agg(F.max_by(x, t).alias("v"), F.max(t).alias("quote_date"))
    w = ordered(keys, "point")
    out = at.withColumns({"start": F.lag("point").over(w), "__v": F.lag("v").over(w)}).filter(F.col("start").isNotNull())
    return out.select(*keys, "start", F.col("point").alias("end"), "quote_date", ((F.col("v") / F.col("__v") - 1) * 100).alias("return_pct"))
