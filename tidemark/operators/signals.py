"""Trading-style signals. A value dated D uses nothing after the close of D.

Every rule that looks like a loop but whose switch points do not depend on its own state is
written as "last event so far" over a window. Only the entry/exit machine, whose stop uses
the peak since its own entry, is a fold: Catalyst computes all indicators and conditions,
and a small vectorised loop per series steps through them for all parameter sets at once.
A series holds one row per date, so such a group is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import literal_groups, month_key, ordered, quantise, ratio_clip, simple_return, week_ending_friday
from tidemark.operators import indicators as ind
from tidemark.operators.align import lagged_features

# Defaults of a parameter set and of the production entry/exit rule.
SPEC_DEFAULTS = dict(family="channel", horizon=90, exit_days=20, cap=0.65, vol_target=0.12, stop=0.10,
                     frequency="weekly", band=0.10, cooldown=10)
PRODUCTION_RULE = dict(slow=120, fast=20, buffer=0.02, exit_buffer=0.02, breakout=90, entry_mode="either",
                       stop=0.08, cooldown=5, reentry_filter="none")


def latest_event(event: Column, keys, t: str, initial: float = 0.0) -> Column:
    """The most recent non-null event at or before the row."""
    run = ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(run), F.lit(initial))


def hysteresis_event(x, ma, buffer: float) -> Column:
    x, ma = F.col(x), F.col(ma)
    return F.when(x > ma * (1 + buffer), 1.0).when(x < ma * (1 - buffer), 0.0)


def hysteresis(df: DataFrame, keys, t: str, x: str, n: int, buffer: float = 0.02, out: str = "state") -> DataFrame:
    """On above the band around the n-mean, off below it, unchanged inside."""
    had = f"ma_{n}" in df.columns
    df = df if had else ind.moving_means(df, keys, t, x, [n])
    df = df.withColumn(out, latest_event(hysteresis_event(x, f"ma_{n}", buffer), keys, t))
    return df if had else df.drop(f"ma_{n}")


def channel(df: DataFrame, keys, t: str, x: str, n: int, m: int, cap: float = 1.0, out: str = "state") -> DataFrame:
    """On at a new n-high (of earlier rows), else off at a new m-low; times cap."""
    hi = ind.full_window("max", x, n, keys, t, prior=True)
    lo = ind.full_window("min", x, m, keys, t, prior=True)
    df = df.withColumns({"__hi": hi, "__lo": lo})
    event = F.when(F.col(x) >= F.col("__hi"), 1.0).when(F.col(x) <= F.col("__lo"), 0.0)
    return df.withColumn(out, latest_event(event, keys, t) * cap).drop("__hi", "__lo")


def macro_votes(df: DataFrame, dollar: DataFrame, real_yield: DataFrame, fear: DataFrame, keys, t: str, value: str) -> DataFrame:
    """How many of three lagged macro tests favour the asset: dollar and real yield lower than
    60 rows ago, fear gauge up at most 30% in 10 rows. Unknown counts as no."""
    df = lagged_features(df, {"__dollar": dollar, "__real": real_yield, "__fear": fear}, t, value)
    w = ordered(keys, t)
    tests = [
        simple_return("__dollar", 60, w) < 0,
        F.col("__real") - F.lag("__real", 60).over(w) < 0,
        simple_return("__fear", 10, w) <= 0.30,
    ]
    votes = sum((F.coalesce(c, F.lit(False)).cast("int") for c in tests), F.lit(0))
    return df.withColumn("votes", votes).drop("__dollar", "__real", "__fear")


def raw_signal(df: DataFrame, keys, t: str, x: str, specs: Sequence[dict], carry: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """Unquantised rules of every family for every parameter set, on the 5% grid.

    Returns (keys, t, carry.., spec_id, raw, danger, review, i, parameters..). Indicators
    are computed once per distinct length, whatever the number of sets, and only then is
    each row copied per set. `spread` shuffles the copies by (keys, spec_id), so that few
    series with many sets still use the whole cluster.
    """
    specs = [{**SPEC_DEFAULTS, **s} for s in specs]
    shapes = sorted({(s["horizon"], s["exit_days"]) for s in specs})
    shape_id = {hx: k for k, hx in enumerate(shapes)}
    horizons = sorted({h for h, _ in shapes})
    w = ordered(keys, t)
    macro = any(s["family"] == "legacy_macro" for s in specs)

    halves = {h: max(20, h // 2) for h in horizons}
    lengths = {*horizons, *halves.values(), *(2 * h for h in horizons), *([90] if macro else [])}
    df = ind.moving_means(df, keys, t, x, sorted(lengths))
    df = df.withColumns({"__r": simple_return(x, 1, w), "i": F.row_number().over(w)})
    cols = {"__vol40": ind.annual_volatility("__r", 40, keys, t),
            "__new_month": ind.period_change(keys, t, month_key(t)), "__new_week": ind.period_change(keys, t, week_ending_friday(t))}
    families = {s["family"] for s in specs}
    if "legacy_momentum" in families:
        cols |= {"__vol60": ind.annual_volatility("__r", 60, keys, t), "__m252": simple_return(x, 252, w)}
    for n in sorted(lengths):
        if n != 90 or n in horizons or not macro:
            cols[f"__tr{n}"] = latest_event(hysteresis_event(x, f"ma_{n}", 0.02), keys, t)
    if macro:
        cols["__tr90w"] = latest_event(hysteresis_event(x, "ma_90", 0.04), keys, t)
    for h in horizons:
        cols |= {f"__top{h}": ind.full_window("max", x, h, keys, t), f"__m{h}": simple_return(x, h, w), f"__m{2*h}": simple_return(x, 2 * h, w)}
        if families & {"channel", "legacy_channel"}:
            cols[f"__hi{h}"] = ind.full_window("max", x, h, keys, t, prior=True)
    if families & {"channel", "legacy_channel"}:
        for e in sorted({e for _, e in shapes}):
            cols[f"__lo{e}"] = ind.full_window("min", x, e, keys, t, prior=True)
    df = df.withColumns(cols)
    if families & {"channel", "legacy_channel"}:
        df = df.withColumns({
            f"__ch{h}_{e}": latest_event(F.when(F.col(x) >= F.col(f"__hi{h}"), 1.0).when(F.col(x) <= F.col(f"__lo{e}"), 0.0), keys, t)
            for h, e in shapes
        })

    def yes(c):
        return F.coalesce(c, F.lit(False)).cast("double")

    def shape(h, e):
        return F.struct(
            F.lit(shape_id[h, e]).alias("shape"),
            F.col(f"__tr{h}").alias("trend"),
            ((F.col(f"__tr{halves[h]}") + F.col(f"__tr{h}") + F.col(f"__tr{2*h}")) / 3).alias("vote"),
            ((yes(F.col(f"__m{h}") > 0) + yes(F.col(f"__m{2*h}") > 0)) / 2).alias("momentum"),
            (F.col(f"__ch{h}_{e}") if families & {"channel", "legacy_channel"} else F.lit(0.0)).alias("channel"),
            (F.col(x) / F.col(f"__top{h}") - 1).alias("dd"),
            F.coalesce(F.col(x) < F.col(f"ma_{h}") * 1.03, F.lit(False)).alias("near"),
        )

    base = [*keys, t, *carry, "i", "__vol40", "__new_month", "__new_week"]
    extra = {"__vol60": F.col("__vol60"), "__m252": F.col("__m252")} if "legacy_momentum" in families else {}
    if macro:
        extra |= {"__tr90w": F.col("__tr90w")} | ({} if "votes" in carry else {"votes": F.col("votes")})
    df = df.select(*base, *extra, F.explode(F.array(*[shape(h, e) for h, e in shapes])).alias("f"))

    by_shape = {k: [s for s in specs if (s["horizon"], s["exit_days"]) == hx] for hx, k in shape_id.items()}
    df = df.withColumn("s", F.explode(F.element_at(literal_groups(by_shape), F.col("f.shape").cast("string"))))

    cap, fam = F.col("s.cap"), F.col("s.family")
    scaled = ratio_clip(F.col("s.vol_target"), "__vol40", 0.2, 1.0)
    f = lambda n: F.col(f"f.{n}")
    raw = (
        F.when(fam.isin("channel", "legacy_channel"), f("channel") * cap)
        .when(fam == "trend_trail", f("trend") * cap)
        .when(fam == "vol_trend", f("trend") * cap * scaled)
        .when(fam == "ensemble", f("vote") * cap)
        .when(fam == "dual_momentum", f("momentum") * cap * scaled)
        .when(fam == "pullback", f("trend") * F.when(f("near"), cap).otherwise(cap * 0.5))
        .when(fam == "hold", cap)
    )
    if "legacy_momentum" in families:
        up = F.coalesce(F.col("__m252") > 0, F.lit(False))
        raw = raw.when(fam == "legacy_momentum", F.when(up, cap * ratio_clip(F.lit(0.14), "__vol60", 0.25, 1.0)).otherwise(0.0))
    if macro:
        raw = raw.when(fam == "legacy_macro", F.col("__tr90w") * (F.col("votes") >= 1).cast("double") * cap)
    calm = fam.startswith("legacy") | (fam == "hold")
    review = F.when(fam == "hold", F.col("i") == 1).when(F.col("s.frequency") == "monthly", F.col("__new_month")).otherwise(F.col("__new_week"))
    out = df.select(
        *keys, t, *carry, "i", quantise(raw).alias("raw"),
        (~calm & F.coalesce(f("dd") < -F.col("s.stop"), F.lit(False))).alias("danger"), review.alias("review"), "s.*",
    )
    # shuffled last, when rows are narrow
    return out.repartition(*keys, "spec_id") if spread else out


def gated_target(df: DataFrame, keys, t: str, raw="raw", danger="danger", review="review", i="i", cooldown="cooldown", out="target") -> DataFrame:
    """Zero and blocked for `cooldown` rows after danger; otherwise adopt raw on review rows.

    Danger does not depend on the target, so the block is a running maximum of the last
    dangerous row and the target is the last event.
    """
    run = ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    wait = F.lit(cooldown) if isinstance(cooldown, int) else F.col(cooldown)
    df = df.withColumn("__bad", F.max(F.when(F.col(danger), F.col(i))).over(run))
    free = F.col("__bad").isNull() | (F.col(i) >= F.col("__bad") + wait)
    event = F.when(F.col(danger), F.lit(0.0)).when(F.col(review) & free, F.col(raw))
    return df.withColumn(out, latest_event(event, keys, t)).drop("__bad")


def month_end_target(df: DataFrame, keys, t: str, raw: str, out: str = "target") -> DataFrame:
    """The last raw value of each complete month, held until the next one.

    The month still running (no later month observed) never contributes.
    """
    w = ordered(keys, t)
    closes_month = F.coalesce(F.lead(month_key(t)).over(w) != month_key(t), F.lit(False))
    df = df.withColumn("__e", F.when(closes_month, F.col(raw)))
    return df.withColumn(out, latest_event(F.col("__e"), keys, t)).drop("__e")


# entry/exit machine


def step_machines(price, entry, leave, stop, cooldown, start=None):
    """Run independent entry/exit machines over the rows of price.

    price is (rows, 1) or (rows, machines); entry and leave are (rows, machines); stop and
    cooldown hold one value per machine. Returns the states and the memory to go on from:
    (on, peak since entry, first row at which entry is allowed again).
    """
    n, k = entry.shape
    states = np.zeros((n, k), dtype=bool)
    on, peak, wait = start or (np.zeros(k, bool), np.zeros(k), np.zeros(k, int))
    for i in range(n):
        p = price[i]
        peak = np.where(on, np.maximum(peak, p), peak)
        out = on & (leave[i] | (p < peak * (1 - stop)))
        enter = ~on & entry[i] & (wait <= 0)
        on = (on & ~out) | enter
        wait = np.where(out, cooldown, wait) - 1
        peak = np.where(enter, p, peak)
        states[i] = on
    return states, (on, peak, wait)


def fold_states(df: DataFrame, keys, t: str, price: str, machines: Sequence[dict], carry: Sequence[str] = ()) -> DataFrame:
    """Daily state per machine: dict(spec_id, entry, leave, stop, cooldown), entry and leave
    naming boolean columns of df (null is false). Returns (keys, t, carry.., spec_id, state)."""
    ids = [m["spec_id"] for m in machines]
    stop = np.array([m["stop"] for m in machines], dtype=float)
    cooldown = np.array([m["cooldown"] for m in machines], dtype=int)
    flags = {f"__e{j}": m["entry"] for j, m in enumerate(machines)} | {f"__l{j}": m["leave"] for j, m in enumerate(machines)}
    kept = [*keys, t, *carry]
    flagged = df.select(*dict.fromkeys([*kept, price]), *[F.coalesce(F.col(c), F.lit(False)).alias(n) for n, c in flags.items()])
    k = len(machines)
    schema = T.StructType([flagged.schema[c] for c in kept]).add("spec_id", "integer").add("state", "double")

    def per_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(t)
        entry = rows[[f"__e{j}" for j in range(k)]].to_numpy(bool)
        leave = rows[[f"__l{j}" for j in range(k)]].to_numpy(bool)
        states, _ = step_machines(rows[[price]].to_numpy(float), entry, leave, stop, cooldown)
        out = rows[kept].loc[rows.index.repeat(k)]
        return out.assign(spec_id=np.tile(ids, len(rows)), state=states.ravel().astype(float))

    return flagged.groupBy(*keys).applyInPandas(per_series, schema)


def breakout_conditions(df: DataFrame, keys, t: str, x: str, rules: Sequence[dict]) -> tuple[DataFrame, list[dict]]:
    """Entry and leave columns of each moving-average/breakout rule, and the machines to fold."""
    rules = [{**PRODUCTION_RULE, **r} for r in rules]
    lengths = sorted({r["slow"] for r in rules} | {r["fast"] for r in rules})
    df = ind.moving_means(df, keys, t, x, lengths)
    w = ordered(keys, t)
    tops = sorted({r["breakout"] for r in rules})
    df = df.withColumns({f"__top{n}": ind.full_window("max", x, n, keys, t, prior=True) for n in tops})
    df = df.withColumns({f"__ago{r['fast']}": F.lag(f"ma_{r['fast']}", 5).over(w) for r in rules if r["reentry_filter"] == "rising_ma20"})
    cols, machines = {}, []
    for j, r in enumerate(rules):
        p, fast, slow = F.col(x), F.col(f"ma_{r['fast']}"), F.col(f"ma_{r['slow']}")
        no = F.lit(False)
        trend = F.coalesce(fast > slow * (1 + r["buffer"]), no)
        higher = F.coalesce((p > F.col(f"__top{r['breakout']}")) & (p > slow), no)
        entry = {"either": trend | higher, "both": trend & higher, "breakout": higher}[r["entry_mode"]]
        if r["reentry_filter"] != "none":
            entry = entry & (p > fast)
        if r["reentry_filter"] == "rising_ma20":
            entry = entry & (fast > F.col(f"__ago{r['fast']}"))
        cols |= {f"entry_{j}": entry, f"leave_{j}": fast < slow * (1 - r["exit_buffer"])}
        machines.append(dict(spec_id=r.get("spec_id", j), entry=f"entry_{j}", leave=f"leave_{j}", stop=r["stop"], cooldown=r["cooldown"]))
    return df.withColumns(cols), machines


def ma_breakout(df: DataFrame, keys, t: str, x: str, rules: Sequence[dict], carry: Sequence[str] = ()) -> DataFrame:
    """Daily `state` (after the close) and `target` (state one bar earlier) of each rule."""
    flagged, machines = breakout_conditions(df, keys, t, x, rules)
    out = fold_states(flagged, keys, t, x, machines, carry)
    return out.withColumn("target", F.lag("state", 1, 0.0).over(ordered([*keys, "spec_id"], t)))


def episodes(states: DataFrame, keys, t: str, state: str = "state") -> DataFrame:
    """(entry, exit) dates of every run of state 1; exit is the first row back at 0, null if open."""
    w = ordered(keys, t)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(state, 1, 0.0).over(w)
    df = states.withColumn("__up", ((F.col(state) > 0) & (before <= 0)).cast("int"))
    df = df.withColumn("episode", F.sum("__up").over(run)).filter(F.col("episode") > 0)
    return df.groupBy(*keys, "episode").agg(
        F.min(t).alias("entry_date"), F.min(F.when(F.col(state) <= 0, F.col(t))).alias("exit_date"))


def next_bar_thresholds(df: DataFrame, keys, t: str, x: str, fast: int = 20, slow: int = 120, buffer: float = 0.02, breakout: int = 90) -> DataFrame:
    """The next close that would flip each entry test, in closed form on the last bar.

    (S_f + p)/f > (1+b)(S_s + p)/s, with S the sums of the last f-1 and s-1 closes.
    """
    g = 1 + buffer
    cols = {
        "__f": ind.full_window("sum", x, fast - 1, keys, t), "__s": ind.full_window("sum", x, slow - 1, keys, t),
        "__top": ind.full_window("max", x, breakout, keys, t),
    }
    last = ind.last_row(df.withColumns(cols), keys, t)
    crossing = (F.lit(g * fast) * F.col("__s") - F.lit(float(slow)) * F.col("__f")) / F.lit(slow - g * fast)
    return last.select(*keys, t, x, crossing.alias("next_ma"), F.greatest("__top", F.col("__s") / (slow - 1)).alias("next_breakout"))


def scenario_sweep(df: DataFrame, keys, t: str, x: str, rule: dict | None = None, ratios: Sequence[float] = (), horizons=(1, 5, 10, 20)) -> DataFrame:
    """Lowest hypothetical constant close that has the rule on within n more bars, per horizon n; with `ratios` the lowest of
    these multiples of the last close.

    In closed form: after j equal closes p every mean is a p + b, so each test of bar j is an interval of p. The bounds are
    limits: an entry test holds just above them. Null if no price does.
    """
    r = {**PRODUCTION_RULE, **(rule or {})}
    flagged, machines = breakout_conditions(df, keys, t, x, [r])
    most = max(horizons)
    w = ordered(keys, t)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    past = fold_states(flagged, keys, t, x, machines, carry=[x])
    before = F.lag("state", 1, 0.0).over(w)
    past = past.withColumns({"__i": F.row_number().over(w), "__up": (F.col("state") > 0) & (before <= 0), "__down": (F.col("state") <= 0) & (before > 0)})
    past = past.withColumn("__entry", F.max(F.when(F.col("__up"), F.col("__i"))).over(run))
    past = past.withColumn("__peak", F.max(x).over(Window.partitionBy(*keys, "__entry")))
    past = past.withColumn("__back", F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.col("__i") + 1)

    fast, slow, top = r["fast"], r["slow"], r["breakout"]
    ends = {n - j for n in (fast, slow) for j in range(1, most + 1)} | {fast - j for j in range(-4, most)} | {-j for j in range(-4, 1)}
    sums = {k: F.sum(F.when(F.col("__back") <= k, F.col(x))) for k in range(1, max(slow, fast + 5) + 1) if k in ends or k < 5}
    last = past.groupBy(*keys).agg(
        F.max_by(x, t).alias("last_close"), F.max_by("state", t).alias("__on"), F.max_by("__peak", t).alias("__peak"),
        F.max(F.when(F.col("__down"), F.col("__i"))).alias("__out"), F.max("__i").alias("__n"),
        F.when(F.count(F.when(F.col("__back") <= top, F.col(x))) == top, F.max(F.when(F.col("__back") <= top, F.col(x)))).alias("__top"),
        *[F.when(F.count(F.when(F.col("__back") <= k, F.col(x))) == k, v).alias(f"__s{k}") for k, v in sums.items()])

    def mean(n: int, j: int):
        """(a, b): the mean of n rows up to the j-th hypothetical bar is a p + b; b is null without n rows."""
        if j >= n:
            return 1.0, F.lit(0.0)
        total = F.col(f"__s{n - j}")
        return max(j, 0) / n, (total - F.col(f"__s{-j}") if j < 0 else total) / n

    inf, never = float("inf"), (F.lit(0.0), F.lit(-1.0))

    def above(u, v, factor: float = 1.0):
        """The interval of prices at which u > factor * v."""
        a, b = u[0] - factor * v[0], u[1] - F.lit(float(factor)) * v[1]
        if abs(a) < 1e-12:
            lo, hi = F.lit(0.0), F.when(b > 0, inf).otherwise(-1.0)
        else:
            lo, hi = (F.greatest(-b / a, F.lit(0.0)), F.lit(inf)) if a > 0 else (F.lit(0.0), -b / a)
        return lo, F.when(b.isNull(), -1.0).otherwise(hi)

    def both(*tests):
        return (F.greatest(*[lo for lo, _ in tests]), F.least(*[hi for _, hi in tests])) if len(tests) > 1 else tests[0]

    price = (1.0, F.lit(0.0))

    def entry(j: int) -> Column:
        """The least price that is let in at bar j."""
        trend = above(mean(fast, j), mean(slow, j), 1 + r["buffer"])
        # later, the close before is the same
        higher = both(above(price, (0.0, F.col("__top"))), above(price, mean(slow, j))) if j == 1 else never
        ways = {"either": [trend, higher], "both": [both(trend, higher)], "breakout": [higher]}[r["entry_mode"]]
        filters = [above(price, mean(fast, j))] if r["reentry_filter"] != "none" else []
        filters += [above(mean(fast, j), mean(fast, j - 5))] if r["reentry_filter"] == "rising_ma20" else []
        found = [F.when(lo < hi, lo) for lo, hi in (both(way, *filters) for way in ways)]
        return F.least(*found) if len(found) > 1 else found[0]

    # held: out below the stop or when the means have crossed; without the means only the stop
    a, b = mean(fast, 1)[0] - (1 - r["exit_buffer"]) * mean(slow, 1)[0], mean(fast, 1)[1] - F.lit(1 - r["exit_buffer"]) * mean(slow, 1)[1]
    stop = F.col("__peak") * (1 - r["stop"])
    if abs(a) < 1e-12:
        held = F.when(b.isNull() | (b >= 0), stop)
    else:
        held = F.greatest(stop, F.when(b.isNotNull(), -b / a)) if a > 0 else F.when(b.isNull() | (stop <= -b / a), stop)
    # bars that an exit still blocks; one at the first bar blocks the others by its own
    blocked = F.when(F.col("__on") > 0, F.lit(max(r["cooldown"], 1))).otherwise(F.coalesce(F.col("__out") + (r["cooldown"] - 1) - F.col("__n"), F.lit(0)))
    on = F.col("__on") > 0
    low = last.withColumns({"__e0": F.when(on, held), **{f"__e{j}": F.when(blocked < j, entry(j)) for j in range(1, most + 1)}})
    least = {n: F.least(*[f"__e{j}" for j in range(n + 1)]) for n in horizons}
    if len(ratios):
        def on_grid(n):
            hits = [F.when((F.lit(float(q)) * F.col("last_close") > least[n]) | (F.lit(float(q)) * F.col("last_close") >= F.col("__e0")), F.lit(float(q)) * F.col("last_close")) for q in ratios]
            return F.least(*hits) if len(hits) > 1 else hits[0]

        least = {n: on_grid(n) for n in horizons}
    return low.select(*keys, "last_close", *[v.alias(f"within_{n}") for n, v in least.items()])


# combinations


def combine(cols: Sequence[str], mode: str, weight: float = 0.5) -> Column:
    """union: any on; filter: all on; blend: weight*a + (1-weight)*b."""
    if mode == "union":
        return F.greatest(*cols)
    if mode == "filter":
        return F.least(*cols)
    return F.col(cols[0]) * weight + F.col(cols[1]) * (1 - weight)


def baseline_union(df: DataFrame, keys, t: str, x: str, linear=(120, 0.1, 0.05), quadratic=(90, 0.5, 0.05), stop: float = 0.08) -> DataFrame:
    """Union of three machines: the production rule, a line fit and a weekly reviewed
    quadratic fit, each with a stop below its own peak.

    linear and quadratic are (rows, least R2, least annual log slope).
    """
    n1, r1, s1 = linear
    n2, r2, s2 = quadratic
    df, machines = breakout_conditions(df, keys, t, x, [dict(PRODUCTION_RULE, spec_id=0)])
    df = ind.rolling_linreg(df, keys, t, x, n1)
    df = ind.rolling_quadfit(df, keys, t, x, n2)
    week = ind.period_change(keys, t, week_ending_friday(t))
    line = F.coalesce((F.col("r2") >= r1) & (F.col("annual_slope") >= s1), F.lit(False))
    curve = F.coalesce((F.col("quad_r2") >= r2) & (F.col("annual_end_slope") >= s2), F.lit(False))
    df = df.withColumns({"__line": line, "__curve": curve, "__week": week})
    df = df.withColumns({
        "line_on": F.col("__line"), "line_off": ~F.col("__line"),
        "curve_on": F.col("__curve") & F.col("__week"), "curve_off": ~F.col("__curve") & F.col("__week"),
    })
    machines += [dict(spec_id=1, entry="line_on", leave="line_off", stop=stop, cooldown=0),
                 dict(spec_id=2, entry="curve_on", leave="curve_off", stop=stop, cooldown=0)]
    states = fold_states(df, keys, t, x, machines)
    pick = lambda k: F.max(F.when(F.col("spec_id") == k, F.col("state")))
    wide = states.groupBy(*keys, t).agg(pick(0).alias("rule"), pick(1).alias("line"), pick(2).alias("curve"))
    return wide.withColumn("union", combine(["rule", "line", "curve"], "union"))


def profit_lock(x: str, ma: str, keys, t: str, limit: float = 1.20) -> Column:
    """Extra danger: yesterday's price stood more than `limit` times its mean."""
    return F.coalesce(F.lag(F.col(x) / F.col(ma)).over(ordered(keys, t)) > limit, F.lit(False))


def confirm_all(conditions: Sequence[Column]) -> Column:
    """met / not_met / unknown: one known failure decides, otherwise a null keeps it open."""
    joint = conditions[0]
    for c in conditions[1:]:
        joint = joint & c
    return F.when(joint, "met").when(~joint, "not_met").otherwise("unknown")


def condition_panel(conditions: dict[str, Column]) -> list[Column]:
    """Counts of triggered, clear and unknown conditions, and a verdict without probability."""
    total = len(conditions)
    one = lambda c: F.when(c, 1).otherwise(0)
    hit = sum((one(c) for c in conditions.values()), F.lit(0))
    unknown = sum((one(c.isNull()) for c in conditions.values()), F.lit(0))
    verdict = F.when(hit == total, "triggered").when(hit > 0, "partial").when(unknown > 0, "unknown").otherwise("clear")
    return [hit.alias("triggered"), unknown.alias("unknown"), verdict.alias("verdict")]
