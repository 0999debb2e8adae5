"""Parameter sweeps, selection with frozen winners, and causality checks.

A sweep is one plan: indicators once per series and length, one copy of the row per
parameter set, then windows partitioned by (series, set). The grid is a driver-side
parameter list; the data is never looped over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import literal_lookup, ordered, simple_return
from tidemark.operators import indicators as ind
from tidemark.operators import metrics as met
from tidemark.operators import signals as sig
from tidemark.operators.align import first_in_group, two_way_difference

# The registered grid, in the order that breaks ties.
GRID = dict(
    family=["channel", "trend_trail", "ensemble", "dual_momentum", "vol_trend", "pullback"],
    horizon=[60, 120, 180],
    cap=[0.55, 0.65, 0.75, 0.85],
    stop=[0.08, 0.12],
    frequency=["weekly", "monthly"],
)

# Cost and delay scenarios as (name, cost per side, sessions of extra delay).
STRESS = [("base", 0.0015, 0), ("standard_fee", 0.015, 0), ("extra_session_delay", 0.0015, 1), ("double_spread", 0.003, 0),
          ("combined_cost_delay", 0.004, 1), ("slow_settlement", 0.0015, 3)]


def grid(dims: dict[str, Sequence] | None = None, **fixed) -> list[dict]:
    """All combinations in registry order, numbered from 0."""
    dims = dims or GRID
    return [dict(spec_id=i, **dict(zip(dims, values)), **fixed) for i, values in enumerate(product(*dims.values()))]


def neighbours(spec: dict, deltas: dict[str, Sequence]) -> list[dict]:
    """One-at-a-time changes of a parameter set, numbered from 0 with the original first."""
    changed = [dict(spec, changed="none")] + [dict(spec, **{f: v}, changed=f"{f}={v}") for f, vs in deltas.items() for v in vs]
    return [dict(s, spec_id=i) for i, s in enumerate(changed)]


def sweep_curves(bars: DataFrame, keys, t: str, specs: Sequence[dict], cost=0.003, stress: Sequence[tuple] = (), keep: DataFrame | None = None) -> DataFrame:
    """Equity per (keys, spec_id) and, with `stress`, per scenario of cost and delay.

    `keep` restricts the sweep to spec_ids found in that (small, frozen) table before
    anything is shuffled.
    """
    specs = [{**sig.SPEC_DEFAULTS, **s} for s in specs]
    slim = [{k: v for k, v in s.items() if k != "changed"} for s in specs]
    rows = sig.raw_signal(bars, keys, t, "close", slim, carry=["open", "close"], spread=keep is None)
    rows = rows.select(*keys, t, "open", "close", "i", "raw", "danger", "review", "spec_id", "cooldown", "family")
    if keep is not None:
        rows = rows.join(keep.select("spec_id"), "spec_id", "left_semi").repartition(*keys, "spec_id")
    by = [*keys, "spec_id"]
    target = sig.gated_target(rows, by, t).select(*by, t, "open", "close", "target")
    w = ordered(by, t)
    if not stress:
        weights = target.withColumn("weight", F.lag("target", 1, 0.0).over(w))
        return met.equity_curve(weights, by, t, cost=cost)
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(c)).alias("cost"), F.lag("target", 1 + d, 0.0).over(w).alias("weight")) for n, c, d in stress])
    copies = target.withColumn("__s", scenarios).select(*by, t, "open", "close", F.inline("__s"))
    return met.equity_curve(copies, [*by, "scenario"], t, cost="cost")


def sweep(bars: DataFrame, keys, t: str, specs, phases, cost=0.003, **how) -> DataFrame:
    """Phase metrics of every parameter set on every series."""
    by = [*keys, "spec_id", *(["scenario"] if how.get("stress") else [])]
    return met.performance(sweep_curves(bars, keys, t, specs, cost, **how), by, t, phases)


def spec_column(specs: Sequence[dict], field: str):
    """Look up a parameter by spec_id; the grid is a literal map."""
    return literal_lookup("spec_id", {s["spec_id"]: s[field] for s in specs})


def select_frozen(perf: DataFrame, specs: Sequence[dict], product_key: str, phases: Sequence[str], years: float, limits) -> DataFrame:
    """The best feasible set of each family by its weakest product, on training phases only.

    Ties go to the set registered first. At most one row per family.
    """
    scores = met.worst_product_score(perf, ["spec_id"], product_key, phases, years, limits).filter("feasible")
    scores = scores.withColumns({"family": spec_column(specs, "family"), "score": F.round("score", 9)})
    return first_in_group(scores, ["family"], F.desc("score"), "spec_id").select("family", "spec_id", "score")


def validate_frozen(frozen: DataFrame, perf: DataFrame, phases: Sequence[str], limits, most: int = 3) -> DataFrame:
    """Veto frozen winners that break a limit in any phase; never rank again.

    The first `most` survivors, in frozen order, are marked as chosen.
    """
    ok = met.feasible(perf, ["spec_id"], phases, *limits).withColumnRenamed("feasible", "eligible")
    out = frozen.join(ok, "spec_id")
    # at most one row per family, so a single ordered group is bounded by the grid
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "spec_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"frozen_rank": F.row_number().over(order), "__k": F.sum(F.col("eligible").cast("int")).over(run)})
    return out.withColumn("chosen", F.col("eligible") & (F.col("__k") <= most)).drop("__k")


def causality_diff(fn: Callable[[DataFrame], DataFrame], df: DataFrame, t: str, cut: str, x: str, factor: float = 1.7) -> DataFrame:
    """Outputs dated before `cut` that change when inputs from `cut` on are multiplied."""
    moved = df.withColumn(x, F.when(F.col(t) >= F.lit(cut).cast("date"), F.col(x) * factor).otherwise(F.col(x)))
    before = lambda d: fn(d).filter(F.col(t) < F.lit(cut).cast("date"))
    return two_way_difference(before(df), before(moved))


def prefix_replay(fn, df: DataFrame, keys, t: str, cuts: Sequence[str]) -> DataFrame:
    """Outputs of truncated histories that differ from the full run, per cut date.

    `fn(df, keys)` is run once with the cut as an extra key.
    """
    points = F.array(*[F.lit(c).cast("date") for c in cuts])
    short = df.withColumn("cut", F.explode(F.filter(points, lambda c: F.col(t) < c)))
    full = fn(df, list(keys))
    full = full.withColumn("cut", F.explode(F.filter(points, lambda c: F.col(t) < c)))
    replay = fn(short, [*keys, "cut"]).select(*full.columns)
    return two_way_difference(full, replay)


def walk_forward(perf: DataFrame, keys, folds: Sequence[tuple[str, str]]) -> DataFrame:
    """Per fold (training phase, next phase) and series: the set that was best in training
    and how it and the training score did next."""
    rows = F.array(*[F.struct(F.lit(f"{a}>{b}").alias("fold"), F.lit(a).alias("__train"), F.lit(b).alias("__next")) for a, b in folds])
    df = perf.select(*keys, "spec_id", "phase", F.round("return_pct", 6).alias("r"), F.inline(rows))
    df = df.filter((F.col("phase") == F.col("__train")) | (F.col("phase") == F.col("__next")))
    pair = df.groupBy(*keys, "fold", "spec_id").agg(
        F.max(F.when(F.col("phase") == F.col("__train"), F.col("r"))).alias("train_return"),
        F.max(F.when(F.col("phase") == F.col("__next"), F.col("r"))).alias("next_return"))
    return first_in_group(pair.dropna(), [*keys, "fold"], F.desc("train_return"), "spec_id")


# ridge forecasts

FEATURES = ["f_r5", "f_r20", "f_r60", "f_vol20", "f_gap20", "f_gap60", "f_dd60", "f_range"]


def ridge_features(bars: DataFrame, keys, t: str, horizon: int) -> DataFrame:
    """Eight lagged features, the label over the next `horizon` rows and the label's end date."""
    w = ordered(keys, t)
    df = ind.moving_means(bars, keys, t, "close", [20, 60]).withColumn("__r", simple_return("close", 1, w))
    return df.select(
        *keys, t, "close", simple_return("close", 5, w).alias("f_r5"), simple_return("close", 20, w).alias("f_r20"),
        simple_return("close", 60, w).alias("f_r60"), ind.full_window("std", "__r", 20, keys, t).alias("f_vol20"),
        (F.col("close") / F.col("ma_20") - 1).alias("f_gap20"), (F.col("close") / F.col("ma_60") - 1).alias("f_gap60"),
        (F.col("close") / ind.full_window("max", "close", 60, keys, t) - 1).alias("f_dd60"),
        ((F.col("high") - F.col("low")) / F.col("close")).alias("f_range"),
        (F.lead("close", horizon).over(w) / F.col("close") - 1).alias("label"), F.lead(t, horizon).over(w).alias("label_end"),
        F.row_number().over(w).alias("i"),
    )


def ridge_walk_forward(bars: DataFrame, keys, t: str, window: int = 504, horizon: int = 20, alpha: float = 1.0, least_rows: int | None = None) -> DataFrame:
    """Forecast each row with a ridge fit made at the start of its month; one row per bar.

    The fit of a month uses the last `window` rows whose label ended before the month, and
    standardises with their moments only. Rows are chosen by their number alone: numbers are cut
    into buckets of `window`, of which a month's rows lie in at most two. The moments are aggregated
    per (series, month) and only these few numbers reach numpy, one solve per month.
    Bars of a month with fewer than `least_rows` training rows (default `window`), or without all
    features, have a null forecast and signal 0.
    """
    least_rows = window if least_rows is None else least_rows
    df = ridge_features(bars, keys, t, horizon).withColumn("month", F.trunc(t, "MM"))
    ready = df.dropna(subset=FEATURES)
    first = df.groupBy(*keys, "month").agg(F.min("i").alias("first_row"))
    # rows i with first_row - horizon - window <= i < first_row - horizon have known labels
    bucket = lambda i: F.floor(i / F.lit(window))
    end = F.col("first_row") - horizon
    first = first.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(end - window), bucket(end - 1)))))
    train = ready.filter(F.col("label").isNotNull()).drop("month").withColumn("bucket", bucket(F.col("i"))).join(first, [*keys, "bucket"])
    last_known = F.col("first_row") - horizon
    train = train.filter((F.col("i") < last_known) & (F.col("i") >= last_known - window))
    z = [*FEATURES, "label"]
    pairs = [(a, b) for i, a in enumerate(z) for b in z[i:]]
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(a).alias(f"s_{a}") for a in z] + [F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs]
    moments = train.groupBy(*keys, "month").agg(*sums).filter(F.col("n") >= least_rows)
    k = len(FEATURES)
    schema = T.StructType([moments.schema[c] for c in [*keys, "month"]]).add("n", "double").add("weights", T.ArrayType(T.DoubleType())).add("bias", "double")

    def solve(batches):
        for m in batches:
            n = m["n"].to_numpy()
            mean = np.stack([m[f"s_{a}"] for a in z], axis=1) / n[:, None]
            second = np.zeros((len(m), k + 1, k + 1))
            for a, b in pairs:
                i, j = z.index(a), z.index(b)
                second[:, i, j] = second[:, j, i] = m[f"q_{a}_{b}"] / n
            cov = second - mean[:, :, None] * mean[:, None, :]
            var = np.diagonal(cov, axis1=1, axis2=2)[:, :k]
            # a feature that does not vary (up to rounding) gets no weight
            flat = var <= 1e-12 * np.diagonal(second, axis1=1, axis2=2)[:, :k]
            sd = np.sqrt(np.where(flat, 1.0, var))
            live = np.where(flat, 0.0, 1.0)
            xx = cov[:, :k, :k] / sd[:, :, None] / sd[:, None, :] * live[:, :, None] * live[:, None, :]
            xy = cov[:, :k, k] / sd * live
            beta = np.linalg.solve(xx + alpha / n[:, None, None] * np.eye(k), xy[:, :, None])[:, :, 0] / sd
            bias = mean[:, k] - (beta * mean[:, :k]).sum(axis=1)
            out = m[[*keys, "month", "n"]].copy()
            yield out.assign(weights=list(beta), bias=bias)

    fits = moments.mapInPandas(solve, schema)
    dot = F.col("bias")
    for i, a in enumerate(FEATURES):
        dot = dot + F.col("weights")[i] * F.col(a)
    return df.join(fits, [*keys, "month"], "left").select(
        *keys, t, "month", F.col("n").cast("int").alias("train_rows"), dot.alias("forecast"), "label",
        F.when(dot > 0, 1.0).otherwise(0.0).alias("signal"))
