"""Rolling and ordered indicators per series (keys, time column, one row per time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import col, ordered

TRADING_DAYS = 252


def full_window(fn: str, x, n: int, keys: Sequence[str], t: str, prior: bool = False) -> Column:
    """fn over the last n observations, null until n non-null values exist.

    With `prior` the frame ends on the previous row.
    """
    w = ordered(keys, t)
    w = w.rowsBetween(-n, -1) if prior else w.rowsBetween(-(n - 1), 0)
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp}[fn]
    return F.when(F.count(col(x)).over(w) == n, agg(col(x)).over(w))


def rolling(df: DataFrame, keys, t: str, x: str, fn: str, n: int, out: str, prior: bool = False) -> DataFrame:
    return df.withColumn(out, full_window(fn, x, n, keys, t, prior))


def moving_means(df: DataFrame, keys, t: str, x: str, lengths: Sequence[int], scale: int = 12) -> DataFrame:
    """Rolling means of many lengths from one running sum, as columns ma_<n>.

    A frame of n rows is recomputed for every row, so the cost grows with n. Here each mean
    is the difference of two running sums: one pass for any number of lengths. The sums are
    decimals, so the difference is exact for values of up to `scale` decimal places and 16 digits
    before the point. The mean is null unless all n rows of the frame have a value.
    """
    w = ordered(keys, t)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        "__s": F.sum(F.col(x).cast(f"decimal({16 + scale},{scale})")).over(run),
        "__i": F.count(x).over(run),
    })
    cols = {}
    for n in sorted(set(lengths)):
        before, earlier = (F.coalesce(F.lag(c, n).over(w), F.lit(0)) for c in ("__s", "__i"))
        cols[f"ma_{n}"] = F.when(F.col("__i") - earlier == n, (F.col("__s") - before).cast("double") / n)
    return df.withColumns(cols).drop("__s", "__i")


def annual_volatility(x: str, n: int, keys, t: str) -> Column:
    """Sample deviation of n simple returns, annualised; `x` is the return column."""
    return full_window("std", x, n, keys, t) * F.sqrt(F.lit(float(TRADING_DAYS)))


def rolling_drawdown(df: DataFrame, keys, t: str, x: str, n: int, out: str = "drawdown") -> DataFrame:
    return df.withColumn(out, F.col(x) / full_window("max", x, n, keys, t) - 1)


def drawdown(df: DataFrame, keys, t: str, x: str, base=None, out: str = "drawdown") -> DataFrame:
    """Drop from the running maximum, which also counts the base value if given."""
    run = ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(x).over(run)
    peak = peak if base is None else F.greatest(peak, F.lit(base))
    return df.withColumn(out, F.col(x) / peak - 1)


def period_change(keys, t: str, key: Column) -> Column:
    """True on the first row of every period; the first row of a series always counts."""
    w = ordered(keys, t)
    return F.coalesce(key != F.lag(key).over(w), F.lit(True))


def last_of_period(df: DataFrame, keys, t: str, period: Column, complete_before=None) -> DataFrame:
    """The last row of every period, keeping only periods before `complete_before` if given."""
    rest = [c for c in df.columns if c not in keys]
    df = df.withColumn("__p", period)
    if complete_before is not None:
        df = df.filter(F.col("__p") < complete_before)
    picked = df.groupBy(*keys, "__p").agg(F.max_by(F.struct(*rest), F.col(t)).alias("__r"))
    return picked.select(*keys, "__r.*")


def change_points(df: DataFrame, keys, t: str, x: str, initial=0.0) -> DataFrame:
    """Rows where x differs from the previous row, with the previous value and date."""
    w = ordered(keys, t)
    out = df.withColumns({
        "previous": F.lag(x, 1, initial).over(w),
        "previous_date": F.lag(t).over(w),
    })
    return out.filter(F.col(x) != F.col("previous"))


def delay(x: str, k: int, keys, t: str, fill="first") -> Column:
    """Shift by k rows; the gap repeats the first value, or holds the given fill value."""
    w = ordered(keys, t)
    if fill == "first":
        whole = w.rowsBetween(Window.unboundedPreceding, 0)
        return F.when(F.row_number().over(w) > k, F.lag(x, k).over(w)).otherwise(F.first(x).over(whole))
    return F.lag(x, k, fill).over(w)


def row_index(keys, t: str) -> Column:
    return F.row_number().over(ordered(keys, t))


def last_row(df: DataFrame, keys, t: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(t)).alias("__r")).select(*keys, "__r.*")


def rolling_linreg(df: DataFrame, keys, t: str, y: str, n: int) -> DataFrame:
    """Slope and R2 of a straight line through the log of y over the last n rows.

    Adds slope (per row), annual_slope and r2, null until n rows exist.
    """
    w = ordered(keys, t)
    frame = w.rowsBetween(-(n - 1), 0)
    df = df.withColumns({"__y": F.ln(y), "__x": F.row_number().over(w).cast("double")})
    full = F.count("__y").over(frame) == n
    slope = F.when(full, F.regr_slope("__y", "__x").over(frame))
    return df.withColumns({
        "slope": slope,
        "annual_slope": slope * TRADING_DAYS,
        "r2": F.when(full, F.regr_r2("__y", "__x").over(frame)),
    }).drop("__y", "__x")


def rolling_quadfit(df: DataFrame, keys, t: str, y: str, n: int) -> DataFrame:
    """Quadratic through the log of y over the last n rows: slope at the end and R2.

    The abscissa is centred (u = i - (n-1)/2), so the design is orthogonal up to constants
    and only sums of y, u*y, u^2*y and y^2 change from row to row.
    """
    w = ordered(keys, t)
    frame = w.rowsBetween(-(n - 1), 0)
    half = (n - 1) / 2.0
    us = [i - half for i in range(n)]
    s2, s4 = sum(u**2 for u in us), sum(u**4 for u in us)
    df = df.withColumns({"__y": F.ln(y), "__g": F.row_number().over(w).cast("double")})
    # moments in the global row index, moved to the window centre afterwards
    df = df.withColumns({
        "__y0": F.sum("__y").over(frame),
        "__y1": F.sum(F.col("__y") * F.col("__g")).over(frame),
        "__y2": F.sum(F.col("__y") * F.col("__g") * F.col("__g")).over(frame),
        "__yy": F.var_pop("__y").over(frame) * n,
        "__n": F.count("__y").over(frame),
    })
    m = F.col("__g") - half
    c0 = F.col("__y0")
    c1 = F.col("__y1") - m * c0
    c2 = F.col("__y2") - 2 * m * F.col("__y1") + m * m * c0
    b = c1 / s2
    a = (n * c2 - s2 * c0) / (n * s4 - s2 * s2)
    explained = b * c1 + a * (c2 - s2 / n * c0)
    full = F.col("__n") == n
    return df.withColumns({
        "end_slope": F.when(full, b + 2 * a * half),
        "annual_end_slope": F.when(full, (b + 2 * a * half) * TRADING_DAYS),
        "quad_r2": F.when(full, F.try_divide(explained, F.col("__yy"))),
    }).drop("__y", "__g", "__y0", "__y1", "__y2", "__yy", "__n")


def trend_5_5_20(df: DataFrame, keys, t: str, x: str) -> DataFrame:
    """Means of the last 5, the 5 before, and the last 20; falling when the first is below both."""
    w = ordered(keys, t)

    def mean(lo, hi):
        f = w.rowsBetween(lo, hi)
        return F.when(F.count(x).over(f) == hi - lo + 1, F.avg(x).over(f))

    df = df.withColumns({"last5": mean(-4, 0), "previous5": mean(-9, -5), "last20": mean(-19, 0)})
    return df.withColumn("falling", (F.col("last5") < F.col("previous5")) & (F.col("last5") < F.col("last20")))


def run_length(df: DataFrame, keys, t: str, cond: str, out: str = "run") -> DataFrame:
    """How many rows in a row, up to this one, satisfied the condition (null counts as no)."""
    w = ordered(keys, t)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    met = F.coalesce(F.col(cond), F.lit(False))
    df = df.withColumn("__i", F.row_number().over(w))
    last_miss = F.coalesce(F.max(F.when(~met, F.col("__i"))).over(run), F.lit(0))
    return df.withColumn(out, F.col("__i") - last_miss).drop("__i")


def labour_trigger(df: DataFrame, keys, t: str, payroll: str, unemployment: str) -> DataFrame:
    """Mean of three payroll changes below 0 and the 3-month unemployment mean at least
    0.5 above the lowest of the twelve 3-month means before it."""
    w = ordered(keys, t)
    df = df.withColumn("__d", F.col(payroll) - F.lag(payroll).over(w))
    df = df.withColumns({
        "payroll_3m": full_window("mean", "__d", 3, keys, t),
        "unemployment_3m": full_window("mean", unemployment, 3, keys, t),
    })
    df = df.withColumn("gap", F.col("unemployment_3m") - full_window("min", "unemployment_3m", 12, keys, t, prior=True))
    hit = (F.col("payroll_3m") < 0) & (F.col("gap") >= 0.5 - 1e-9)
    return df.withColumn("triggered", F.coalesce(hit, F.lit(False))).drop("__d")


def attention_z(df: DataFrame, keys, day: str, n: str, days: int = 90) -> DataFrame:
    """z-score of a daily count against the earlier `days` calendar days of its category.

    Days without messages count as zero, which is why sums are divided by `days`.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1)
    df = df.withColumns({"__s": F.sum(n).over(w), "__q": F.sum(F.col(n) * F.col(n)).over(w)})
    s, q = F.coalesce(F.col("__s"), F.lit(0)), F.coalesce(F.col("__q"), F.lit(0))
    mean = s / days
    var = (q - s * s / days) / (days - 1)
    return df.withColumns({
        "mean_before": mean,
        "z": F.when(var > 1e-12, (F.col(n) - mean) / F.sqrt(var)),
    }).drop("__s", "__q")


def rebase(df: DataFrame, keys, t: str, x: str, out: str = "rebased", level: float = 100.0) -> DataFrame:
    w = ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.col(x) / F.first(x).over(w) * level)
