"""Cross-asset statistics on aggregated or daily tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import ordered


def pca_shares(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Variance shares and first loadings of the correlation matrix, per key.

    Only sums and cross products leave the aggregation; numpy sees one small matrix per key.
    """
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    df = df.dropna(subset=list(cols))
    moments = df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).filter(F.col("n") > k)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([moments.schema[c] for c in keys]).add("n", "double").add("shares", numbers).add("loadings", numbers)

    def decompose(batches):
        for m in batches:
            cov = np.zeros((len(m), k, k))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = m[f"c{i}_{j}"]
            sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 1e-300))
            values, vectors = np.linalg.eigh(cov / sd[:, :, None] / sd[:, None, :])
            first = vectors[:, :, -1]
            # the sign of a loading vector is arbitrary: make its largest entry positive
            largest = np.take_along_axis(first, np.abs(first).argmax(axis=1)[:, None], axis=1)
            out = m[[*keys, "n"]].copy()
            yield out.assign(shares=list(values[:, ::-1] / values.sum(axis=1, keepdims=True)), loadings=list(first * np.sign(largest)))

    return moments.mapInPandas(decompose, schema)


def conditional_means(df: DataFrame, by: Sequence[str], x: str, condition) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(F.when(condition, F.col(x))).alias("mean_if"), F.avg(F.when(~condition, F.col(x))).alias("mean_else"),
        F.count_if(condition & F.col(x).isNotNull()).alias("rows_if"))


def net_positions(df: DataFrame, keys, t: str, long: str, short: str) -> DataFrame:
    """Long less short per class and its change from the previous report."""
    df = df.withColumn("net", F.col(long) - F.col(short))
    return df.withColumn("net_change", F.col("net") - F.lag("net").over(ordered(keys, t)))


def balance_check(df: DataFrame, t: str, long: str, short: str) -> DataFrame:
    """Total long and short over all classes per report date, and their gap."""
    return df.groupBy(t).agg(F.sum(long).alias("long"), F.sum(short).alias("short")).withColumn("gap", F.col("long") - F.col("short"))


def forward_targets(df: DataFrame, keys, t: str, x: str, horizons: Sequence[int] = (1, 5)) -> DataFrame:
    """Log return and realised risk (root of summed squared returns) over the next h rows."""
    w = ordered(keys, t)
    df = df.withColumn("log_return", F.ln(F.col(x) / F.lag(x).over(w)))
    df = df.withColumn("__q", F.col("log_return") * F.col("log_return"))
    cols = {}
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        cols[f"risk_{h}"] = F.when(F.count("__q").over(ahead) == h, F.sqrt(F.sum("__q").over(ahead)))
    return df.withColumns(cols).drop("__q")


def expanding_eval(df: DataFrame, keys, t: str, x: str, least: int = 60) -> DataFrame:
    """Squared errors of one-step forecasts made only from earlier rows.

    Models for the return of a row: zero, the mean of all earlier returns, and a line on the
    previous return fitted to all earlier pairs.
    """
    w = ordered(keys, t)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("y", F.col(x) / F.lag(x).over(w) - 1)
    df = df.withColumn("z", F.lag("y").over(w))
    df = df.withColumns({
        "__n": F.count("z").over(past), "__mean": F.avg("y").over(past),
        "__slope": F.regr_slope("y", "z").over(past), "__inter": F.regr_intercept("y", "z").over(past),
    })
    df = df.filter((F.col("__n") >= least) & F.col("y").isNotNull())
    sq = lambda f: F.pow(F.col("y") - f, F.lit(2.0))
    line = F.col("__inter") + F.col("__slope") * F.col("z")
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("forecasts"), F.avg(sq(F.lit(0.0))).alias("mse_zero"), F.avg(sq(F.col("__mean"))).alias("mse_mean"), F.avg(sq(line)).alias("mse_line"))
    return out.withColumn("skill_line", 1 - F.col("mse_line") / F.col("mse_mean"))


def lead_lag(df: DataFrame, t: str, a: str, b: str, ks: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Correlation of a with b moved k rows later in time, for each k (negative: b moved earlier)."""
    w = ordered(keys, t)
    df = df.withColumns({f"__b{i}": (F.lag(b, k) if k >= 0 else F.lead(b, -k)).over(w) for i, k in enumerate(ks)})
    out = df.groupBy(*keys).agg(*[F.corr(a, f"__b{i}").alias(f"__c{i}") for i in range(len(ks))])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__c{i}").alias("correlation")) for i, k in enumerate(ks)])
    return out.select(*keys, F.inline(rows))


def draw(salt: str, size, *parts) -> Column:
    """A reproducible number in [0, size) from the hash of its parts."""
    text = F.concat_ws("-", F.lit(salt), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size


def block_bootstrap(df: DataFrame, keys, block, value: str, group: str, reps: int = 200, salt: str = "boot", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean of `value` where `group` is true less where it is false.

    Whole blocks (e.g. months) are drawn with replacement, as many as there are. Blocks are
    reduced to sums first, so replicates cost blocks x reps small rows, not data rows.
    """
    yes = F.col(group)
    sums = df.groupBy(*keys, block.alias("__block")).agg(
        F.sum(F.when(yes, F.col(value))).alias("sa"), F.count_if(yes).alias("na"),
        F.sum(F.when(~yes, F.col(value))).alias("sb"), F.count_if(~yes).alias("nb"))
    order = Window.partitionBy(*keys).orderBy("__block")
    whole = Window.partitionBy(*keys)
    sums = sums.withColumns({"__slot": F.row_number().over(order) - 1, "__size": F.count(F.lit(1)).over(whole)})
    slots = sums.select(*keys, "__slot", "__size", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    picks = slots.select(*keys, "rep", draw(salt, F.col("__size"), *keys, "rep", "__slot").cast("int").alias("__slot"))
    drawn = picks.join(sums.drop("__block", "__size"), [*keys, "__slot"])
    per = drawn.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in ("sa", "na", "sb", "nb")])
    per = per.withColumn("diff", F.try_divide("sa", "na") - F.try_divide("sb", "nb"))
    return per.groupBy(*keys).agg(F.count("diff").alias("reps"), F.avg("diff").alias("mean_diff"), F.percentile("diff", low).alias("low"), F.percentile("diff", high).alias("high"))


def ratio(a: DataFrame, b: DataFrame, on: Sequence[str], x: str) -> DataFrame:
    """Price of one series in units of another, on common dates."""
    both = a.select(*on, F.col(x).alias("__a")).join(b.select(*on, F.col(x).alias("__b")), list(on))
    return both.select(*on, (F.col("__a") / F.col("__b")).alias("ratio"))
