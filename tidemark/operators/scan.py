"""Ordered running aggregates that survive hot keys.

A plain `Window.partitionBy(key)` puts a whole key into one task. That is fine at daily
grain (one row per series and date, so a century is 36,525 rows) but not for trades, ticks
or messages, where a single key may hold a third of the table. There, `ranged` finds the
keys that own more than one shuffle partition's share of the rows and numbers ranges of their
order; `running` then scans inside (keys, range) and adds what earlier ranges of the key sum
up to. A hot key spans as many ranges as it needs, all others have none. The number is a column
like any other: nothing is shuffled for it, and one shuffle by (keys, range) serves all scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

PART = "__part"
#: Rows that one task takes anyway: no key with fewer is cut.
LEAST = 1000
#: Sampled rows per range, from which its ends are taken.
SAMPLED = 100

# how an earlier carry joins a later value
_COMBINE = {
    "sum": lambda carry, own: F.coalesce(carry + own, own, carry),
    "min": lambda carry, own: F.least(carry, own),
    "max": lambda carry, own: F.greatest(carry, own),
    "last": lambda carry, own: F.coalesce(own, carry),
}


def _apply(fn: str, c) -> Column:
    if fn == "last":
        return F.last(c, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[fn](c)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """df with PART, the number of the row's range within its key; null where the key is not cut, no column where none is.

    A key is cut when it has more rows than `LEAST` and than an even share of a shuffle partition. The ends of its ranges come from a
    sample and are written, so that all plans see the same ones. Rows of equal (keys, order) share a range. Numbers rise along the
    order, nulls first. df is read up to three times (rows, rows per key, sample of hot keys), so it should be cheap or written.
    """
    spark = df.sparkSession
    share = max(LEAST, df.count() // int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot = materialise(rows.where(F.col("__rows") > share).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__rows"))
    if hot.isEmpty():
        return df
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    at = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    sample = df.sample(min(1.0, SAMPLED / share), seed=1).withColumn("__at", at).join(F.broadcast(hot), same)
    own = sample.groupBy(*hot.columns).agg(F.sort_array(F.collect_list("__at")).alias("__s"))
    pieces = F.ceil(F.col("__rows") / share).cast("int")
    ends = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("__s", F.floor(i * F.size("__s") / pieces).cast("int")))
    own = own.select(*[c for c in hot.columns if c != "__rows"], F.array_distinct(ends).alias("__e"))
    # ends in groups of about the root of their number, so that a row is compared with few of them
    width = F.ceil(F.sqrt(F.size("__e"))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("__e") - 1) / width).cast("int")), lambda j: F.slice("__e", j * width + 1, width))
    own = materialise(own.select("*", width.alias("__w"), groups.alias("__g")).drop("__e"))
    out = df.withColumn("__at", at).join(F.broadcast(own), same, "left")
    group = F.size(F.filter("__g", lambda g: g[0] <= F.col("__at"))) - 1
    inside = F.size(F.filter(F.get("__g", group), lambda e: e <= F.col("__at")))
    part = F.when(F.col("__g").isNotNull(), F.when(group < 0, 0).otherwise(group * F.col("__w") + inside))
    return out.withColumn(PART, part).drop("__at", *own.columns)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, aggs: dict[str, tuple[str, str]], reverse: bool = False, chained: bool = False) -> DataFrame:
    """Add `{out: (fn, column)}` inclusive running aggregates; fn is sum, min, max or last.

    `last` is the latest non-null value. With `reverse` the scan runs from the end, so
    `last` becomes "next non-null at or after this row". A df with PART of `ranged` (same keys
    and order) is scanned range by range; any other, key by key. With `chained` the carries of
    ranges are written: a scan of the result would else run this one twice, and so on.
    """
    keys = list(keys)

    def direction(cols):
        cols = [F.col(c) if isinstance(c, str) else c for c in cols]
        return [c.desc() for c in cols] if reverse else [c.asc() for c in cols]

    if PART not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({o: _apply(fn, c).over(w) for o, (fn, c) in aggs.items()})

    w = Window.partitionBy(*keys, PART).orderBy(*direction(order))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"__l_{o}": _apply(fn, c).over(so_far) for o, (fn, c) in aggs.items()})
    # what a range sums up to stands on its last row; keys that are not cut need no carry
    ends = local.where(F.col(PART).isNotNull()).withColumn("__more", F.lead(F.lit(1)).over(w)).where("__more IS NULL")
    totals = ends.select(*keys, PART, *[f"__l_{o}" for o in aggs], F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__ranges"))
    before = Window.partitionBy(*keys).orderBy(*direction([PART])).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.where("__ranges > 1").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(PART).alias("__k_part"),
        *[_apply(fn, f"__l_{o}").over(before).alias(f"__c_{o}") for o, (fn, _) in aggs.items()])
    carry = materialise(carry) if chained else carry
    same = F.col(PART) == F.col("__k_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # one row per range of a hot key
    out = local.join(F.broadcast(carry), same, "left")
    out = out.withColumns({o: _COMBINE[fn](F.col(f"__c_{o}"), F.col(f"__l_{o}")) for o, (fn, _) in aggs.items()})
    return out.drop(*carry.columns, *[f"__l_{o}" for o in aggs])
