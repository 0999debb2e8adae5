"""Mixing sources to target weights by entropy balancing.

Every source has a token constraint. Among all document rates in [0, most] that meet it, the ones
nearest to 1 in relative entropy are r = min(most, exp(l * size / mean size)); l solves the convex
dual of the source. Rates depend on source and size alone, so the Newton iterations run on counts
of (source, size), as Spark aggregates, for all sources at once. Rates are then rounded
into copies by systematic sampling along (source, size), which keeps each source's tokens within
about one document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST = 2
MICRO = 1_000_000
#: Documents of one source and size that are ranked together.
GROUP = 500
TOLERANCE = 1e-9
ROUNDS = 60


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def counts_of(sized: DataFrame) -> DataFrame:
    """(__source, __size, __docs), summed before the shuffle."""
    return sized.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__docs"))


def targets(counts: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(__source, __total, __mean, __target): one row per source.

    Sources in code point order, null last, weigh `weights`, repeated. They share `share` of all tokens by
    weight; what exceeds `most` times a source's tokens is shared again among the others. With the sources
    in order of capacity over weight, the full ones come first, so one running sum finds them.
    """
    whole = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(whole) - 1) % len(weights) + 1)
    total = F.sum(F.col("__size") * F.col("__docs"))
    each = counts.groupBy("__source").agg(total.alias("__total"), F.sum("__docs").alias("__n")).withColumn("__weight", weight)
    each = each.withColumn("__cap", F.lit(float(most)) * F.col("__total"))
    order = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.lit(float(share)) * F.sum("__total").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    rest = F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    each = each.withColumn("__level", left / rest).withColumn("__full", F.col("__cap") / F.col("__weight") <= F.col("__level"))
    level = F.max(F.when(~F.col("__full"), F.struct(-F.col("__cap") / F.col("__weight"), F.col("__level").alias("level")))).over(every)["level"]
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__weight") * level))
    return each.select("__source", F.col("__total"), (F.col("__total") / F.col("__n")).alias("__mean"), "__cap", target.alias("__target"))


def solve(counts: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """(__source, __tilt): the dual variable of each source; null where the source is at its cap or has no tokens.

    Newton steps on all sources at once, one aggregate each; a step outside the bracket that earlier steps left
    is replaced by its middle, so every source converges. The state, a row per source, is written in each round.
    """
    open_ = F.col("__target") < F.col("__cap") * (1 - 1e-9)
    state = written(sources.where(open_ & (F.col("__total") > 0)).select("__source", "__mean", "__target", F.lit(0.0).alias("__tilt"), F.lit(-1e6).alias("__low"), F.lit(1e6).alias("__high")), "state")
    for _ in range(ROUNDS):
        s = state.alias("s")
        x = F.col("__size") / F.col("s.__mean")
        raw = F.exp(F.least(F.col("s.__tilt") * x, F.lit(700.0)))
        tokens = F.col("__docs") * F.col("__size")
        both = counts.alias("c").join(s, F.col("c.__source").eqNullSafe(F.col("s.__source")))
        sums = both.groupBy(F.col("s.__source").alias("__source"), "s.__mean", "s.__target", "s.__tilt", "s.__low", "s.__high").agg(
            F.sum(tokens * F.least(raw, F.lit(float(most)))).alias("__got"), F.sum(F.when(raw < most, tokens * x * raw).otherwise(0.0)).alias("__slope"))
        gap = F.col("__got") - F.col("__target")
        low, high = F.when(gap < 0, F.col("__tilt")).otherwise(F.col("__low")), F.when(gap > 0, F.col("__tilt")).otherwise(F.col("__high"))
        step = F.col("__tilt") - gap / F.when(F.col("__slope") > 0, F.col("__slope"))
        done = F.abs(gap) <= TOLERANCE * F.col("__target")
        sums = sums.withColumns({"__low": low, "__high": high, "__step": step, "__done": done})
        inside = (F.col("__step") > F.col("__low")) & (F.col("__step") < F.col("__high"))
        tilt = F.when(F.col("__done"), F.col("__tilt")).when(inside, F.col("__step")).otherwise((F.col("__low") + F.col("__high")) / 2)
        state = written(sums.select("__source", "__mean", "__target", tilt.alias("__tilt"), "__low", "__high", "__done"), "state")
        if state.where(~F.col("__done")).isEmpty():
            break
    return state.select("__source", F.round("__tilt", 9).alias("__tilt"))


def rates(counts: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(__source, __size, __docs, __total, __target, __micro, __phase): the rate of each (source, size) in millionths,
    and the place on the source's sampling axis where its documents begin, modulo one copy. Whole numbers, so reruns agree."""
    sources = written(targets(counts, share, weights, most), "targets")
    tilts = solve(counts, sources, most)
    joined = counts.join(sources.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
    joined = joined.join(tilts.withColumnRenamed("__source", "__t"), F.col("__source").eqNullSafe(F.col("__t")), "left")
    rate = F.when(F.col("__size") == 0, 1.0).when(F.col("__tilt").isNull(), float(most)).otherwise(F.least(F.exp(F.col("__tilt") * F.col("__size") / F.col("__mean")), F.lit(float(most))))
    joined = joined.withColumn("__micro", F.round(rate * MICRO).cast("long"))
    # one row per distinct size: as many as the longest document has words, however many documents there are
    before = Window.partitionBy("__source").orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.pmod(F.col("__docs") * F.col("__micro"), F.lit(MICRO))
    return joined.withColumn("__phase", F.pmod(F.coalesce(F.sum(part).over(before), F.lit(0)), F.lit(MICRO))).select("__source", "__size", "__docs", "__total", "__target", "__micro", "__phase")


def with_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs with __size, __total, __target and __copies, the number of times the mix takes the row (0 to `most`).

    Null and empty texts have size 0 and are taken once. Null sources are one source. Rows that repeat an id
    are documents of their own. An empty table gives an empty result. Other columns pass through.
    """
    row = F.xxhash64(F.col(id_column), F.col(text))
    sized = docs.withColumns({"__source": F.col(source), "__size": word_count(F.col(text)), "__row": row})
    counts = written(counts_of(sized), "sizes")
    plan = rates(counts, share, weights, most).withColumnsRenamed({"__source": "__s", "__size": "__z"})
    joined = sized.join(plan, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))).drop("__s", "__z")
    # copies of one text share source and size: such a group is ranked in parts
    parts = F.ceil(F.col("__docs") / GROUP).cast("long")
    joined = joined.withColumn("__part", F.pmod(F.col("__row"), parts))
    place = F.row_number().over(Window.partitionBy("__source", "__size", "__part").orderBy("__row", id_column)).cast("long")
    begin = F.pmod(F.col("__phase") + F.col("__part") * 618_034, F.lit(MICRO))
    joined = joined.withColumns({"__place": place, "__begin": begin})
    upto = lambda j: F.expr(f"({'__begin'} + {j} * __micro) div {MICRO}")
    return joined.withColumn("__copies", upto("__place") - upto("(__place - 1)")).drop("__source", "__row", "__docs", "__part", "__place", "__begin", "__micro", "__phase")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as many times as its copies say, with the columns of docs."""
    mixed = with_copies(docs, **options).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
