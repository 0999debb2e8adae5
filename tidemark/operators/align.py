"""Calendar alignment, as-of joins and keyed merges.

No as-of join here compares pairs of rows: both sides are stacked, ordered once per key and
the last seen right-hand value is carried forward, so the work is one sort. For sub-daily
data pass `spread` (see scan.ranged) so that a hot key is cut into ranges of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import literal_rows, ordered
from tidemark.operators.scan import ranged, running


def align_exact_ffill(left: DataFrame, right: DataFrame, keys, t: str, cols: Sequence[str], on: Sequence[str] | None = None) -> DataFrame:
    """Match on equal time, then carry forward along the left calendar only.

    Right rows on times the left side lacks are ignored, unlike in `asof_join`. `on` is
    keys and time unless all series share one source, then just the time.
    """
    on = list(on or [*keys, t])
    out = left.join(right.select(*on, *cols), on, "left")
    if not keys:
        # one calendar: an explicit constant key, at most one row per day
        out = out.withColumn("__one", F.lit(1))
    return running(out, keys or ["__one"], [t], {c: ("last", c) for c in cols}).drop("__one")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    cols: Sequence[str],
    strict: bool = False,
    default=None,
    match_time: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """Latest right row at or before (strict: before) each left time.

    `cols` come from the newest right row as a whole, nulls included. `match_time` names an
    extra column with the time of that row.
    """
    passing = [c for c in left.columns if c not in keys and c != t]
    side_of_left = 0 if strict else 1
    lhs = left.select(
        *keys, t, F.lit(side_of_left).alias("__side"),
        F.struct(F.lit(True).alias("__is_left"), *passing).alias("__left"),
    )
    rhs = right.select(
        *keys, t, F.lit(1 - side_of_left).alias("__side"),
        F.struct(F.col(t).alias("__at"), *[F.col(c) for c in cols]).alias("__right"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    both = ranged(both, keys, [t, "__side"]) if spread else both
    both = running(both, keys, [t, "__side"], {"__seen": ("last", "__right")})
    out = both.filter(F.col("__left").isNotNull())
    taken = []
    for c in cols:
        value = F.col(f"__seen.{c}")
        taken.append((value if default is None else F.coalesce(value, F.lit(default))).alias(c))
    if match_time:
        taken.append(F.col("__seen.__at").alias(match_time))
    return out.select(*keys, t, *[F.col(f"__left.{c}").alias(c) for c in passing], *taken)


def calendar_flag(left: DataFrame, calendar: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """True where the left key occurs in the other calendar."""
    marks = calendar.select(*on).distinct().withColumn(out, F.lit(True))
    return left.join(marks, list(on), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def exclude(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def to_phases(df: DataFrame, phases, t: str, label: str = "phase") -> DataFrame:
    """One copy of each row per named phase [start, end] it falls in.

    Phases are a short parameter list: rows meet a constant array and are filtered in the
    same generated code, without a join.
    """
    rows = F.array(*[
        F.struct(F.lit(a).alias(label), F.lit(b).cast("date").alias("phase_start"), F.lit(c).cast("date").alias("phase_end"))
        for a, b, c in phases
    ])
    out = df.select("*", F.inline(rows))
    return out.filter((F.col(t) >= F.col("phase_start")) & (F.col(t) <= F.col("phase_end")))


def expected_sessions(calendar: DataFrame, observed: DataFrame, keys, t: str) -> DataFrame:
    """The calendar's rows for each series, in the months in which the series has observations."""
    active = observed.select(*keys, F.trunc(t, "MM").alias("__month")).distinct()
    return calendar.withColumn("__month", F.trunc(t, "MM")).join(active, "__month").drop("__month")


#: Days of the finest bins of `interval_join`; each further level has bins four times as long.
BIN_DAYS = 8


def interval_join(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, on: Sequence[str] = ()) -> DataFrame:
    """All pairs of a point and an interval [start, end] of dates that holds it, with all columns of both (`on`: equal columns, once).

    An interval goes to the level whose bins are at least as long as itself, so it lies in two bins at most, however long it is; a point is looked
    up once per level in use (20 levels cover all dates). Pairs meet by an equi-join on level and bin and are then compared
    exactly. Nulls and intervals that end before they start match nothing.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    size = F.lit(BIN_DAYS) * F.pow(F.lit(4), F.col("__level"))
    bin_of = lambda c: F.floor(number(c) / size)
    days = number(end) - number(start) + 1
    level = F.greatest(F.ceil(F.log(4.0, days / BIN_DAYS) - 1e-9), F.lit(0)).cast("int")
    cut = intervals.where(F.col(start) <= F.col(end)).withColumn("__level", level)
    used = sorted(r["__level"] for r in cut.select("__level").distinct().collect())
    cut = cut.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    looked = points.withColumn("__level", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))).withColumn("__bin", bin_of(t))
    both = looked.join(cut, [*on, "__level", "__bin"])
    return both.where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("__level", "__bin")


def with_specs(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Every row once per parameter set; the grid is a literal array, so nothing is joined."""
    return df.withColumn("__s", F.explode(literal_rows(specs))).select(*df.columns, "__s.*")


def asof_shared(left: DataFrame, right: DataFrame, t: str, cols, **how) -> DataFrame:
    """As-of join against one source that all left series share.

    The match depends on the date alone, so it is found once per distinct left date (a
    calendar, however many series there are) and joined back by equality.
    """
    days = left.select(t).distinct().withColumn("__one", F.lit(1))
    matched = asof_join(days, right.withColumn("__one", F.lit(1)), ["__one"], t, cols, **how)
    return left.join(matched.drop("__one"), t)


def lagged_features(left: DataFrame, features: dict[str, DataFrame], t: str, value: str, lag_obs: int = 1) -> DataFrame:
    """As-of join of several shared sources, each delayed by whole observations of its own
    calendar. A missing value in a source leaves the latest known one in place."""
    days = left.select(t).distinct().withColumn("__one", F.lit(1))
    for name, source in features.items():
        s = source.withColumn("__one", F.lit(1))
        s = s.withColumn(name, F.lag(value, lag_obs).over(ordered(["__one"], t))).filter(F.col(name).isNotNull())
        days = asof_join(days, s, ["__one"], t, [name])
    return left.join(days.drop("__one"), t)


def asof_release(df: DataFrame, reports: DataFrame, keys, t: str, release: str, cols, blackouts=()) -> DataFrame:
    """A report counts from its release day on; inside a blackout no report is visible.

    Without keys all series share the reports.
    """
    usable = reports.withColumnRenamed(release, t)
    out = asof_join(df, usable, keys, t, cols, match_time="released") if keys else asof_shared(df, usable, t, cols, match_time="released")
    hidden = F.lit(False)
    for a, b in blackouts:
        hidden = hidden | ((F.col(t) >= F.lit(a).cast("date")) & (F.col(t) <= F.lit(b).cast("date")))
    return out.withColumns({c: F.when(~hidden, F.col(c)) for c in [*cols, "released"]})


def common_cutoff(frames: Sequence[DataFrame], t: str) -> Column:
    """The earliest of the last dates, as a scalar subquery each scan can push down."""
    lasts = [f.agg(F.max(t).alias("d")) for f in frames]
    stacked = lasts[0]
    for x in lasts[1:]:
        stacked = stacked.unionByName(x)
    return stacked.agg(F.min("d")).scalar()


# merges


def newest_per_key(df: DataFrame, keys: Sequence[str], priority: Sequence) -> DataFrame:
    """One row per key, the one with the highest priority.

    An aggregate instead of a ranking window: losers are dropped before the shuffle, so a
    key with many versions costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*priority))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def merge_precedence(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Union in which later sources win per key; a null never replaces a value."""
    stacked = None
    for rank, s in enumerate(sources):
        s = s.select(*keys, value, F.lit(rank).alias("__rank"))
        stacked = s if stacked is None else stacked.unionByName(s)
    seen = F.when(F.col(value).isNotNull(), F.col("__rank"))
    return stacked.groupBy(*keys).agg(F.max_by(value, seen).alias(value))


def append_after(frozen: DataFrame, new: DataFrame, t: str) -> DataFrame:
    """Frozen rows plus the new rows strictly later than the newest frozen one."""
    cutoff = frozen.agg(F.max(t)).scalar()
    return frozen.unionByName(new.filter(F.col(t) > cutoff).select(*frozen.columns))


def upsert(archive: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """New rows replace archived rows of the same id, nothing is deleted.

    Within one batch the highest version wins.
    """
    both = archive.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    return newest_per_key(both, [key], ["__gen", version]).drop("__gen")


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position where each occurred first."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))


def two_way_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) only in a or only in b, from one grouped pass."""
    cols = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.select(*cols).withColumn("__n", F.lit(-1)))
    net = both.groupBy(*cols).agg(F.sum("__n").alias("copies")).filter(F.col("copies") != 0)
    return net.withColumn("side", F.when(F.col("copies") > 0, "first").otherwise("second")).withColumn("copies", F.abs("copies"))


def dense_rank_all(df: DataFrame, group: Sequence[str], score: str, out: str = "place", spread: bool = False) -> DataFrame:
    """Dense rank of every row by falling score.

    Only the distinct scores are ordered; with `spread` in ranges, so that even one huge group is
    scanned by many tasks.
    """
    levels = df.select(*group, score).distinct().withColumns({"__low": -F.col(score), "__one": F.lit(1)})
    levels = ranged(levels, group, ["__low"]) if spread else levels
    ranked = running(levels, group, ["__low"], {out: ("sum", "__one")}).select(*group, score, F.col(out).cast("int").alias(out))
    return df.join(ranked, [*group, score])


def top_ranked(df: DataFrame, group: Sequence[str], score: str, k: int, out: str = "place", buckets: int = 64) -> DataFrame:
    """Rows whose rank by falling score is at most k in their group; ties share a rank and all stay. Null scores are not ranked.

    Rows are counted per distinct score, and each bucket of scores sends its k best ones on, so a group of any size orders at most
    k * buckets rows in one task.
    """
    levels = df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("__rows"))
    levels = levels.withColumn("__bucket", F.pmod(F.xxhash64(score), F.lit(buckets)))
    inner = Window.partitionBy(*group, "__bucket").orderBy(F.desc(score))
    best = levels.withColumn("__rn", F.row_number().over(inner)).where(F.col("__rn") <= k)
    # summed up again, so that the bucketed half stays a shuffle of its own
    best = best.groupBy(*group, score).agg(F.sum("__rows").alias("__rows"))
    above = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    places = best.select(*group, score, (F.coalesce(F.sum("__rows").over(above), F.lit(0)) + 1).cast("int").alias(out)).where(F.col(out) <= k)
    return df.join(places, [*group, score])


def first_in_group(df: DataFrame, group: Sequence[str], *order) -> DataFrame:
    """Best row per group by the given order, e.g. score descending then id."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
