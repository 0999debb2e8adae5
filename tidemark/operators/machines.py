"""Entry/exit machines without stepping through the rows.

A machine enters at the first row that lets it in, and leaves at the first later row that asks it to or whose price is
below (1 - stop) of the highest price since its entry. That exit depends on the entry row alone, and the next entry on
the exit alone. So exits are computed for all entry rows at once, exits become nodes that point to the next exit, and the
nodes that a machine really visits are found by pointer jumping: each round doubles the length of every pointer.

`signals.fold_states` gives the same states and is about three times as fast on daily bars (README), but holds
a whole series in the memory of one Python task. Here sorts of a series spill, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ordered
from tidemark.session import materialise

# doublings of the pointers between two written tables
DOUBLINGS = 3


def _matched(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join on {left column: right column}, null equal to null; right's own join columns are dropped."""
    names = {r: f"__on_{k}" for k, r in enumerate(on.values())}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for l, r in on.items():
        same &= F.col(l).eqNullSafe(F.col(names[r]))
    return left.join(right, same, "left").drop(*names.values())


def next_below(df: DataFrame, keys: Sequence[str], i: str, value: str, limit: str | Column, out: str = "below") -> DataFrame:
    """(keys, i, out): the number of the first later row of the key whose value is less than this row's limit.

    i numbers rows from 0, gaps allowed; rows without a later one below are left out, and so are null values and limits.
    Two rows meet once: at the highest bit in which their numbers differ, where the earlier lies in the left half of a
    block and the later in the right. One sort of each block by value, with the limits of its left half among the values
    of its right half, answers all its questions. So each row is sorted once per bit, and no pairs are formed.
    """
    keys = list(keys)
    limit = F.col(limit) if isinstance(limit, str) else limit
    span = Window.partitionBy(*keys)
    bits = F.length(F.bin(F.max(i).over(span)))
    rows = df.select(*keys, F.col(i).cast("long").alias("__n"), F.col(value).cast("double").alias("__v"), limit.cast("double").alias("__l"), bits.alias("__bits"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("__bits") - 1)).alias("__bit"))
    right = F.expr("shiftright(__n, __bit) % 2 = 1")
    rows = rows.select(*keys, "__n", "__bit", F.expr("shiftright(__n, __bit + 1)").alias("__block"), right.alias("__right"),
                       F.when(right, F.col("__v")).otherwise(F.col("__l")).alias("__at")).where("__at IS NOT NULL")
    # at equal prices limits come first: only what is less counts
    w = Window.partitionBy(*keys, "__bit", "__block").orderBy("__at", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn(out, F.min(F.when(F.col("__right"), F.col("__n"))).over(w)).where(~F.col("__right") & F.col(out).isNotNull())
    return found.groupBy(*keys, F.col("__n").alias(i)).agg(F.min(out).alias(out))


def visited(nodes: DataFrame, keys: Sequence[str], node: str, successor: str, start: str) -> DataFrame:
    """The rows of nodes that are reached from a row with `start` by following `successor` (a node number of the same key).

    Successors must lie after their node, so that paths end. Rounds grow with the logarithm of the longest path.
    """
    keys = list(keys)
    pair = [*keys, node]
    nodes = materialise(nodes)
    paths = nodes.select(*pair, F.col(successor).alias("__jump"), F.coalesce(F.col(start), F.lit(False)).alias("__seen"), F.coalesce(F.col(start), F.lit(False)).alias("__start"))
    while True:
        for _ in range(DOUBLINGS):
            ahead = paths.select(*pair, F.col("__jump").alias("__far"))
            met = _matched(paths, ahead, {**{k: k for k in keys}, "__jump": node})
            own = F.struct(F.col(node).alias(node), F.col("__far").alias("__jump"), F.col("__seen").alias("__seen"), F.col("__start").alias("__start"))
            there = F.struct(F.col("__jump").alias(node), F.lit(None).cast(paths.schema["__jump"].dataType).alias("__jump"), F.lit(True).alias("__seen"), F.lit(False).alias("__start"))
            sent = F.when(F.col("__seen") & F.col("__jump").isNotNull(), F.array(own, there)).otherwise(F.array(own))
            paths = met.select(*keys, F.inline(sent)).groupBy(*pair).agg(F.max("__jump").alias("__jump"), F.max("__seen").alias("__seen"), F.max("__start").alias("__start"))
        paths = materialise(paths)
        if paths.where("__start AND __jump IS NOT NULL").isEmpty():
            seen = paths.where("__seen").select(*pair, F.lit(True).alias("__hit"))
            return _matched(nodes, seen, {k: k for k in pair}).where("__hit").drop("__hit")


def states_by_jumps(df: DataFrame, keys, t: str, price: str, machines: Sequence[dict], carry: Sequence[str] = ()) -> DataFrame:
    """Daily state per machine: dict(spec_id, entry, leave, stop, cooldown), entry and leave
    naming boolean columns of df (null is false). Returns (keys, t, carry.., spec_id, state).

    A machine may enter again `cooldown` rows after its exit, at the earliest on the next row. Rows without a price
    neither raise the highest price nor meet the stop. Flags are written once: the stretches read them twice.
    """
    kept, machine = [*keys, t, *carry], [*keys, "spec_id"]
    no, i = F.lit(False), F.col("__i")
    each = F.array(*[
        F.struct(F.lit(int(m["spec_id"])).cast("int").alias("spec_id"), F.lit(float(m["stop"])).alias("__stop"), F.lit(max(1, int(m["cooldown"]))).alias("__wait"),
                 F.coalesce(F.col(m["entry"]), no).alias("__entry"), F.coalesce(F.col(m["leave"]), no).alias("__leave")) for m in machines])
    p = F.col(price).cast("double")
    rows = df.select(*kept, F.when(~F.isnan(p), p).alias("__p"), F.row_number().over(ordered(keys, t)).alias("__i"), each.alias("__each"))
    rows = materialise(rows.select(*kept, "__p", "__i", F.inline("__each")))

    # stretches that begin with a row which no machine survives; an entry lasts to the end of its stretch at most
    low = F.col("__p") * (1 - F.col("__stop"))
    so_far = Window.partitionBy(*machine).orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("__leave") | F.coalesce(F.col("__p") < low, no)
    rows = rows.withColumn("__stretch", F.sum(ends.cast("int")).over(so_far))
    stretch = Window.partitionBy(*machine, "__stretch")
    rows = rows.withColumns({"__first": F.min(F.when(F.col("__entry"), i)).over(stretch), "__end": F.max("__i").over(stretch) + 1})

    # the stop of an entry is met where the first price falls below its limit, of all prices from the entry on
    held = rows.where("__i >= __first AND __end > __first + 1").withColumn("__n", i - F.col("__first"))
    falls = next_below(held, [*machine, "__stretch", "__first"], "__n", "__p", low, "__fall")
    falls = falls.select(*machine, (F.col("__first") + F.col("__n")).alias("__i"), (F.col("__first") + F.col("__fall")).alias("__fall"))
    rows = _matched(rows, falls, {k: k for k in [*machine, "__i"]})
    later = stretch.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__exit", F.least(F.col("__end").cast("long"), F.min("__fall").over(later)))
    from_end = Window.partitionBy(*machine).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coming = F.when(F.col("__entry"), F.struct(i.cast("long").alias("enter"), F.col("__exit").alias("exit")))
    rows = rows.withColumn("__coming", F.last(coming, ignorenulls=True).over(from_end))
    rows = materialise(rows.select(*kept, "spec_id", "__i", "__wait", "__entry", "__exit", "__coming"))

    # node 0 stands before the first row
    exits = rows.where("__entry").select(*machine, F.col("__exit").alias("__node"), (F.col("__exit") + F.col("__wait")).alias("__at")).distinct()
    starts = rows.where("__i = 1").select(*machine, F.lit(0).cast("long").alias("__node"), F.lit(1).cast("long").alias("__at"))
    there = rows.select(*machine, i.cast("long").alias("__i"), "__coming.enter", "__coming.exit")
    nodes = _matched(starts.unionByName(exits), there, {**{k: k for k in machine}, "__at": "__i"})
    nodes = nodes.withColumn("__start", F.col("__node") == 0)
    episodes = visited(nodes, machine, "__node", "exit", "__start").where("enter IS NOT NULL")
    turns = F.array(F.struct(F.col("enter").alias("__at"), F.lit(1.0).alias("__turn")), F.struct(F.col("exit").alias("__at"), F.lit(0.0).alias("__turn")))
    turns = episodes.select(*machine, F.inline(turns))
    rows = _matched(rows, turns, {**{k: k for k in machine}, "__i": "__at"})
    return rows.select(*kept, "spec_id", F.coalesce(F.last("__turn", ignorenulls=True).over(so_far), F.lit(0.0)).alias("state"))
