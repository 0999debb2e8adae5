import datetime as dt

import numpy as np
import pytest

from tidemark.operators.machines import states_by_jumps, next_below, visited

K = ["series_id"]


def step_by_step(price, entry, leave, stop, cooldown):
    """The machine as a plain loop over one series."""
    states, on, peak, free = [], False, None, 0
    for i, p in enumerate(price):
        if on:
            peak = p if peak is None else peak if p is None else max(peak, p)
            if leave[i] or (p is not None and peak is not None and p < peak * (1 - stop)):
                on, free = False, i + max(1, cooldown)
        elif entry[i] and i >= free:
            on, peak = True, p
        states.append(float(on))
    return states


def table(spark, series):
    """series: {id: (price, entry, leave)}, in many partitions and no order."""
    day0 = dt.date(2020, 1, 1)
    rows = [(s, day0 + dt.timedelta(days=i), p, e, l) for s, cols in series.items() for i, (p, e, l) in enumerate(zip(*cols))]
    df = spark.createDataFrame(rows, "series_id string, date date, close double, entry boolean, leave boolean")
    return df.repartition(7, "date")


MACHINES = [dict(spec_id=3, entry="entry", leave="leave", stop=0.03, cooldown=4), dict(spec_id=5, entry="entry", leave="leave", stop=0.01, cooldown=0),
            dict(spec_id=7, entry="entry", leave="leave", stop=0.5, cooldown=1)]


def states_of(spark, series, machines=MACHINES):
    out = states_by_jumps(table(spark, series), K, "date", "close", machines)
    assert out.columns == ["series_id", "date", "spec_id", "state"]
    got = {}
    for r in out.orderBy("date").collect():
        got.setdefault((r.series_id, r.spec_id), []).append(r.state)
    return got


def test_states_equal_a_plain_loop(spark, path_of_prices):
    rng = np.random.default_rng(11)
    series = {}
    for k, (enters, leaves) in enumerate([(0.3, 0.02), (0.02, 0.2), (0.9, 0.0), (0.5, 0.5), (0.0, 0.1), (1.0, 1.0)]):
        n = 300 + 61 * k
        price = [float(p) for p in path_of_prices(n, 20 + k)]
        series[f"s{k}"] = (price, [bool(x) for x in rng.random(n) < enters], [bool(x) for x in rng.random(n) < leaves])
    got = states_of(spark, series)
    for s, (p, e, l) in series.items():
        for m in MACHINES:
            assert got[s, m["spec_id"]] == step_by_step(p, e, l, m["stop"], m["cooldown"]), (s, m)
    assert sum(map(sum, got.values())) > 0


def test_long_chains_of_short_episodes(spark):
    # on and off all the time, so the path has hundreds of nodes
    n = 801
    series = {"a": ([100.0, 90.0, 95.0] * (n // 3), [True] * n, [False] * n)}
    got = states_of(spark, series)
    for m in MACHINES:
        assert got["a", m["spec_id"]] == step_by_step(*series["a"], m["stop"], m["cooldown"])


def test_null_prices_flags_and_keys(spark):
    price = [None, 100.0, None, 104.0, 100.5, None, 99.0, 103.0, float("nan"), 50.0]
    entry = [True, None, False, None, True, True, False, True, True, None]
    leave = [None, False, None, False, None, False, False, None, False, True]
    plain = ([None if p != p else p for p in price], [bool(e) for e in entry], [bool(x) for x in leave])
    got = states_of(spark, {None: (price, entry, leave), "one": ([5.0], [True], [True])})
    for m in MACHINES:
        assert got[None, m["spec_id"]] == step_by_step(*plain, m["stop"], m["cooldown"])
        assert got["one", m["spec_id"]] == [1.0]


def test_no_rows(spark):
    empty = table(spark, {"a": ([1.0], [True], [False])}).where("false")
    assert states_by_jumps(empty, K, "date", "close", MACHINES, carry=["close"]).collect() == []


def test_no_python_on_the_executors(spark):
    df = states_by_jumps(table(spark, {"a": ([1.0, 2.0], [True, True], [False, False])}), K, "date", "close", MACHINES)
    plan = df._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_next_below_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for key in ("a", "b", None):
        n = int(rng.integers(1, 90))
        # few distinct values, so that many are equal; numbers with gaps
        at = np.cumsum(rng.integers(1, 3, n))
        rows += [(key, int(i), float(v), float(v) - float(rng.integers(0, 3))) for i, v in zip(at, rng.integers(0, 12, n))]
    rows.append(("nulls", 0, None, None))
    df = spark.createDataFrame(rows, "k string, i long, v double, l double").repartition(5)
    got = {(r.k, r.i): r.below for r in next_below(df, ["k"], "i", "v", "l").collect()}
    want = {}
    for k, i, _, limit in rows:
        later = [j for kk, j, v, _ in rows if kk == k and j > i and v is not None and limit is not None and v < limit]
        if later:
            want[k, i] = min(later)
    assert got == want


def test_visited_follows_each_path(spark):
    nodes = [("a", i, i + 3 if i < 98 else None, i == 1) for i in range(100)] + [("b", 0, 5, False), ("b", 5, None, False), ("c", 2, 7, True), ("c", 7, 9, None)]
    df = spark.createDataFrame(nodes, "k string, node long, next long, start boolean")
    got = {(r.k, r.node) for r in visited(df, ["k"], "node", "next", "start").collect()}
    assert got == {("a", i) for i in range(1, 100, 3)} | {("c", 2), ("c", 7)}
