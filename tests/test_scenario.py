"""The scenario prices against rules run over appended bars."""

import datetime as dt

import numpy as np
import pytest

from test_signals import K, RULES, frame
from tidemark.operators import signals as sig

HORIZONS = (1, 5, 10)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r["entry_mode"])
def test_least_price_is_where_the_rule_turns_on(spark, path_of_prices, rule):
    """Just above the answer the rule is on within n bars, at no lower price of a wide grid; also after a fall to a tenth."""
    p = list(path_of_prices(220, 3))
    paths = {f"p{n}": p[:n] for n in (150, 165, 180, 195, 210, 220)} | {"fall": [*p, *[p[-1] / 10] * 3], "short": p[:12]}
    got = {r.series_id: r for r in sig.scenario_sweep(frame(spark, paths), K, "date", "close", rule, horizons=HORIZONS).collect()}
    later, prices = {}, {}
    for s, path in paths.items():
        last = path[-1]
        near = [v * k for n in HORIZONS if (v := got[s][f"within_{n}"]) for k in (1 - 1e-6, 1 + 1e-6)]
        for q in sorted([*near, *(last * np.geomspace(0.1, 20, 25))]):
            name = f"{s}/{len(prices)}"
            later[name], prices[name] = [*path, *[q] * max(HORIZONS)], q
    states = sig.ma_breakout(frame(spark, later), K, "date", "close", [rule]).toPandas().sort_values("date").groupby("series_id").state.apply(list)
    found = 0
    for name, q in prices.items():
        s = name.split("/")[0]
        for n in HORIZONS:
            want = got[s][f"within_{n}"]
            is_on = any(states[name][len(paths[s]):len(paths[s]) + n])
            assert is_on == (want is not None and q > want), (name, n, q, want)
            found += is_on
    assert found
