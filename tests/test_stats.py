import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as evt
from tidemark.operators import indicators as ind
from tidemark.operators import news as nws
from tidemark.operators import stats as sta
from tidemark.operators import sweep as swp

DAY0 = dt.date(2018, 1, 1)


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0.3], [0, 0, 0.5]])
    df = spark.createDataFrame([("m", *map(float, r)) for r in x], "k string, a double, b double, c double")
    out = sta.pca_shares(df, ["k"], ["a", "b", "c"]).first()
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    np.testing.assert_allclose(out["shares"], values[::-1] / 3, rtol=1e-8)
    np.testing.assert_allclose(np.abs(out["loadings"]), np.abs(vectors[:, -1]), rtol=1e-8)


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    rng = np.random.default_rng(2)
    rows = [("a", DAY0 + dt.timedelta(days=i), float(v), bool(g)) for i, (v, g) in enumerate(zip(rng.normal(size=900) + 0.3, rng.random(900) < 0.5))]
    df = spark.createDataFrame(rows, "k string, date date, v double, g boolean")
    one = sta.block_bootstrap(df, ["k"], F.trunc("date", "MM"), "v", "g", reps=100).first()
    two = sta.block_bootstrap(df.repartition(7), ["k"], F.trunc("date", "MM"), "v", "g", reps=100).first()
    assert one["reps"] == 100 and one["low"] < one["mean_diff"] < one["high"]
    assert [one[c] for c in ("low", "high")] == pytest.approx([two[c] for c in ("low", "high")])


def test_ridge_forecast_equals_a_direct_fit(spark):
    rng = np.random.default_rng(3)
    n, window, horizon, alpha = 500, 120, 10, 1.0
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 6)
    rows = [("a", DAY0 + dt.timedelta(days=i), float(c) * (1 + u), float(c) * (1 - u), float(c)) for i, (c, u) in enumerate(zip(close, rng.random(n).tolist()))]
    df = spark.createDataFrame(rows, "series_id string, date date, high double, low double, close double")
    got = swp.ridge_walk_forward(df, ["series_id"], "date", window, horizon, alpha).toPandas().sort_values("date")
    f = swp.ridge_features(df, ["series_id"], "date", horizon).toPandas().sort_values("date").reset_index(drop=True)
    assert len(got) == n
    made = got.dropna(subset=["forecast"])
    assert len(made) > 200 and set(made.train_rows) == {window}
    some = swp.ridge_walk_forward(df, ["series_id"], "date", window, horizon, alpha, least_rows=50).toPandas()
    assert some.forecast.notna().sum() > len(made) and some.train_rows.min() >= 50
    for date in (made.date.iloc[40], made.date.iloc[150], made.date.iloc[-1]):
        first = f.index[(f.date >= date.replace(day=1))][0]
        train = f.iloc[first - horizon - window:first - horizon].dropna(subset=swp.FEATURES + ["label"])
        assert (train.label_end < f.date[first]).all()
        x, y = train[swp.FEATURES].to_numpy(float), train.label.to_numpy(float)
        m, s = x.mean(axis=0), x.std(axis=0)
        z = (x - m) / s
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(8), z.T @ (y - y.mean()))
        row = f[f.date == date][swp.FEATURES].to_numpy(float)[0]
        want = y.mean() + ((row - m) / s) @ beta
        assert got[got.date == date].forecast.iloc[0] == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_analogs_only_use_outcomes_known_before_the_event(spark):
    n = 60
    rng = np.random.default_rng(4)
    bars = spark.createDataFrame([(s, DAY0 + dt.timedelta(days=i), float(v)) for s in "ab" for i, v in enumerate(100 + np.cumsum(rng.normal(size=n)))], "series_id string, date date, close double")
    events = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=d), "x", d) for d in (5, 8, 10, 11, 30)], "series_id string, date date, category string, case_id int")
    r = evt.event_returns(events, bars, ["series_id"], "date", "close", (5,))
    out = {x["case_id"]: x["analogs"] for x in evt.earlier_analogs(r, ["series_id"], "date", "category", 5).collect()}
    # the outcome of day d is known on day d + 5 and may be used strictly later
    assert out == {5: 0, 8: 0, 10: 0, 11: 1, 30: 4}


def test_minimum_and_peak_around_events(spark):
    values = [5, 9, 7, 8, 3, 6, 2, 4]
    bars = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=10 * i), float(v)) for i, v in enumerate(values)], "series_id string, date date, close double")
    events = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=35), 1)], "series_id string, date date, case_id int")
    low = evt.post_event_min(events, bars, ["series_id"], "date", "close", days=20).first()
    assert (low["event_value"], low["min_value"], low["days_to_min"]) == (8.0, 3.0, 5)
    top = evt.pre_event_peak(events, bars, ["series_id"], "date", "close").first()
    assert (top["peak_value"], top["days_since_peak"]) == (9.0, 25)


def test_stories_split_on_silence_and_reprints_count_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0, "a"), ("k", t0 + dt.timedelta(hours=1), "a"), ("k", t0 + dt.timedelta(hours=2), "b"), ("k", t0 + dt.timedelta(hours=20), "a"), ("j", t0, "c")]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, source string")
    out = {(r["key"], r["story"]): (r["articles"], r["sources"]) for r in nws.cluster_events(df, "key", "ts", "source", gap_hours=6).collect()}
    assert out == {("k", 1): (3, 2), ("k", 2): (1, 1), ("j", 1): (1, 1)}


def test_novelty_by_first_use_of_words(spark):
    df = spark.createDataFrame([(1, 10, "Gold up gold"), (2, 5, "gold down"), (3, 20, "up down")], "doc int, at int, text string")
    out = {r["doc"]: (r["words"], r["new_words"]) for r in nws.novelty(df, "doc", ["at"], "text").collect()}
    assert out == {1: (2, 1), 2: (2, 2), 3: (2, 0)}


# Monthly payrolls (thousands) and unemployment (%) from January 2000 to July 2001.
PAYROLLS = [131011, 131120, 131604, 131884, 132105, 132063, 132228, 132234, 132337, 132352, 132556, 132716, 132703, 132788, 132751, 132458, 132408, 132300, 132172]
UNEMPLOYMENT = [4.0, 4.1, 4.0, 3.8, 4.0, 4.0, 4.0, 4.1, 3.9, 3.9, 3.9, 3.9, 4.2, 4.2, 4.3, 4.4, 4.3, 4.5, 4.6]


def test_labour_trigger_of_2001(spark):
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(len(PAYROLLS))]
    df = spark.createDataFrame([("us", m, float(p), u) for m, p, u in zip(months, PAYROLLS, UNEMPLOYMENT)], "k string, month date, p double, u double")
    hits = ind.labour_trigger(df, ["k"], "month", "p", "u").filter("triggered").orderBy("month").collect()
    assert hits[0]["month"] == dt.date(2001, 6, 1)
    assert hits[0]["payroll_3m"] == pytest.approx(-150.33333333333334) and hits[0]["gap"] == pytest.approx(0.5)


def test_stage_deltas_of_published_readings(spark):
    # Three stages of a published case (price, rate in percent).
    rows = [("dotcom", dt.date(2000, 3, 10), 290.25, 6.39), ("dotcom", dt.date(2000, 5, 16), 276.0, 6.43), ("dotcom", dt.date(2000, 9, 22), 273.95, 5.85)]
    df = spark.createDataFrame(rows, "k string, date date, gold double, rate double")
    out = evt.event_deltas(df, ["k"], "date", ["gold"], ["rate"]).orderBy("date").collect()
    assert out[0]["gold_delta_pct"] is None
    assert out[1]["gold_delta_pct"] == pytest.approx(-4.9095607235142165) and out[1]["rate_delta_bp"] == pytest.approx(4.0)
    assert out[2]["gold_delta_pct"] == pytest.approx(-0.742753623188408) and out[2]["rate_delta_bp"] == pytest.approx(-58.0)


def test_moving_means_need_a_full_frame_of_values(spark):
    from tidemark.operators import indicators as ind

    values = [1.0, None, 3.0, 7.123456789, 5.0]
    df = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values)], "series_id string, date date, close double")
    got = ind.moving_means(df, ["series_id"], "date", "close", [1, 2]).orderBy("date").collect()
    assert [r.ma_1 for r in got] == values
    assert [r.ma_2 for r in got] == [None, None, None, pytest.approx(5.0617283945, abs=1e-12), pytest.approx(6.0617283945, abs=1e-12)]


def test_controls_leave_the_own_series_out(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(3)]
    paths = {"a": (100.0, 110.0, 121.0), "b": (100.0, 130.0, 130.0), "c": (100.0, 90.0, 99.0)}
    rows = [(s, d, x) for s, p in paths.items() for d, x in zip(days, p)] + [("d", days[2], 1.0)]
    out = evt.forward_returns(spark.createDataFrame(rows, "series_id string, date date, close double"), ["series_id"], "date", "close", (1,))
    got = {(r["series_id"], r["date"]): r["abn_1"] for r in out.collect()}
    assert got["a", days[0]] == pytest.approx(0.1 - (0.3 - 0.1) / 2) and got["c", days[1]] == pytest.approx(0.1 - (0.1 + 0.0) / 2)
    assert got["a", days[2]] is None and got["d", days[2]] is None
    alone = evt.forward_returns(spark.createDataFrame(rows[:3], "series_id string, date date, close double"), ["series_id"], "date", "close", (1,))
    assert {r["abn_1"] for r in alone.collect()} == {None}


def test_novelty_keeps_texts_without_words(spark):
    df = spark.createDataFrame([("d1", 1, None), ("d2", 2, " "), ("d3", 3, "gold")], "doc string, at int, text string")
    out = {r["doc"]: (r["words"], r["new_words"], r["novelty"]) for r in nws.novelty(df, "doc", ["at"], "text").collect()}
    assert out == {"d1": (0, 0, None), "d2": (0, 0, None), "d3": (1, 1, 1.0)}
