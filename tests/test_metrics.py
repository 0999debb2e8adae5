import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import indicators as ind
from tidemark.operators import metrics as met

K = ["series_id"]
DAY0 = dt.date(2020, 1, 1)


def bars(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.r_[100.0, close[:-1]] * (1 + rng.normal(0, 0.002, n))
    weight = np.repeat(rng.integers(0, 3, n // 20) / 2.0, 20)
    pdf = pd.DataFrame({"series_id": "a", "date": [DAY0 + dt.timedelta(days=i) for i in range(n)], "open": open_, "close": close, "weight": weight})
    return pdf, spark.createDataFrame(pdf)


def curve_loop(pdf, cost):
    equity, old, before, out = 100.0, 0.0, None, []
    for r in pdf.itertuples():
        if before is not None:
            equity *= 1 + old * (r.open / before - 1)
        fee = equity * cost * abs(r.weight - old)
        equity = (equity - fee) * (1 + r.weight * (r.close / r.open - 1))
        out.append((equity, fee, r.weight != old))
        old, before = r.weight, r.close
    return pd.DataFrame(out, columns=["equity", "fee", "traded"])


def test_equity_curve_equals_a_loop(spark):
    pdf, df = bars(spark)
    got = met.equity_curve(df, K, "date").toPandas().sort_values("date").reset_index()
    want = curve_loop(pdf, 0.003)
    np.testing.assert_allclose(got.equity, want.equity)
    np.testing.assert_allclose(got.fee, want.fee, atol=1e-12)
    assert got.traded.tolist() == want.traded.tolist()


def test_window_metrics_use_the_equity_before_the_window(spark):
    pdf, df = bars(spark)
    curve = met.equity_curve(df, K, "date")
    got = met.performance(curve, K, "date", [("p", "2020-06-01", "2020-12-31"), ("none", "2031-01-01", "2031-12-31")]).collect()
    assert len(got) == 1
    c = curve_loop(pdf, 0.003).assign(date=pdf.date, weight=pdf.weight)
    part = c[(c.date >= dt.date(2020, 6, 1)) & (c.date <= dt.date(2020, 12, 31))]
    base = c[c.date < dt.date(2020, 6, 1)].equity.iloc[-1]
    path = np.r_[base, part.equity]
    years = (dt.date(2020, 12, 31) - dt.date(2020, 6, 1)).days / 365.25
    growth = path[-1] / base
    assert got[0]["return_pct"] == pytest.approx((growth - 1) * 100)
    assert got[0]["cagr_pct"] == pytest.approx((growth ** (1 / years) - 1) * 100)
    assert got[0]["max_drawdown_pct"] == pytest.approx((path / np.maximum.accumulate(path) - 1).min() * 100)
    assert got[0]["average_weight_pct"] == pytest.approx(part.weight.mean() * 100)
    assert got[0]["fees"] == pytest.approx(part.fee.sum()) and got[0]["trade_days"] == int(part.traded.sum())


def test_episodes_add_up_and_an_open_one_has_no_sell_date(spark):
    _, df = bars(spark)
    curve = met.equity_curve(df, K, "date")
    ep = met.holding_episodes(curve, K, "date").toPandas().sort_values("episode")
    c = curve.toPandas().sort_values("date")
    assert ep.net_pnl.sum() == pytest.approx(c.equity.iloc[-1] - c.equity.iloc[0], abs=1e-6) or c.weight.iloc[0] > 0
    assert ep.cost.sum() == pytest.approx(c.fee.sum())
    assert (ep.sell_date.isna().sum() == 1) == (c.weight.iloc[-1] > 0)


def test_infeasible_sets_score_minus_999(spark):
    rows = [("s", "x", "one", 30.0, -10.0, 60.0), ("s", "x", "two", 10.0, -10.0, 60.0), ("s", "y", "one", 5.0, -10.0, 60.0), ("s", "y", "two", 5.0, -10.0, 60.0), ("t", "x", "one", 90.0, -16.0, 60.0)]
    df = spark.createDataFrame(rows, "spec string, series_id string, phase string, return_pct double, max_drawdown_pct double, average_weight_pct double")
    out = {r["spec"]: r["score"] for r in met.worst_product_score(df, ["spec"], "series_id", ["one", "two"]).collect()}
    assert out["t"] == -999.0 and out["s"] == pytest.approx((1.05 * 1.05) ** 0.25 - 1)


def test_two_sleeves_reproduce_the_published_mix(spark):
    # Returns of two rules over the same period and of their 50/50 mix, in percent.
    rows = [("x", DAY0, "one", 100 * (1 + 1.4556556489900413), 1.0), ("x", DAY0, "two", 100 * (1 + 1.313818543830902), 0.0)]
    df = spark.createDataFrame(rows, "series_id string, date date, rule string, equity double, weight double")
    out = met.sleeves(df, ["series_id", "date"], df.rule == "one", df.rule == "two").first()
    assert out["equity"] - 100 == pytest.approx(138.4737096410472)
    assert out["weight"] == pytest.approx(rows[0][3] / (rows[0][3] + rows[1][3]))


def series(spark, values):
    return spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values)], "series_id string, date date, x double")


def test_partial_windows_are_null(spark):
    out = ind.rolling(series(spark, [1.0, 2.0, 3.0]), K, "date", "x", "mean", 3, "m").orderBy("date").collect()
    assert [r["m"] for r in out] == [None, None, 2.0]
    out = ind.moving_means(series(spark, [1.0, 2.0, 3.0, 4.0]), K, "date", "x", [2, 3]).orderBy("date").collect()
    assert [r["ma_3"] for r in out] == [None, None, 2.0, 3.0] and [r["ma_2"] for r in out] == [None, 1.5, 2.5, 3.5]


# Twenty daily real-yield readings and the published means for them.
REAL_YIELD = [2.92, 2.92, 2.95, 2.91, 2.92, 2.87, 2.91, 2.88, 2.84, 2.78, 2.74, 2.80, 2.77, 2.76, 2.64, 2.66, 2.66, 2.64, 2.67, 2.63]


def test_trend_means_of_published_readings(spark):
    last = ind.last_row(ind.trend_5_5_20(series(spark, REAL_YIELD), K, "date", "x"), K, "date").first()
    assert last["last5"] == pytest.approx(2.652) and last["previous5"] == pytest.approx(2.742)
    assert last["falling"]


def test_run_lengths_restart(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate([True, True, None, True, False, True, True, True])]
    out = ind.run_length(spark.createDataFrame(rows, "series_id string, date date, c boolean"), K, "date", "c").orderBy("date").collect()
    assert [r["run"] for r in out] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_quadratic_fit_equals_polyfit(spark):
    rng = np.random.default_rng(1)
    y = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.01, 150)))
    out = ind.rolling_quadfit(series(spark, y.tolist()), K, "date", "x", 60).toPandas().sort_values("date").reset_index()
    for i in (59, 100, 149):
        z = np.log(y[i - 59:i + 1])
        c = np.polyfit(np.arange(60), z, 2)
        fit = np.polyval(c, np.arange(60))
        assert out.end_slope[i] == pytest.approx(2 * c[0] * 59 + c[1], rel=1e-6)
        assert out.quad_r2[i] == pytest.approx(1 - ((z - fit) ** 2).sum() / ((z - z.mean()) ** 2).sum(), rel=1e-6)


def test_a_ruinous_day_ends_the_curve(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), 100.0, c, w) for i, (c, w) in enumerate([(110.0, 1.0), (40.0, 2.0), (150.0, 1.0)])]
    df = spark.createDataFrame(rows, "series_id string, date date, open double, close double, weight double")
    got = met.equity_curve(df, K, "date", cost=0.0).orderBy("date").collect()
    assert [round(r.equity, 6) for r in got] == [110.0, 0.0, 0.0]


def test_year_windows_equal_a_loop(spark):
    pdf, _ = bars(spark, n=900, seed=11)
    # a silence of four months, and a second series with a single month
    silent = (pdf["date"] >= dt.date(2021, 3, 1)) & (pdf["date"] < dt.date(2021, 7, 1))
    pdf = pdf[~silent].reset_index(drop=True)
    pdf["equity"], pdf["fee"], pdf["traded"] = curve_loop(pdf, 0.0)[["equity", "fee", "traded"]].to_numpy().T
    pdf = pdf.astype({"equity": float, "fee": float, "traded": bool})
    more = pdf.head(20).assign(series_id="b")
    df = spark.createDataFrame(pd.concat([pdf, more])[["series_id", "date", "equity", "weight", "fee", "traded"]])
    prior = np.r_[100.0, pdf["equity"].to_numpy()[:-1]]
    month = pd.to_datetime(pdf["date"]).dt.year * 12 + pd.to_datetime(pdf["date"]).dt.month
    for months in (12, 3):
        falls, shares = [], []
        for end in range(month.min() + months - 1, month.max() + 1):
            inside = ((month > end - months) & (month <= end)).to_numpy()
            if inside.any():
                e, p = pdf["equity"].to_numpy()[inside], prior[inside]
                falls.append((e / np.maximum.accumulate(np.maximum(e, p)) - 1).min() * 100)
                shares.append(pdf["weight"].to_numpy()[inside].mean() * 100)
        # limits between two windows' values
        limit, most = (float(np.mean(np.unique(x)[len(np.unique(x)) // 2 - 1 :][:2])) for x in (falls, shares))
        got = met.rolling_year_audit(df, K, "date", limit, most, months).collect()
        want = [("a", len(falls), sum(x < limit for x in falls), sum(x > most for x in shares))]
        assert [tuple(r) for r in got if r.series_id == "a"] == want
        assert [r for r in got if r.series_id == "b"] == []


def test_top_ranks_keep_ties_of_a_huge_group(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators import align

    df = spark.range(6000).select(F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("g"), F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(700))).alias("s"), "id")
    want = df.where("s IS NOT NULL").withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("s")))).where("place <= 10")
    got = align.top_ranked(df, ["g"], "s", 10)
    assert sorted(map(tuple, got.select("g", "s", "id", "place").collect())) == sorted(map(tuple, want.select("g", "s", "id", "place").collect()))
    one = align.top_ranked(df.withColumn("s", F.lit(1)), ["g"], "s", 3)
    assert one.count() == 6000 and {r.place for r in one.select("place").distinct().collect()} == {1}
    assert align.top_ranked(df.limit(0), ["g"], "s", 3).count() == 0
