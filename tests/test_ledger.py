import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as led

S, ORDER = ["supp"], ["day", "seq"]


def trades(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    # one account owns a third of all trades
    supp = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n))
    day = np.sort(rng.integers(0, 90, n))
    pdf = pd.DataFrame({"supp": supp, "day": [dt.date(2024, 1, 1) + dt.timedelta(days=int(d)) for d in day], "seq": range(n),
                        "side": np.where(rng.random(n) < 0.5, "buy", "sell"), "units": rng.integers(1, 50, n).astype(float), "price": rng.uniform(5, 9, n).round(2)})
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumns({"month": F.trunc("day", "MM"), "part": F.struct("day", F.floor(F.col("seq") / 10).alias("p"))})


def fifo_loop(pdf):
    """Sells take from the oldest lots; what is not held cannot be sold."""
    filled, out = {}, []
    for _, g in pdf.groupby("supp"):
        lots = []
        for r in g.sort_values("seq").itertuples():
            if r.side == "buy":
                lots.append([r.seq, r.units])
                filled[r.seq] = r.units
                continue
            want = r.units
            for lot in lots:
                take = min(lot[1], want)
                if take > 0:
                    out.append((r.seq, lot[0], take))
                    lot[1] -= take
                    want -= take
            filled[r.seq] = r.units - want
    return filled, sorted(out)


@pytest.mark.parametrize("spread", [False, True])
def test_capped_sells_and_fifo_equal_a_loop(spark, spread):
    pdf, df = trades(spark)
    filled, matches = fifo_loop(pdf)
    capped = led.cap_sells(df, S, ORDER, spread)
    assert {r["seq"]: r["filled"] for r in capped.collect()} == filled
    got = led.fifo_match(capped, S, ORDER)
    assert sorted((r["sell"]["seq"], r["lot"]["seq"], r["matched"]) for r in got.collect()) == matches


def test_fifo_gives_at_most_one_row_per_trade(spark):
    pdf, df = trades(spark)
    assert led.fifo_match(led.cap_sells(df, S, ORDER), S, ORDER).count() <= len(pdf)


def test_books_balance_and_lots_are_conserved(spark):
    _, df = trades(spark)
    capped = led.cap_sells(df, S, ORDER)
    settled = led.settle(capped, df.select("day"), "day", settle_days=2)
    books = led.daily_books(settled, S, "day", "cash_date", 1e6)
    assert led.ledger_violations(books, S, "day").count() == 0
    matches = led.fifo_match(capped, S, ORDER)
    assert led.lots_conserved(books, led.open_lots(capped, matches, S), S, "day").count() == 0
    assert led.ledger_violations(led.daily_books(settled, S, "day", "cash_date", 10.0), S, "day").count() > 0


def test_settlement_counts_sessions_and_is_open_past_the_last(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 8, 9)]
    cal = led.session_shift(spark.createDataFrame([(d,) for d in days], "day date"), "day", confirm=1, cash=3).orderBy("day").collect()
    day = lambda d: d and d.day
    assert [(r["session"], day(r["confirm"]), day(r["cash"])) for r in cal] == [(1, 3, 9), (2, 8, None), (3, 9, None), (4, None, None)]


def test_proceeds_stay_unsettled_without_a_cash_date(spark):
    rows = [("a", dt.date(2024, 1, 2), "buy", 2.0, 5.0, dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 3), "sell", 2.0, 6.0, None)]
    df = spark.createDataFrame(rows, "supp string, day date, side string, filled double, price double, cash_date date")
    last = led.daily_books(df, ["supp"], "day", "cash_date", 10.0).orderBy("day").collect()[-1]
    assert (last["day"].day, last["cash"], last["unsettled"], last["units"]) == (3, 0.0, 12.0, 0.0)


def test_redemption_fee_by_age(spark):
    rows = [(1, 10.0, 2.0, dt.date(2024, 1, 1), dt.date(2024, 1, 7)), (1, 5.0, 2.0, dt.date(2024, 1, 1), dt.date(2024, 1, 8)), (1, 4.0, 2.0, dt.date(2024, 1, 1), dt.date(2024, 1, 31))]
    df = spark.createDataFrame(rows, "k int, matched double, price double, a date, z date")
    out = led.redemption_fees(df, ["k"], F.col("price"), F.col("z"), F.col("a")).first()
    assert (out["units"], out["young_units"]) == (19.0, 15.0)
    assert out["fee"] == pytest.approx(10 * 2 * 0.015 + 5 * 2 * 0.005)


def test_order_costs(spark):
    df = spark.createDataFrame([(1000.0, 1.5)], "cash double, price double")
    units, fee, spent = df.select(*led.fund_order("cash", F.col("price"))).first()
    assert units == 665.66 and fee == pytest.approx(1000 - 1000 / 1.0015) and spent == pytest.approx(665.66 * 1.5 + fee)
    units, fee, spent = df.select(*led.metal_order("cash", F.col("price") * 300)).first()
    assert units == 2.2099 and fee == pytest.approx(2.2099 * 2.5) and spent == pytest.approx(2.2099 * 452.5)
