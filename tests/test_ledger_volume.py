"""Trades are shuffled once and not written; hot keys are cut and give the same ledgers."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from test_ledger import ORDER, S, fifo_loop, trades
from tidemark.operators import ledger as led
from tidemark.operators import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_ranges(spark, monkeypatch):
    monkeypatch.setattr(scan, "LEAST", 12)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", n)


@pytest.mark.parametrize("name, shuffles", [("led2_sells_capped_by_holdings", 1), ("led2_fifo_match", 1), ("led3_redemption_fees", 1), ("led6_daily_books", 1)])
def test_trades_are_shuffled_once(spark, name, shuffles):
    plan = entry_points.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    by_supplier = re.findall(r"Exchange hashpartitioning\((?!day)", plan)
    assert len(by_supplier) == shuffles and "tidemark-run" not in plan


def test_cut_keys_equal_a_loop(spark, many_ranges):
    pdf, df = trades(spark)
    filled, matches = fifo_loop(pdf)
    capped = led.cap_sells(df, S, ORDER, spread=True)
    assert capped.where(f"supp = 0 AND {scan.PART} IS NOT NULL").select(scan.PART).distinct().count() > 2
    assert {r["seq"]: r["filled"] for r in capped.collect()} == filled
    got = led.fifo_match(capped, S, ORDER, carry=["seq"])
    assert sorted((r["sell"]["seq"], r["lot"]["seq"], r["matched"]) for r in got.collect()) == matches


def test_some_keys_cut_and_some_not(spark, many_ranges):
    """Two small accounts beside the hot ones stay whole; FIFO takes both ways."""
    pdf, df = trades(spark)
    few = df.where("supp = 0 OR supp > 3 AND seq % 9 = 0")
    kept = {r["seq"] for r in few.collect()}
    _, matches = fifo_loop(pdf[pdf["seq"].isin(kept)])
    capped = led.cap_sells(few, S, ORDER, spread=True)
    assert {r["supp"]: r["n"] for r in capped.groupBy("supp").agg(F.countDistinct(scan.PART).alias("n")).collect()}[5] == 0
    got = led.fifo_match(capped, S, ORDER)
    assert sorted((r["sell"]["seq"], r["lot"]["seq"], r["matched"]) for r in got.collect()) == matches


def test_books_of_cut_keys_are_the_same(spark, many_ranges):
    _, df = trades(spark)
    books = lambda spread: led.daily_books(
        led.settle(led.cap_sells(df, S, ORDER, spread), df.select("day"), "day", settle_days=2), S, "day", "cash_date", 1e6)
    assert scan.PART in led.cap_sells(df, S, ORDER, True).columns
    rows = lambda b: sorted(tuple(r) for r in b.select("supp", "day", "cash", "units", "unsettled", "price").collect())
    assert rows(books(True)) == rows(books(False))


def test_a_cut_table_is_not_shuffled_for_its_ranges(spark, many_ranges):
    _, df = trades(spark)
    cut = scan.ranged(df, S, ORDER)
    assert scan.PART in cut.columns and "Exchange hashpartitioning" not in cut._jdf.queryExecution().executedPlan().toString()
