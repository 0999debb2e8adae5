"""Stand-in market tables over the given data, each with the same view as a DuckDB CTE.

Money and rates are summed as decimals so both engines get the same running totals.
Every view aggregates to one row per series and day before anything is ordered, so the
window operators above it see at most one row per calendar day and series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def index_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per return flag and line status: a compounding index of mean discounts."""
    daily = (
        table(spark, sf, "lineitem")
        .select(
            F.concat("l_returnflag", "l_linestatus").alias("series_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            # 8 digits keep the sum within 18, where decimals are plain longs
            F.col("l_discount").cast("decimal(8,4)").alias("disc"),
            F.col("l_tax").alias("tax"),
            F.col("l_quantity").alias("qty"),
        )
        .groupBy("series_id", "date")
        .agg(
            F.sum("disc").cast("double").alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.max("disc").cast("double").alias("dmax"),
            F.max("tax").alias("tmax"),
            F.sum("qty").alias("volume"),
        )
    )
    w = Window.partitionBy("series_id").orderBy("date")
    r = F.round(F.col("s") / F.col("n") - 0.05, 8).cast("decimal(18,8)")
    total = F.sum(r).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    bars = daily.withColumn("close", F.round(100.0 * F.exp(total), 6))
    bars = bars.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return bars.select(
        "series_id", "date", "open",
        (F.greatest("open", "close") * (1 + F.col("dmax") * 0.05)).alias("high"),
        (F.least("open", "close") * (1 - F.col("tmax") * 0.05)).alias("low"),
        "close", "volume",
    )


def kept_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The daily bars written once, for plans that read them more than once."""
    return materialise(index_bars(spark, sf))


BARS = """
daily AS (
  SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE) AS s, count(*) AS n,
         CAST(max(CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE) AS dmax, max(l_tax) AS tmax, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
closes AS (
  SELECT *, round(100.0 * exp(CAST(sum(CAST(round(s / n - 0.05, 8) AS DECIMAL(18,8)))
           OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE)), 6) AS close
  FROM daily),
opens AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY series_id ORDER BY date), 100.0) AS open FROM closes),
bars AS (
  SELECT series_id, date, open, greatest(open, close) * (1 + dmax * 0.05) AS high,
         least(open, close) * (1 - tmax * 0.05) AS low, close, volume,
         row_number() OVER (PARTITION BY series_id ORDER BY date) AS i
  FROM opens)"""


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per order priority built from single prices."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("n"),
        )
    )


RAW = """
raw AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*) AS n
  FROM orders GROUP BY 1, 2)"""


def product_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the product: days with a finished order, NAV and status text."""
    day = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .groupBy(day.alias("date"))
        .agg(
            (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 97531.0).alias("nav"),
            F.when(F.min("o_orderpriority") == "1-URGENT", F.lit("open")).otherwise(F.lit("closed")).alias("sub_status"),
            F.when(F.max("o_orderpriority") == "5-LOW", F.lit("open")).otherwise(F.lit("closed")).alias("red_status"),
        )
        .withColumn("product_id", F.lit("P1"))
    )


CAL = """
cal AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 97531.0 AS nav,
         CASE WHEN min(o_orderpriority) = '1-URGENT' THEN 'open' ELSE 'closed' END AS sub_status,
         CASE WHEN max(o_orderpriority) = '5-LOW' THEN 'open' ELSE 'closed' END AS red_status,
         'P1' AS product_id
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def fx_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A rate between 6 and 8 on the days an urgent order was booked."""
    return (
        table(spark, sf, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg((6 + F.max("o_totalprice") / 300000.0).alias("fx"))
    )


FX = """
fx AS (
  SELECT CAST(o_orderdate AS DATE) AS date, 6 + max(o_totalprice) / 300000.0 AS fx
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"""


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as headlines: first line is the title, the id sets the minute within a year."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", "source",
        F.split("text", "\n").getItem(0).alias("title"),
        F.concat_ws("/", F.lit("https://news.example"), F.col("source"), F.col("doc_id").cast("string")).alias("link"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=(F.col("doc_id") * 37 % 525600).cast("int"))).alias("published"),
        "text", "lang",
    )


NEWS = """
news AS (
  SELECT doc_id, source, string_split(text, chr(10))[1] AS title,
         'https://news.example/' || source || '/' || doc_id AS link,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 % 525600 AS INTEGER)) AS published, text, lang
  FROM documents)"""


# Named phases as (label, first day, last day).
PHASES = [
    ("early", "1995-01-01", "1996-12-31"),
    ("middle", "1997-01-01", "1998-12-31"),
    ("late", "1999-01-01", "2001-12-31"),
    ("full", "1995-01-01", "2001-12-31"),
]

PHASES_SQL = "phases(phase, p_start, p_end) AS (VALUES " + ", ".join(
    f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in PHASES
) + ")"
