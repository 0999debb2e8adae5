import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.operators.scan import PART, ranged, running


def rows(n=600, seed=1):
    rng = np.random.default_rng(seed)
    # one key owns a third of the rows
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    day = rng.integers(0, 20, n)
    v = np.round(rng.normal(0, 5, n), 3)
    gaps = rng.random(n) < 0.5
    return pd.DataFrame({"k": key, "day": day, "seq": np.arange(n), "v": v, "m": np.where(gaps, None, v)}).astype({"m": "float64"})


@pytest.mark.parametrize("reverse", [False, True])
def test_ranged_scan_equals_plain_scan(spark, reverse):
    df = spark.createDataFrame(rows()).withColumn("m", F.when(F.isnan("m"), None).otherwise(F.col("m")))
    aggs = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "l": ("last", "m")}
    plain = running(df, ["k"], ["day", "seq"], aggs, reverse=reverse)
    blocked = running(ranged(df, ["k"], ["day", "seq"]), ["k"], ["day", "seq"], aggs, reverse=reverse)
    cols = ["seq", "s", "lo", "hi", "l"]
    a, b = (x.select(*cols).toPandas().sort_values("seq").to_numpy(float) for x in (plain, blocked))
    np.testing.assert_allclose(a, b, atol=1e-9)


def asof_frames(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": rng.integers(0, 4, 300), "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5000, 300), "min"), "id": range(300)})
    right = pd.DataFrame({"k": rng.integers(0, 4, 200), "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5000, 200), "min"), "v": rng.normal(size=200)})
    right = right.drop_duplicates(["k", "t"])
    return left, right


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("spread", [False, True])
def test_asof_join_equals_pandas(spark, strict, spread):
    left, right = asof_frames(spark)
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", allow_exact_matches=not strict).sort_values("id")
    got = align.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", ["v"], strict=strict, spread=spread)
    np.testing.assert_allclose(got.toPandas().sort_values("id")["v"].to_numpy(float), want["v"].to_numpy(float))


def test_a_hot_key_spans_ranges(spark):
    """One key with 90 % of the rows, null keys and a key that stands in the middle of a range."""
    pdf = pd.DataFrame({"seq": np.arange(4000), "v": np.arange(4000) % 7}).astype({"v": "int64"})
    key = F.when(F.col("seq") % 10 > 0, "hot").when(F.col("seq") % 20 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("seq") % 90).cast("string")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that so few rows are cut at all
    try:
        cut = ranged(spark.createDataFrame(pdf).withColumn("k", key), ["k"], ["seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = cut.where("k = 'hot'").groupBy(PART).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 3000
    got = running(cut, ["k"], ["seq"], {"s": ("sum", "v")}).toPandas().sort_values("seq")
    want = got["v"].groupby(got["k"].fillna("none")).cumsum()
    assert (got["s"] == want).all()
