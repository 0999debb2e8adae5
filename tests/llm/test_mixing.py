import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing


def plain_targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """Share, cut at the capacity and share the excess again until nothing is above."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {x: weights[k % len(weights)] for k, x in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[x] for x in open_)
        over = {x for x in open_ if left * weight[x] / total >= most * sizes[x]}
        if not over:
            return target | {x: left * weight[x] / total for x in open_}
        for x in over:
            target[x] = most * sizes[x]
            left -= target[x]
        open_ -= over
    return target


def check(df, tolerance_docs=2.0):
    rows = mixing.with_copies(df).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    totals, taken, largest = Counter(), Counter(), defaultdict(int)
    for r, size in zip(rows, sizes):
        assert r["__size"] == size and 0 <= r["__copies"] <= 2 and (size or r["__copies"] == 1)
        totals[r.source] += size
        taken[r.source] += size * r["__copies"]
        largest[r.source] = max(largest[r.source], size)
    want = plain_targets(totals)
    for r in rows:
        assert r["__total"] == totals[r.source]
        assert abs(r["__target"] - want[r.source]) <= 1e-6 * max(1, want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= tolerance_docs * largest[source] + 1e-6
    return rows


def test_awkward_rows(awkward, empty):
    assert len(check(awkward)) == awkward.count()
    assert mixing.with_copies(empty).count() == 0 and mixing.mix(empty).columns == empty.columns


def test_targets_are_met_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = lambda rows: sorted((r.doc_id, r["__copies"]) for r in rows)
    assert key(check(docs)) == key(mixing.with_copies(docs.repartition(7)).collect())


def test_copies_of_one_text_are_dealt_evenly(spark):
    rows = [(k, "a b c", "x") for k in range(1500)] + [(k, "a " * 50, "y") for k in range(30)] + [(k, "d", "z") for k in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), tolerance_docs=12)


def test_rates_are_the_balanced_ones(spark):
    """The rates meet the optimality condition of the convex problem: log r is a multiple of the size below the cap."""
    rng = np.random.default_rng(0)
    rows = [(s, int(n), 1) for s in "abc" for n in rng.integers(1, 900, 80)]
    counts = spark.createDataFrame(rows, "__source string, __size long, __docs long").groupBy("__source", "__size").agg({"__docs": "sum"}).withColumnRenamed("sum(__docs)", "__docs")
    got = mixing.rates(counts).collect()
    for s in "abc":
        own = [(r["__size"], r["__docs"], r["__micro"] / 1e6, r["__target"]) for r in got if r["__source"] == s]
        assert abs(sum(z * n * r for z, n, r, _ in own) / own[0][3] - 1) < 1e-4
        slopes = [np.log(r) / z for z, _, r, _ in own if 1e-3 < r < 1.999 and z > 100]
        assert np.ptp(slopes) < 1e-5 if slopes else True


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5), (2, "c d e", "x", 6), (3, "f", None, 7)], "doc_id long, text string, source string, __copies_left int")
    copies = {r.doc_id: r["__copies"] for r in mixing.with_copies(df).collect()}
    got = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert got == {k: v for k, v in copies.items() if v} and mixing.mix(df).columns == df.columns


@pytest.mark.parametrize("sizes", [{"a": 0, None: 0}, {"a": 10, "b": 0, None: 1000}, {"a": 1}])
def test_targets_of_odd_sources(spark, sizes):
    counts = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "__source string, __size long, __docs long")
    got = {r["__source"]: r["__target"] for r in mixing.targets(counts).collect()}
    assert got == pytest.approx(plain_targets(sizes))
