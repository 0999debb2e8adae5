"""Pairs that can't be links are told by sketches, so that their texts are neither moved nor cut into shingles."""

import numpy as np
import pytest
import test_jaccard
from pyspark.sql import functions as F

from tidemark.llm import components as joining
from tidemark.llm import jaccard


def sets_of(rng, n):
    """Sets of 64-bit numbers around one base, from equal to unlike, of sizes at which sketches change their width."""
    base = rng.integers(1, 2**63, n, dtype=np.uint64)
    for part in (0, 0.02, 0.1, 0.3, 1):
        k = int(part * n)
        yield np.unique(np.r_[base[k:], rng.integers(1, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)])
    yield np.unique(np.r_[base, rng.integers(1, 2**63, 1 + n // 9, dtype=np.uint64)])


@pytest.mark.parametrize("n", [1, 3, 40, 250, 256, 257, 480, 520, 1100, 9000])
def test_sketches_differ_in_no_more_than_sets_do(n):
    rng = np.random.default_rng(n)
    sets = list(sets_of(rng, n))
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    sketch = jaccard.Sketches(*jaccard.sketches(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), sizes))
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = sketch.differences(a, b)
    for x, y, found in zip(a, b, got):
        apart = len(np.setxor1d(sets[x], sets[y]))
        assert found <= apart and (found - apart) % 2 == 0
        common = len(np.intersect1d(sets[x], sets[y]))
        linked = 100 * common >= 90 * (sizes[x] + sizes[y] - common)
        assert jaccard.may_link(np.array([apart]), sizes[[x]], sizes[[y]], 90)[0] == linked
        assert not linked or jaccard.may_link(got[(a == x) & (b == y)], sizes[[x]], sizes[[y]], 90)[0]
    assert n < 40 or got[4] > 0.1 * n


def near_misses(rng, groups, members, words, edits):
    """Texts of a group share all but some words: each two of them are close to 3-word sets of 0.9, but few are links."""
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for _ in range(members):
            text = list(base)
            for at in rng.choice(words, edits, replace=False):
                text[at] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_texts_of_unlike_pairs_are_not_compared(spark, monkeypatch):
    """Before, the texts of each class and its region's pivot were compared, and those of all members of families."""
    asked, dealt, measured, links = [], [], jaccard.distances, jaccard.family_links
    monkeypatch.setattr(jaccard, "distances", lambda pairs, *a, **b: asked.append(pairs.count()) or measured(pairs, *a, **b))
    monkeypatch.setattr(jaccard, "family_links", lambda open_, *a, **b: dealt.append(open_.select("class").distinct().count()) or links(open_, *a, **b))
    rng = np.random.default_rng(3)
    rows = near_misses(rng, 3, 60, 300, 9) + [(1000, "one two three four")]
    rows += [(1001 + k, f"{rows[7 * k][1]} more words") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert test_jaccard.found(df) == test_jaccard.brute(rows)
    assert 12 <= sum(asked) <= 30 and sum(dealt) <= 24


def test_members_of_families_are_screened_by_regions_and_labels(spark):
    rng = np.random.default_rng(4)
    rows = near_misses(rng, 1, 6, 200, 1) + near_misses(rng, 1, 20, 200, 30)
    sets = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "class long, text string")
    texts = jaccard.keyed(sets, "text", 3, packed=True).selectExpr("class", "__packed AS packed", "__n AS n")
    texts = jaccard.written(jaccard.sketched(texts, 3))
    screen = lambda open_: {r["class"] for r in jaccard.screened_members(open_, texts, 90).collect()}
    open_ = sets.select(F.lit(1).cast("long").alias("region"), "class", F.col("class").alias("label"))
    assert screen(open_) == set(range(6))
    assert screen(open_.withColumn("region", F.col("class") % 3)) == set(range(6))
    assert screen(open_.withColumn("region", F.col("class"))) == set()
    assert screen(open_.withColumn("label", F.when(F.col("class") < 6, 0).otherwise(F.col("class")))) == set()


def test_members_of_several_wide_blocks_are_screened(spark, monkeypatch):
    rows = near_misses(np.random.default_rng(5), 1, 40, 200, 1) + near_misses(np.random.default_rng(6), 1, 40, 200, 30)
    sets = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "class long, text string")
    texts = jaccard.written(jaccard.sketched(jaccard.keyed(sets, "text", 3, packed=True).selectExpr("class", "__packed AS packed", "__n AS n"), 3))
    open_ = jaccard.written(sets.select(F.lit(1).cast("long").alias("region"), "class", F.col("class").alias("label")))
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(jaccard, "WIDE", 4)
    monkeypatch.setattr(jaccard, "COMPARED", 16)
    assert {r["class"] for r in jaccard.screened_members(open_, texts, 90).collect()} == set(range(40))


def test_blocks_without_texts_hold_more_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    open_ = spark.createDataFrame([(0, k, k) for k in range(100)], "region long, class long, label long")
    sizes = spark.createDataFrame([(k, 300) for k in range(100)], "class long, n long")
    assert jaccard.places(open_, sizes, 8).count() == 100 < jaccard.places(open_, sizes).count()


@pytest.mark.parametrize("rows", [200_000, 40])
def test_a_class_has_one_row_in_a_region_whatever_the_parts(spark, monkeypatch, rows):
    texts = near_misses(np.random.default_rng(7), 4, 8, 120, 2)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "PART_ROWS", rows)
    monkeypatch.setattr(jaccard, "HELD_ROWS", 100)
    got = jaccard.region_members(df, "text", 3, 90, 4 * 8 * 118).collect()
    assert len({(r.region, r["class"]) for r in got}) == len(got) > 100
    by = {}
    for r in got:
        by.setdefault(r.region, []).append((r["class"], r.pivot))
    assert all(len(x) > 1 and {p for _, p in x} == {min(c for c, _ in x)} for x in by.values())
    assert len({r["class"] for r in got}) == 32


@pytest.mark.parametrize("alone", [500_000, 40, 0])
def test_links_are_joined_by_rounds_and_by_one_task(spark, monkeypatch, alone):
    """0: by rounds only; 40: the last links of rounds by one task."""
    monkeypatch.setattr(joining, "LINKS_ALONE", alone)
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (50, 2))] + [(200 + int(k), 201 + int(k)) for k in rng.permutation(70)] + [(500, 600 + k) for k in range(20)]
    links += [(900, 901), (901, 900), (3, 3), (None, 5)]
    got = {r.node: r.root for r in joining.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == root
    assert joining.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
