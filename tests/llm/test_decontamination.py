import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import decontamination as dc
from tidemark.llm.fm_index import ShardIndex, suffix_order

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(texts, items, width):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((text, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


def found(df, items, **options):
    rows = dc.mark(df, items, **options).collect()
    return sorted(((r.text, r["__n_words"], sum(s.end - s.first for s in r["__spans"]), tuple(r["__items"])) for r in rows), key=repr)


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_marks_equal_plain_search(spark, awkward, random_texts, monkeypatch, block):
    """Also with the benchmark in several blocks, whose spans are merged."""
    monkeypatch.setattr(dc.blocks_of, "__defaults__", (block,))
    items = [(k, t) for k, t in enumerate(random_texts[::7])] + [(900, "w1 w2"), (901, "W3, w4! w5"), (902, ""), (903, None), (None, "w7 w8 w9"), (900, "one two"), (904, "one TWO")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = awkward.select("doc_id", "text").union(spark.createDataFrame([(k, t) for k, t in enumerate(random_texts)], "doc_id long, text string"))
    for width in (10, 4):
        assert found(df, bench, width=width) == brute([r.text for r in df.collect()], items, width)


def test_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.mark(empty, none).count() == 0
    assert dc.without_hits(awkward, none).count() == awkward.count()
    assert dc.without_hits(awkward, none).columns == awkward.columns


def test_cut_takes_the_spans_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. one TWO, three four! and this"), (2, None), (3, "one two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {r.doc_id: r.text for r in dc.cut_hits(docs, bench, width=4).collect()}
    assert got == {1: "Keep this. ! and this", 2: None, 3: ""}


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    for top in (1, 2, 5):
        text = rng.integers(0, top + 1, 400)
        text[-1] = 0
        index = ShardIndex(text, top)
        patterns = [tuple(rng.integers(1, top + 1, rng.integers(1, 6))) for _ in range(60)]
        width = max(map(len, patterns))
        low, high = index.search(np.array([(0,) * (width - len(p)) + p for p in patterns]), np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low, high):
            want = [k for k in range(len(text) - len(p) + 1) if tuple(text[k : k + len(p)]) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order():
    text = np.array([2, 1, 2, 0, 2, 1, 2, 0, 1, 0])
    ends = {k: i for i, k in enumerate(np.flatnonzero(text == 0))}
    key = lambda k: [(0, ends[j]) if text[j] == 0 else (1, text[j]) for j in range(k, len(text))]
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=key)
