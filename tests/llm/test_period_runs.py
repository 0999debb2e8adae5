"""Runs of words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import period_runs, queries
from tidemark.llm.suffix_tree import Minima, SuffixTree


def brute(w, least=12):
    """(start, length, period) of all runs."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in out.items())


def row_of(words, least=12):
    runs = brute(words, least)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_words(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5, 40])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        if len(w) > 4:
            a, p = rng.randrange(len(w)), rng.randint(1, len(w) // 3 + 1)
            w[a:] = [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]
    return w


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_equal_a_plain_search(least):
    rng = random.Random(least)
    for _ in range(1200):
        w = random_words(rng)
        assert [tuple(r) for r in period_runs.find_runs(w, least).tolist()] == brute(w, least), w


def test_common_extensions_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        tree, ends = SuffixTree(s), [*s, 0]
        for a in range(len(ends)):
            for b in range(a + 1, len(ends)):
                same = next(k for k in range(len(ends)) if ends[a + k] != ends[b + k])
                assert tree.common(np.array([a]), np.array([b]))[0] == same
        assert np.argsort(tree.rank).tolist() == sorted(range(len(ends)), key=lambda i: ends[i:])
        assert np.argsort(tree.rank_turned()).tolist() == sorted(range(len(ends)), key=lambda i: [-x if x else -9 for x in ends[i:]])


def test_minima_equal_plain_ones():
    v = np.random.default_rng(1).integers(0, 50, 300)
    a, b = (x.ravel() for x in np.triu_indices(300))
    assert Minima(v).between(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b)]


def test_awkward_rows(spark, awkward, empty):
    extra = awkward.select("*").withColumnRenamed("score", "runs").withColumnRenamed("kept", "n_runs")
    got = period_runs.digests(extra)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == [*[c for c in extra.columns if c != "n_runs"], *names]
    for r in got.collect():
        assert tuple(r[c] for c in names) == row_of(split(r.text)) and r.runs in ("s", "", "y", None)
    assert sorted((r.doc_id or -1, r["__n"] or -1) for r in got.collect()) == sorted((r.doc_id or -1, r["__n"] or -1) for r in awkward.collect())
    marked = period_runs.mark(awkward)
    assert all(r.n_words == len(split(r.text)) and [tuple(x) for x in r.runs] == brute(split(r.text)) for r in marked.collect())
    assert period_runs.digests(empty).count() == 0 and period_runs.mark(empty).count() == 0


def test_collapse(spark):
    loop = "so\tit " + "goes on and " * 9 + "stops"
    rows = [(1, loop, "x"), (2, "no  loop", "y"), (3, None, None), (4, "", "z")]
    got = {r.id: (r.text, r.n) for r in period_runs.collapse(spark.createDataFrame(rows, "id long, text string, n string")).collect()}
    assert got == {1: ("so it goes on and stops", "x"), 2: ("no  loop", "y"), 3: (None, None), 4: ("", "z")}


def test_long_text_in_reasonable_time():
    rng = random.Random(1)
    w = [str(rng.randrange(500)) for _ in range(30_000)]
    w[20_000:] = [w[20_000 + i % 1_700] for i in range(10_000)]
    assert (20_000, 10_000, 1_700) in [tuple(r) for r in period_runs.find_runs(w).tolist()] or brute(w) == [tuple(r) for r in period_runs.find_runs(w).tolist()]


def test_planted_runs_follow_their_rule(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 50 == 3 else " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 30, 90])))) for i in range(700)]
    got = {r.doc_id: split(r.text) for r in queries.with_planted_runs(spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string")).collect()}
    for i, text in [*rows, (None, "a b c")]:
        w, h = split(text), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n and i is not None:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        assert got[i] == w
