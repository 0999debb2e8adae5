"""Periodic runs of words: passages that repeat themselves at once, as loops in generated or scraped text.

A run is a stretch of consecutive words with smallest period q and at least max(least, 2 q) words that no neighbouring word extends.
Runs are found in each text by itself: a suffix tree of its words and one of their reversal (Ukkonen) give longest common
extensions to the right and to the left in constant time (lowest common ancestors over Euler tours). Every run holds a Lyndon root that is
the longest Lyndon word at its start, in one of two opposite orders of the words; so at each word the longest Lyndon word in either
order is a candidate period, and extending it both ways shows whether it is a run.

A run's words all lie in windows of least / 2 words that occur twice in the text (shifted by the period). What lies in no such window is
no part of a run, so the trees are built over the rest: each stretch between is one number of its own, which equals no other.

Memory is that of one text at a time; a worker keeps no state between texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import added
from tidemark.llm.suffix_tree import SuffixTree
from tidemark.llm.words import BASE, U64, first_of, mixed

#: A run has at least so many words.
LEAST = 12


def _lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    n, above, out = len(rank), [], np.empty(len(rank), np.int64)
    ranks = rank.tolist()
    for i in range(n - 1, -1, -1):
        while above and ranks[above[-1]] > ranks[i]:
            above.pop()
        out[i] = (above[-1] if above else n) - i
        above.append(i)
    return out


def _runs_of(sequence: list[int], least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(sequence)
    forward, backward = SuffixTree(sequence), SuffixTree(sequence[::-1])
    start = np.tile(np.arange(n), 2)
    period = np.concatenate([_lyndon_lengths(rank)[:n] for rank in (forward.rank, forward.rank_turned())])
    inside = start + period < n
    start, period = start[inside], period[inside]
    right = forward.common(start, start + period)
    left = np.zeros(len(start), np.int64)
    some = np.flatnonzero(start > 0)
    left[some] = backward.common(n - start[some], n - start[some] - period[some])
    length = left + period + right
    keep = length >= np.maximum(2 * period, least)
    return np.unique(np.stack([start - left, length, period], axis=1)[keep], axis=0)[:, [0, 1, 2]]


def _stretches(ids: np.ndarray, window: int) -> np.ndarray:
    """Flags of words in a window that occurs twice or more."""
    n = len(ids) - window + 1
    covered = np.zeros(len(ids), bool)
    if n < 2:
        return covered
    key, step = np.zeros(n, U64), mixed(ids.astype(U64) + U64(1))
    for k in range(window):
        key = key * BASE + step[k : k + n]
    order = np.argsort(key)
    same = ~first_of(key[order])
    again = np.zeros(n, bool)
    again[order[same]] = True
    again[order[np.flatnonzero(same) - 1]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return np.cumsum(edge)[:-1] > 0


def find_runs(words: list, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of a list of words, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < least:
        return none
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # the shorter half of a run of `least` words or more, less its period, has at least least - least // 2 words
    covered = _stretches(ids, max(1, least - least // 2))
    if not covered.any():
        return none
    place = np.flatnonzero(covered)
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    # one number for each gap; numbers of words come after those
    values = np.insert(ids[place] + 1 + len(gap), gap, np.arange(1, len(gap) + 1))
    place = np.insert(place, gap, -1)
    # numbers without holes keep the tree's keys small
    _, values = np.unique(values, return_inverse=True)
    found = _runs_of((values + 1).tolist(), least)
    found[:, 0] = place[found[:, 0]]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


RUN = "array<struct<start: long, length: long, period: long>>"


def _batches(docs: DataFrame, text: str, least: int, columns: dict[str, str], of_text, drop: tuple[str, ...]) -> DataFrame:
    def factory():
        def make(batch):
            rows = []
            for raw in batch.column(text).cast(pa.large_binary()).to_pylist():
                # bytes.split() cuts at \x20 and \x09-\x0D
                words = (raw or b"").split()
                rows.append(of_text(raw, words, find_runs(words, least)))
            kinds = {"long": pa.int64(), "string": pa.string(), RUN: pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))}
            return {c: pa.array([r[k] for r in rows], kinds[t]) for k, (c, t) in enumerate(columns.items())}

        return make

    return added(docs, factory, columns, drop)


def mark(docs: DataFrame, text: str = "text", least: int = LEAST, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) in words, by start, then period, and `n_words`.

    Words are runs of characters other than \\x20 and \\x09-\\x0D, compared byte by byte. Null, empty and blank texts have no words and no
    runs. Texts of any length are worked on whole. Rows are independent: repeated rows get the same result, ids don't matter.
    Columns of docs stay (but for `drop`); ones named `runs` or `n_words` are replaced. An empty table stays empty.
    """
    as_rows = lambda raw, words, runs: ([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], len(words))
    return _batches(docs, text, least, {"runs": RUN, "n_words": "long"}, as_rows, drop)


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with each run cut to its first period. Texts without a run stay as they are; others have their kept words joined by one space.

    Nulls stay null. All columns of docs stay, the text in the last place.
    """

    def cut(raw, words, runs):
        if raw is None or not len(runs):
            return (None if raw is None else raw.decode(),)
        return (b" ".join(w for w, k in zip(words, kept_words(len(words), runs)) if k).decode(),)

    return _batches(docs, text, least, {text: "string"}, cut, ())


def digests(docs: DataFrame, text: str = "text", least: int = LEAST, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_runs, the longest run's start, length, period and exponent_milli (ties: smallest start, then period; no run: null), and
    sha256 of all runs (`start,length,period` and a line feed each) and of the words that stay, joined by one space. Rows as in `mark`."""

    def row(raw, words, runs):
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
        best = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2])) if len(runs) else (None, None, None)
        left = [w for w, k in zip(words, kept_words(len(words), runs)) if k] if len(runs) else words
        return (len(runs), *best, 1000 * best[1] // best[2] if len(runs) else None,
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())

    columns = dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "long") | dict.fromkeys(("runs_sha256", "collapsed_sha256"), "string")
    return _batches(docs, text, least, columns, row, drop)
