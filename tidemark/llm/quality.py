"""Quality rules: base rules and boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Forest, fit
from tidemark.llm.shared import added
from tidemark.llm.words import buffers, first_of, mixed, slices, sums, windows, words

#: Bound of the labelled rows that the trees are fitted on: those of the smallest hashes of their ids.
TRAIN_ROWS = 20_000
LEAST_WORDS = 10
MOST_REPEATED = 20
KEEP = 0.5

#: Features and how the quality may depend on them: -1 never rises with the feature, 0 is free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "repeated_words": -1, "repeated_lines": -1, "upper": -1, "pipes": -1,
            "marks": 0, "digits": 0, "distinct_words": 0, "line_words": 0, "letters": 0}

SYMBOL, UPPER, MARK, DIGIT, PIPE, OTHER = 1, 2, 4, 8, 16, 32
CLASS = np.zeros(256, np.uint8)
for _b in b"#*$%&|<>":
    CLASS[_b] |= SYMBOL
CLASS[0x41:0x5B] |= UPPER
for _b in b"!?;:":
    CLASS[_b] |= MARK
CLASS[0x30:0x3A] |= DIGIT
CLASS[ord("|")] |= PIPE
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] |= OTHER


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of whole documents, one number each; texts without words have zeros."""
    w = words(data, offsets)
    data, offsets = w.data, w.offsets
    n_docs, kinds = w.n_docs, CLASS[data]
    n_words = w.per_doc()
    out = {"n_words": n_words, "word_chars": sums(w.mask & ((data & 0xC0) != 0x80), offsets)}
    for name, bit in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_marks", MARK), ("n_digits", DIGIT), ("n_pipes", PIPE), ("n_letters", OTHER)):
        out[name] = sums((kinds & bit) > 0, offsets)
    hashes = w.hashes()
    # 5-word windows found twice or more in one text, first included
    total, first = windows(hashes, w.doc, 5)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    key = total ^ mixed(w.doc[first].astype(np.uint64))
    order = np.argsort(key)
    new = first_of(key[order])
    twice = first[order[~new | ~np.r_[new[1:], True]]]
    np.add.at(repeated, twice, 1)
    np.add.at(repeated, twice + 5, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n_docs)
    out["n_distinct"] = np.bincount(_firsts(hashes, w.doc), minlength=n_docs)
    # lines with a word that equal an earlier line
    breaks = np.flatnonzero(data == 0x0A)
    filled = offsets[:-1] < offsets[1:]
    begin = np.union1d(breaks + 1, offsets[:-1][filled])
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.r_[begin[1:], len(data)], offsets[doc + 1])
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 0x0A))
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, doc = begin[has_word], end[has_word], doc[has_word]
    n_lines = np.bincount(doc, minlength=n_docs)
    out["n_lines"] = n_lines
    out["n_dup_lines"] = n_lines - np.bincount(_firsts(w.spans(begin, end), doc), minlength=n_docs)
    return out


def _firsts(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The documents of the distinct (hash, document) pairs."""
    key = hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    return doc[order[first_of(key[order])]]


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    n, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / chars, s["n_repeat_words"] / n, s["n_dup_lines"] / lines, s["n_upper"] / chars,
                     s["n_pipes"] / n, s["n_marks"] / chars, s["n_digits"] / chars, s["n_distinct"] / n, s["n_words"] / lines, s["n_letters"] / chars], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _of_batch(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    data, offsets = buffers(batch.column(text))
    parts = [statistics(data, offsets[a : b + 1]) for a, b in slices(offsets)] or [statistics(data[:0], offsets[:1])]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Trees for P(quality = 1) from at most `rows` labelled rows. Rows with a null label or id are no labels."""
    sample = labels.select(F.col(doc_id).alias("__id"), F.col(quality).alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    sample = sample.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    # rows with at most two numbers each: its size is bounded by `rows`
    labelled = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), "__id").select("__y", "__text")

    def factory():
        return lambda batch: {"x": pa.array(list(features(_of_batch(batch, "__text"))), pa.list_(pa.float64()))}

    got = added(labelled, factory, {"x": "array<double>"}, drop=("__text",)).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("__y").to_pylist(), float)
    order = np.lexsort([*x.T, y])  # rows come back in any order
    return fit(x[order], y[order], np.array(list(FEATURES.values())))


def score(docs: DataFrame, forest: Forest, text: str = "text", keep: float = KEEP, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality and kept.

    kept: the base rules hold and P(quality = 1) is at least `keep`. Null and empty texts have no words and fail the
    base rules. One row per row of docs; columns of docs with the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def factory():
        forest = sent.value

        def make(batch):
            s = _of_batch(batch, text)
            failed, p = base_failed(s), forest.probability(features(s))
            return {k: pa.array(s[k], pa.int64()) for k in COUNTS} | {"base_failed": pa.array(failed), "quality": pa.array(p), "kept": pa.array(~failed & (p >= keep))}

        return make

    return added(docs, factory, dict.fromkeys(COUNTS, "long") | {"base_failed": "boolean", "quality": "double", "kept": "boolean"}, drop)
