"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is the documents of a slice of an Arrow batch. Words that no benchmark item has cannot be
part of an occurrence, so the index holds only runs of benchmark words that are long enough for a window;
all other words are separators. Windows are searched backward through the wavelet ranks, located by
the sampled positions, and their spans merged. Words count as equal if their 64-bit hashes are.

The benchmark is taken in blocks of BLOCK_BYTES, which bounds what is sent to the tasks at any size of
the benchmark; each further block is one more pass over the batches in the same tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fm_index import ShardIndex
from tidemark.llm.shared import added
from tidemark.llm.words import ALNUM, buffers, first_of, slices, words

WINDOW = 10
BLOCK_BYTES = 8_000_000


class Windows:
    """Distinct windows of a block of items, over symbols 1..top for the words that occur in them."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        data, offsets = buffers(pa.array(texts, pa.string()))
        w = words(data, offsets, ALNUM, lower=True)
        hashes, bounds = w.hashes(), np.searchsorted(w.doc, np.arange(len(ids) + 1))
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        found: dict[tuple, set[str]] = {}
        for i, item in enumerate(ids):
            own = (symbols[bounds[i] : bounds[i + 1]] + 1).tolist()
            for k in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[k : k + width]), set()).add(item)
        self.items = sorted({x for s in found.values() for x in s})
        number = {x: k for k, x in enumerate(self.items)}
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.patterns = np.array([(0,) * (width - len(x)) + x for x in found], np.int64).reshape(len(found), width)
        self.owners = np.concatenate([np.array(sorted(number[x] for x in s), np.int64) for s in found.values()]) if found else np.zeros(0, np.int64)
        self.owner_at = np.cumsum([0, *(len(s) for s in found.values())])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for words that no window has."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out

    def occurrences(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every occurrence in one shard."""
        none = np.zeros(0, np.int64)
        if not len(self.patterns) or not len(hashes):
            return none, none
        symbols = self.symbols(hashes)
        inside = symbols > 0
        new = first_of(doc)
        begin = inside & (np.r_[True, ~inside[:-1]] | new)
        last = inside & np.r_[~inside[1:] | new[1:], True]
        begin, last = np.flatnonzero(begin), np.flatnonzero(last)
        long = last - begin + 1 >= self.lengths.min()
        begin, last = begin[long], last[long]
        if not len(begin):
            return none, none
        sizes = last - begin + 2
        total = int(sizes.sum())
        run_at = np.cumsum(sizes) - sizes
        word = np.repeat(begin - run_at, sizes) + np.arange(total)
        text = np.zeros(total, np.int64)
        is_word = np.ones(total, bool)
        is_word[run_at + sizes - 1] = False
        text[is_word] = symbols[word[is_word]]
        index = ShardIndex(text, len(self.vocabulary))
        low, high = index.search(self.patterns, self.lengths)
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return word[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def _marker(found: Windows, text: str):
    """For a record batch: its words, the merged spans of hit words and the items found, added to those of earlier blocks."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = buffers(batch.column(text))
        n_words, spans, items = [], [], []
        earlier = batch.column("__spans").to_pylist() if "__spans" in batch.schema.names else [None] * batch.num_rows
        held = batch.column("__items").to_pylist() if "__items" in batch.schema.names else [None] * batch.num_rows
        for first, last in slices(offsets):
            w = words(data, offsets[first : last + 1], ALNUM, lower=True)
            start, window = found.occurrences(w.hashes(), w.doc)
            bounds = np.searchsorted(w.doc, np.arange(last - first + 1))
            n_words.append(np.diff(bounds))
            edges = np.zeros(len(w.doc) + 1, np.int64)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + found.lengths[window], -1)
            hit = np.cumsum(edges[:-1]) > 0
            owner_n = np.diff(found.owner_at)[window]
            pairs = np.unique(np.stack([np.repeat(w.doc[start], owner_n), found.owners[np.concatenate([np.arange(found.owner_at[k], found.owner_at[k + 1]) for k in window])]]), axis=1) if len(window) else np.zeros((2, 0), np.int64)
            at = np.searchsorted(pairs[0], np.arange(last - first + 1))
            for d in range(last - first):
                old, had = earlier[first + d] or [], held[first + d] or []
                if at[d] == at[d + 1]:
                    spans.append(old)
                    items.append(had)
                    continue
                own = hit[bounds[d] : bounds[d + 1]].copy()
                for s in old:
                    own[s["first"] : s["end"]] = True
                edge = np.diff(np.r_[0, own.astype(np.int8), 0])
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                items.append(sorted({*had, *(found.items[k] for k in pairs[1, at[d] : at[d + 1]])}))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return {"__n_words": pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()), "__spans": pa.array(spans, kind), "__items": pa.array(items, pa.list_(pa.string()))}

    return make


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES):
    """The benchmark's (id as string, text) in blocks of about block_bytes of text, dealt by a hash of the id."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield [r.id for r in block], [r.text for r in block]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with __n_words, __spans (merged [first, end) word ranges that benchmark windows cover) and __items (ids found).

    A window is `width` consecutive words of an item, or all words of a shorter item. Null and empty texts
    have no words and no hits; items without words have no windows; items of equal id are one item, null ids
    the item "". One row per row of docs. Nothing is shuffled.
    """
    blocks = [Windows(ids, texts, width) for ids, texts in blocks_of(benchmark, item_id, item_text)]
    new = {"__n_words": "long", "__spans": "array<struct<first:long,end:long>>", "__items": "array<string>"}
    for k, found in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(found)
        docs = _pass(docs, sent, text, new, drop if k == len(blocks) - 1 else ())
    return docs


def _pass(docs: DataFrame, sent, text: str, new: dict[str, str], drop: tuple[str, ...]) -> DataFrame:
    return added(docs, lambda: _marker(sent.value, text), new, drop)


def without_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of docs in which no benchmark window occurs; columns of docs."""
    return mark(docs, benchmark, **options).where(F.size("__items") == 0).drop("__n_words", "__spans", "__items")


def cut_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the hit spans cut out of the text, from the first byte of a span's first word to the last of its last word."""
    marked = mark(docs, benchmark, text=text, **options)

    def factory():
        def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist()):
                if spans:
                    raw = value.encode()
                    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, lower=True)
                    keep, at = [], 0
                    for s in spans:
                        keep.append(raw[at : w.start[s["first"]]])
                        at = w.end[s["end"] - 1]
                    value = b"".join([*keep, raw[at:]]).decode()
                out.append(value)
            return {text: pa.array(out, pa.string())}

        return make

    return added(marked, factory, {text: "string"}, drop=("__n_words", "__spans", "__items")).select(*[F.col(f"`{c}`") for c in docs.columns])

