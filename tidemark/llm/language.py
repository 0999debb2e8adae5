"""Language identification as a mixture: each document's language proportions by expectation-maximisation.

A language is a distribution of byte trigrams around each letter, learned from labelled documents. The words
of a document are draws from a mixture of languages. EM over all languages orders them; then the set
grows by the next language in that order while the penalised likelihood (half a log of the number of words per
free proportion) gets better. The prediction is the language of the largest proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import added
from tidemark.llm.words import buffers, first_of, slices

BUCKETS = 1 << 16
ROUNDS = 12
SMOOTHING = 0.5
#: Languages whose counts a task holds before it passes them on.
HELD = 64
UNKNOWN = "und"

LETTER = np.zeros(256, np.uint8)
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B]
LETTER[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letter bytes, the index of each word's first one, and each word's document.

    Words are runs of letters; A-Z and the Latin capitals of two bytes are lower-cased; all other ASCII counts as a gap.
    """
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    n = len(data)
    codes = LETTER[data]
    capital = np.zeros(n, bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    codes[capital] += 0x20
    filled = offsets[:-1] < offsets[1:]
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    before[offsets[:-1][filled]] = 0
    after[offsets[1:][filled] - 1] = 0
    at = np.flatnonzero(codes)
    value = (before[at] << np.uint32(16)) | (codes[at].astype(np.uint32) << np.uint32(8)) | after[at]
    start = np.flatnonzero(before[at] == 0)
    bucket = (value * np.uint32(2654435761)) >> np.uint32(16)
    return bucket.astype(np.int64), start, np.searchsorted(offsets, at[start], "right") - 1


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all documents with a language; summed in each task before the shuffle."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for name in sorted(held):
                at = np.flatnonzero(held[name])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[name][at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            names = batch.column("lang").dictionary_encode()
            code, values = names.indices.to_numpy(), names.dictionary.to_pylist()
            for a, b in slices(offsets):
                bucket, start, doc = trigrams(data, offsets[a : b + 1])
                of = np.repeat(code[a + doc], np.diff(np.r_[start, len(bucket)]))
                for k in np.unique(of):
                    held.setdefault(values[k], np.zeros(BUCKETS, np.int64))
                    held[values[k]] += np.bincount(bucket[of == k], minlength=BUCKETS)
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    names: list[str]
    #: log P(bucket | language), one row per bucket
    log_p: np.ndarray

    @classmethod
    def of(cls, counts: pd.DataFrame) -> Languages:
        names = sorted(set(counts["lang"]))
        table = np.full((len(names), BUCKETS), SMOOTHING)
        table[[names.index(x) for x in counts["lang"]], counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
        return cls(names, np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)))

    def word_likelihoods(self, bucket: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods of words relative to each word's best language, and the log of that best one."""
        if not len(start) or not self.names:
            return np.zeros((len(start), len(self.names))), np.zeros(len(start))
        log = np.stack([np.add.reduceat(self.log_p[:, k][bucket], start, dtype=np.float64) for k in range(len(self.names))], axis=1)
        best = log.max(axis=1)
        return np.exp(log - best[:, None]), best


def proportions(like: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions of the allowed languages and log-likelihood, one row per document.

    Words stand in document order; every document has words.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    at = np.flatnonzero(first_of(doc))
    n = np.diff(np.r_[at, len(doc)])[:, None]
    tiny = 1e-300
    for _ in range(rounds):
        part = like * share[doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), tiny)
        share = np.add.reduceat(part, at, axis=0) / n
    fit = np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(axis=1), tiny)), at)
    return share, fit


def infer(like: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Proportions (n_docs, languages) under the selected language sets; rows of documents without words are 0."""
    k = like.shape[1]
    out = np.zeros((n_docs, k))
    if not len(doc) or not k:
        return out
    has, doc = np.unique(doc, return_inverse=True)
    m = len(has)
    full, _ = proportions(like, doc, m, np.ones((m, k)))
    order = np.argsort(-full, axis=1, kind="stable")
    at = np.flatnonzero(first_of(doc))
    n_words = np.diff(np.r_[at, len(doc)])
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), at, axis=0)
    best = np.argmax(single, axis=1)
    score = single[np.arange(m), best]
    share = np.zeros((m, k))
    share[np.arange(m), best] = 1
    open_ = np.arange(m)
    for size in range(2, k + 1):
        inside = np.zeros(m, bool)
        inside[open_] = True
        words = inside[doc]
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :size], 1, axis=1)
        number = np.cumsum(inside) - 1
        got, fit = proportions(like[words], number[doc[words]], len(open_), allowed)
        fit = fit - 0.5 * (size - 1) * np.log(n_words[open_])
        better = fit > score[open_]
        open_, got, fit = open_[better], got[better], fit[better]
        share[open_], score[open_] = got, fit
        if not len(open_):
            break
    out[has] = share
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Trigram models of all languages of docs. The driver gets at most BUCKETS numbers per language."""
    return Languages.of(trigram_counts(docs, text, lang).toPandas())


def identify(docs: DataFrame, model: Languages, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred, score (its proportion, 0 to 1) and lang_shares (language to proportion, of the selected set).

    Texts that are null, or have no letter, or of which no language is known, get `und`, 0 and an empty map. One row per row
    of docs; columns of docs with the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = sent.value

        def make(batch):
            data, offsets = buffers(batch.column(text))
            shares = [np.zeros((0, len(model.names)))]
            for a, b in slices(offsets):
                bucket, start, doc = trigrams(data, offsets[a : b + 1])
                like, _ = model.word_likelihoods(bucket, start)
                shares.append(infer(like, doc, b - a))
            share = np.concatenate(shares)
            known = share.sum(axis=1) > 0 if share.shape[1] else np.zeros(len(share), bool)
            plain = sums_of_ascii_letters(data, offsets) > 0
            for i in np.flatnonzero(known & ~plain):  # only other characters than ASCII: is one a letter?
                known[i] = any(c.isalpha() for c in batch.column(text)[i].as_py())
            best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(share), int)
            pred = [model.names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            score = np.where(known, share[np.arange(len(share)), best] if share.shape[1] else 0.0, 0.0)
            maps = [[(model.names[k], float(s[k])) for k in np.flatnonzero(s)] if ok else [] for s, ok in zip(share, known)]
            return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.minimum(score, 1.0)), "lang_shares": pa.array(maps, pa.map_(pa.string(), pa.float64()))}

        return make

    return added(docs, factory, {"lang_pred": "string", "score": "double", "lang_shares": "map<string,double>"}, drop)


def sums_of_ascii_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(offsets[-1] - offsets[0] + 1, np.int64)
    part = data[offsets[0] : offsets[-1]]
    np.cumsum((LETTER[part] > 0) & (part < 0x80), out=total[1:])
    return total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]


def held_out(doc_id: Column) -> Column:
    """Documents that a model must not learn from: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
