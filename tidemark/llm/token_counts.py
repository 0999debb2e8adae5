"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton finds all vocabulary pieces in a text; dynamic programming over the
matches carries the best score and the number of pieces to each position, and no back pointers. Ties fall as in the
public `tokenizers` Unigram model: scores are added from the left in double precision, and a later candidate must be
better, so that of equal ones the earliest start (the longest piece) stays.

Texts are cut before each space (the marker `▁`, prepended once if the text does not begin with one) as the Metaspace
pre-tokenizer does, so each distinct unit is counted once per task and the units of a slice advance together.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.shared import added
from tidemark.llm.words import Words, buffers, first_of, slices

MARK = "▁"
UNK_PENALTY = 10.0
#: Units whose counts a task remembers, 12 bytes each; all are forgotten beyond that.
REMEMBERED = 4_000_000
#: Longer units are worked through one by one.
LONG = 64
#: Characters of units that are searched at a time.
CHUNK = 1_000_000


@dataclass
class Vocabulary:
    """Pieces and scores in id order, with the id of the unknown piece. A character that no piece has alone is unknown; with byte
    fallback it counts as its UTF-8 bytes if all 256 byte pieces are there, else a run of such characters counts as one."""

    pieces: list[str]
    scores: list[float]
    unk_id: int = 0
    byte_fallback: bool = True


def from_sentencepiece(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file, to be used as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return Vocabulary([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], model.unk_id())


class Counter:
    """Counts of the pieces of units, for one task."""

    def __init__(self, v: Vocabulary):
        ids: dict[str, int] = {}
        for i, piece in enumerate(v.pieces):
            ids[piece] = i  # of equal pieces the last one counts, as in the library
        self.length = np.array([len(x) for x in v.pieces], np.int64)
        self.score = np.array(v.scores, float)
        self.unk_score = float(self.score.min()) - UNK_PENALTY
        self.unk_id, self.unk_bytes = v.unk_id, len(v.pieces[v.unk_id].encode())
        self.bytes = v.byte_fallback and all(f"<0x{b:02X}>" in ids for b in range(256))
        self.alone = np.zeros(0x110000, bool)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in ids.items():
            if piece:
                self.automaton.add_word(piece, i)
                if len(piece) == 1:
                    self.alone[ord(piece)] = True
        self.automaton.make_automaton()
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def units(self, units: list[str]) -> np.ndarray:
        """Number of pieces of each unit. A unit holds no NUL."""
        out, at = np.zeros(len(units), np.int64), 0
        sizes = np.cumsum([len(x) + 1 for x in units]) if units else np.zeros(0, np.int64)
        while at < len(units):
            end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")), at + 1)
            out[at:end] = self._chunk(units[at:end])
            at = end
        return out

    def _chunk(self, units: list[str]) -> np.ndarray:
        text = "\0".join(units) + "\0"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        size = np.array([len(x) for x in units], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        lone = np.flatnonzero(~self.alone[code] & (code != 0))
        # matches in order of their end, of equal ends the earliest start first
        end = np.concatenate([found[:, 0], lone]) + 1
        length = np.concatenate([self.length[found[:, 1]], np.ones(len(lone), np.int64)])
        score = np.concatenate([self.score[found[:, 1]], np.full(len(lone), self.unk_score)])
        width = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        # the unknown piece's own text, if it stands in a text, joins a run of unknown characters
        named = found[:, 1] == self.unk_id
        pieces = np.concatenate([np.where(named, self.unk_bytes, 1), width[lone]])
        unknown, named = np.concatenate([named, np.ones(len(lone), bool)]), np.concatenate([named, np.zeros(len(lone), bool)])
        unit = np.searchsorted(begin, end - 1, "right") - 1
        local = end - begin[unit]
        short = size[unit] <= LONG
        order = np.argsort(np.where(short, local, LONG + 1) * (len(text) + 1) + end, kind="stable")
        end, length, score, pieces, unknown, named, local, short = (x[order] for x in (end, length, score, pieces, unknown, named, local, short))
        best, count, after_unk = np.full(len(text) + 1, -np.inf), np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, bool)
        owed = np.zeros(len(text) + 1, np.int64)  # what a lone unknown piece costs more if its run goes on
        best[begin] = 0.0
        edges = np.searchsorted(np.where(short, local, LONG + 1), np.arange(1, LONG + 3))
        for k in range(LONG):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            to, start = end[a:b], end[a:b] - length[a:b]
            value = best[start] + score[a:b]
            group = np.flatnonzero(first_of(to))
            top = np.maximum.reduceat(value, group)
            which = np.where(value == np.repeat(top, np.diff(np.r_[group, b - a])), np.arange(b - a), b - a)
            chosen = np.minimum.reduceat(which, group)
            target, origin = to[group], start[chosen]
            best[target] = top
            unk, begins, cost = unknown[a:b][chosen], named[a:b][chosen] & ~after_unk[origin], pieces[a:b][chosen]
            if self.bytes:
                more = np.where(unk, np.where(begins, 1, cost + owed[origin]), 1)
                owed[target] = np.where(begins, cost - 1, 0)
            else:
                more = np.where(unk, ~after_unk[origin], 1)
            count[target] = count[origin] + more
            after_unk[target] = unk
        for k in range(edges[LONG], len(end)):
            to, origin = end[k], end[k] - length[k]
            value = best[origin] + score[k]
            if value > best[to]:
                best[to] = value
                begins = named[k] and not after_unk[origin]
                more = 1 if not unknown[k] else int(not after_unk[origin]) if not self.bytes else 1 if begins else pieces[k] + owed[origin]
                owed[to] = pieces[k] - 1 if begins else 0
                count[to], after_unk[to] = count[origin] + more, unknown[k]
        return count[begin + size]

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document of a slice."""
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        n_docs, filled = len(offsets) - 1, offsets[:-1] < offsets[1:]
        # a unit begins at each space, and at the first byte of a text that doesn't begin with one
        first = offsets[:-1][filled]
        key = np.sort(np.concatenate([np.flatnonzero(data == 0x20), first[data[first] != 0x20]]))
        doc = np.searchsorted(offsets, key, "right") - 1
        start, end = key + (data[key] == 0x20), np.minimum(np.r_[key[1:], len(data)], offsets[doc + 1])
        w = Words(data, offsets, start, end, doc, n_docs, np.zeros(0, bool))
        unique, at, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        if len(self.known):
            old = self.known[np.minimum(where, len(self.known) - 1)] == unique
        counts = np.zeros(len(unique), np.int64)
        counts[old] = self.counts[where[old]]
        new = np.flatnonzero(~old)
        if len(new):
            raw = data.tobytes()
            counts[new] = self.units([MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.counts = unique[new], counts[new]
            else:
                self.known, self.counts = np.insert(self.known, where[new], unique[new]), np.insert(self.counts, where[new], counts[new])
        return np.bincount(doc, counts[inverse], n_docs).astype(np.int64)


def _stand_in(v: Vocabulary) -> str:
    """An unknown character of one byte, to be counted in place of NUL, which separates units here."""
    used = set("".join(v.pieces))
    free = [c for c in map(chr, range(1, 0x80)) if c not in used and c != " "]
    if "\0" in used or not free:
        raise ValueError("the vocabulary must leave NUL and another ASCII character free")
    return free[0]


def _clean(column: pa.Array, stand_in: str) -> pa.Array:
    """Spaces for markers, and the stand-in for NUL."""
    return pc.replace_substring(pc.replace_substring(column, MARK, " "), "\0", stand_in)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", column: str = "n_tokens", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the number of tokens of each text; 0 for null and empty texts. One row per row of docs, no shuffle; a column of docs
    that has the name of the new one is replaced."""
    stand_in = _stand_in(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def factory():
        counter = Counter(sent.value)

        def make(batch):
            data, offsets = buffers(_clean(batch.column(text), stand_in))
            parts = [counter.slice(data, offsets[a : b + 1]) for a, b in slices(offsets)]
            return {column: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())}

        return make

    return added(docs, factory, {column: "long"}, drop)
