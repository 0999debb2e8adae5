"""Packing token ids into sequences of a fixed length, online and in bounded space.

Each task keeps a fixed number of open windows. What a document has beyond whole sequences goes into the open window where it fits best. When
it fits in none, the fullest window is filled up with the document's next ids and emitted, so that no place is lost, and the rest starts a
window of its own. At its end a task joins its open windows; what is left, less than a sequence, is merged with that of other tasks, some
hundred at a time, until one is left. That one is cut into sequences whose lengths are powers of two, which need no padding.

A task holds its windows, a document's ids and the ids of the words it has met (forgotten beyond REMEMBERED); a merging task
holds one sequence of each of FAN_IN tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.shared import written

LENGTH = 2048
#: Windows that a task keeps open.
OPEN = 32
#: Distinct words whose ids a task remembers.
REMEMBERED = 1_000_000
#: Bytes of a document that are tokenised at a time.
SEGMENT = 1_000_000
#: Tasks whose leftovers are merged in one.
FAN_IN = 256
#: Rows of an output batch.
ROWS = 5_000

_LAST_SPACE = re.compile(rb"[\x20\x09-\x0D](?=[^\x20\x09-\x0D]*\Z)")


class _Known(dict):
    """Numbers of words in order of their first occurrence; new ones are noted."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)}


#: Latin letters that are in normal form and whose lower case is one letter.
_LETTERS = "a-z" + "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and len(c.lower()) == 1)
#: Words in which the pre-tokenizer cuts between letters, single digits and the rest alone (an apostrophe may begin a token of its own).
_PLAIN = re.compile(f"[{_LETTERS}0-9!-&(-/:-@\\[-`{{-~]+")
_TOKENS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordEncoder:
    """Ids of texts by a tokenizer of the `tokenizers` library that lower-cases, ignores white space and never joins characters across it.

    Texts are cut at \\x20 and \\x09-\\x0D and each distinct piece is encoded once: plain words by the library's model on their tokens, others
    by its whole pipeline. Strings of special tokens are ordinary text.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known, self.tokens, self.at, self.size, self.ids = _Known(), {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32)
        self.n_known, self.filled = 0, 0

    def _token(self, token: str) -> tuple[int, ...]:
        found = self.tokens.get(token)
        if found is None:
            text = token if token.isascii() else "".join(map(self.letters.__getitem__, token.encode()))
            # a tuple of numbers is no work for the garbage collector
            self.tokens[token] = found = tuple([x.id for x in self.model.tokenize(text)])
        return found

    def _learn(self) -> None:
        got, rest = [], []
        for word in self.known.new:
            word = word.decode()
            if _PLAIN.fullmatch(word):
                got.append([i for token in _TOKENS.findall(word.lower()) for i in self._token(token)])
            else:
                rest.append((len(got), word))
                got.append([])
        for (k, _), e in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False)):
            got[k] = e.ids
        self.known.new = []
        size = np.fromiter(map(len, got), np.int64, len(got))
        total, n = int(size.sum()), self.n_known + len(got)
        if self.filled + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + total, np.int32)])
        if n > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.at, self.size))
        self.ids[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(got), np.int32, total)
        self.at[self.n_known : n] = self.filled + np.cumsum(size) - size
        self.size[self.n_known : n] = size
        self.n_known, self.filled = n, self.filled + total

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each text's."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [t.lower().split() for t in texts]
        counts = np.cumsum([0, *map(len, words)])
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(counts[-1]))
        if self.known.new:
            self._learn()
        size = self.size[row]
        ends = np.zeros(len(row) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.ids[np.repeat(self.at[row] - ends[:-1], size) + np.arange(int(ends[-1]))], ends[counts]

    def encode_all(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, worked on SEGMENT bytes at a time."""
        held, size = [], 0
        for k, raw in enumerate(texts):
            if len(raw) <= SEGMENT:
                held.append(raw)
                size += len(raw)
            if held and (size >= SEGMENT or len(raw) > SEGMENT or k == len(texts) - 1):
                ids, bounds = self._words(held)
                yield from (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
                held, size = [], 0
            if len(raw) > SEGMENT:
                yield self._long(raw)

    def _long(self, raw: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(raw):
            end = min(at + SEGMENT, len(raw))
            if end < len(raw):
                space = _LAST_SPACE.search(raw[at:end])
                # a word longer than a segment is taken whole
                end = at + space.end() if space else end + re.search(rb"[^\x20\x09-\x0D]*", raw[end:]).end()
            parts.append(self._words([raw[at:end]])[0])
            at = end
        return np.concatenate(parts)


class Packer:
    """Open windows of one task. Emits (sequence, pieces), a piece being (document, its first id, ids, number of the document's ids)."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN):
        self.length, self.windows = length, windows
        self.open: list[list] = []
        self.used: list[int] = []

    def _start(self, piece) -> None:
        self.open.append([self._held(*piece)])
        self.used.append(len(piece[2]))

    @staticmethod
    def _held(document, at, ids, n) -> tuple:
        # a copy, so that a window does not hold the ids of all documents that were encoded with this one
        return document, at, ids.copy(), n

    def _close(self, k: int) -> list:
        self.used.pop(k)
        return self.open.pop(k)

    def add(self, document, ids: np.ndarray) -> Iterator[list]:
        n, at = len(ids), 0
        while n - at >= self.length:
            yield [(document, at, ids[at : at + self.length], n)]
            at += self.length
        if at == n:
            return
        need = n - at
        fits = [u for u in self.used if u + need <= self.length]
        if fits:
            k = self.used.index(max(fits))
            self.open[k].append(self._held(document, at, ids[at:], n))
            self.used[k] += need
            if self.used[k] == self.length:
                yield self._close(k)
        elif len(self.open) < self.windows:
            self._start((document, at, ids[at:], n))
        else:
            k = self.used.index(max(self.used))
            room = self.length - self.used[k]
            self.open[k].append((document, at, ids[at : at + room], n))
            yield self._close(k)
            self._start((document, at + room, ids[at + room :], n))

    def rest(self) -> list:
        """Pieces of all open windows, fullest first."""
        order = sorted(range(len(self.open)), key=lambda k: -self.used[k])
        return [p for k in order for p in self.open[k]]


def cut(pieces: list, lengths) -> Iterator[list]:
    """Sequences of the given lengths from pieces in their order; the last one is what is left and may be empty."""
    queue = list(reversed(pieces))
    for length in lengths:
        taken, room = [], length
        while room:
            document, at, ids, n = queue.pop()
            if len(ids) > room:
                queue.append((document, at + room, ids[room:], n))
                ids = ids[:room]
            taken.append((document, at, ids, n))
            room -= len(ids)
        yield taken
    yield queue[::-1]


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _fields(kind: str) -> str:
    return f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long, place int"


class _Rows:
    """Output rows, collected to batches. Rows without a sequence are a task's leftover."""

    def __init__(self, arrow_type, with_ids: bool):
        self.kind, self.with_ids, self.rows = arrow_type, with_ids, []

    def sequence(self, pieces, sequence_id) -> None:
        offset = 0
        for document, at, ids, n in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            self.rows.append((document, at, len(ids), zlib.crc32(raw), n, sequence_id, offset, raw if self.with_ids else None, None, None))
            offset += len(ids)

    def leftover(self, pieces, task: int) -> None:
        for k, (document, at, ids, n) in enumerate(pieces):
            self.rows.append((document, at, len(ids), 0, n, None, None, np.ascontiguousarray(ids, "<u4").tobytes(), task, k))

    def batch(self):
        longs = [pa.int64()] * 6
        kinds = [self.kind, *longs, pa.binary(), pa.int64(), pa.int32()]
        names = [x.split()[0] for x in _fields("x").split(", ")]
        columns = zip(*self.rows) if self.rows else [[]] * len(names)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        self.rows = []
        return out


def _number(round_: int, task: int, k: int) -> int:
    """Unique over rounds, tasks (up to 2 ** 24) and sequences of a task (up to 2 ** 32)."""
    return round_ << 56 | task << 32 | k


def pack(docs: DataFrame, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Each document's ids with the end id after them lie in exactly one piece each; pieces fill a sequence without gaps. All sequences have
    `length` ids but for the last few, whose lengths are powers of two. `ids` are little-endian unsigned 32-bit numbers (null without
    with_ids), ids_crc32 is their checksum. Null and empty texts have the end id alone; repeated rows and null ids are documents of their own;
    very long texts span sequences. An empty table gives no rows. Other columns of docs are left out.
    """
    kind = docs.schema[doc_id].dataType
    arrow, ddl = to_arrow_type(kind), kind.simpleString()

    def run(batches):
        encoder, packer, rows = WordEncoder(tokenizer_json), Packer(length), _Rows(arrow, with_ids)
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [raw or b"" for raw in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for document, ids in zip(batch.column("id").to_pylist(), encoder.encode_all(texts)):
                ids = np.append(ids, np.int32(end))
                for pieces in packer.add(document, ids):
                    rows.sequence(pieces, _number(0, task, k))
                    k += 1
                if len(rows.rows) >= ROWS:
                    yield rows.batch()
        rest = packer.rest()
        total = sum(len(p[2]) for p in rest)
        *full, left = cut(rest, [length] * (total // length))
        for pieces in full:
            rows.sequence(pieces, _number(0, task, k))
            k += 1
        rows.leftover(left, task)
        yield rows.batch()

    # written whole by each task: its sequences and its leftover are of the same attempt
    done = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, _fields(ddl)), "packed")
    out = done.where("sequence_id IS NOT NULL")
    left = done.where("sequence_id IS NULL")
    last = left.agg(F.max("task")).first()[0]
    round_ = 0
    while last is not None:
        round_, last = round_ + 1, last // FAN_IN
        done = written(_merged(left, round_, arrow, ddl, length, with_ids, final=last == 0), "packed")
        out, left = out.unionByName(done.where("sequence_id IS NOT NULL")), done.where("sequence_id IS NULL")
        if last == 0:
            break
    return out.drop("task", "place")


def _merged(left: DataFrame, round_: int, arrow, ddl: str, length: int, with_ids: bool, final: bool) -> DataFrame:
    """Leftovers of each FAN_IN tasks cut into sequences and one leftover, or none if final."""
    to = F.expr(f"task div {FAN_IN}")
    dealt = left.withColumn("to", to).repartition("to").sortWithinPartitions("to", "task", "place")

    def run(batches):
        rows, group, pieces = _Rows(arrow, with_ids), None, []

        def flush():
            total = sum(len(p[2]) for p in pieces)
            lengths = [length] * (total // length)
            *full, rest = cut(pieces, lengths + (powers_of_two(total % length) if final else []))
            for k, some in enumerate(full):
                rows.sequence(some, _number(round_, group, k))
            rows.leftover(rest, group)
            return rows.batch()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("to", "doc_id", "start", "ids", "doc_tokens")]
            for g, document, at, raw, n in zip(*columns):
                if g != group:
                    if pieces:
                        yield flush()
                    group, pieces = g, []
                pieces.append((document, at, np.frombuffer(raw, "<u4"), n))
        if pieces:
            yield flush()

    return dealt.mapInArrow(run, _fields(ddl))
