"""Context-mixing range coder for token ids, many blocks side by side.

A block is up to BLOCK ids and starts from a reset model, so any block can be decoded alone; its crc32 is kept. The model of
an id mixes three predictions: order 2 (the id that last followed the two before it) and order 1 (that last followed the one
before it) each get a share of the probability that adapts to how often they were right at their present run of hits; the rest
falls to order 0, the frequencies of the chunk's ids in its header. A block is a lane of numpy arrays: each step codes
one id of every lane. All arithmetic is on whole numbers, so that any machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

BLOCK = 1024
MAGIC = b"TIDEIDS1"
SHARE_BITS, ORDER0_BITS = 12, 20
SLOTS1, SLOTS2 = 256, 512
RUNS = 8
U64 = np.uint64
WORD = U64(0xFFFFFFFF)


class _Model:
    """Predictions of all lanes; the same calls in encoder and decoder keep both alike.

    A cell of a table holds the id that was seen last and its run of hits in one word, `id * RUNS + run` (-1: none), so that a
    step reads and writes each table once. Hashes need only low bits, so they may wrap.
    """

    def __init__(self, lanes: int):
        self.lane1, self.lane2, self.lane_cell = (np.arange(lanes) * k for k in (SLOTS1, SLOTS2, RUNS))
        self.seen1, self.seen2 = np.full(lanes * SLOTS1, -1, np.int32), np.full(lanes * SLOTS2, -1, np.int32)
        start = np.linspace(400, 3600, RUNS).astype(np.int32)
        self.right1, self.right2 = np.tile(start // 2, lanes), np.tile(start, lanes)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def keep(self, n: int) -> None:
        """Only the first n lanes go on."""
        lanes = len(self.last)
        for name in ("seen1", "seen2", "right1", "right2", "last", "before", "lane1", "lane2", "lane_cell"):
            old = getattr(self, name)
            setattr(self, name, old[: len(old) // lanes * n])

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order-2 and order-1 ids (-1: none) and their shares of 1 << SHARE_BITS."""
        hashed = self.last * np.uint32(40503)
        self.at1 = self.lane1 + ((hashed >> 6) & (SLOTS1 - 1))
        self.at2 = self.lane2 + (((hashed + self.before * np.uint32(30029)) >> 4) & (SLOTS2 - 1))
        word2, word1 = self.seen2.take(self.at2), self.seen1.take(self.at1)
        self.two, self.one, self.run2, self.run1 = word2 >> 3, word1 >> 3, word2 & (RUNS - 1), word1 & (RUNS - 1)
        self.cell2, self.cell1 = self.lane_cell + self.run2, self.lane_cell + self.run1
        self.p2, self.p1 = self.right2.take(self.cell2), self.right1.take(self.cell1)
        share2 = self.p2 * (word2 >= 0)
        share1 = ((((1 << SHARE_BITS) - share2) * self.p1) >> SHARE_BITS) * ((word1 >= 0) & (self.one != self.two))
        return self.two, self.one, share2, share1

    def learn(self, ids: np.ndarray) -> None:
        ids = ids.astype(np.int32)
        new = ids << 3
        for guess, seen, run, right, at, cell, p in ((self.two, self.seen2, self.run2, self.right2, self.at2, self.cell2, self.p2), (self.one, self.seen1, self.run1, self.right1, self.at1, self.cell1, self.p1)):
            hit = guess == ids
            right[cell] = p + np.where(hit, (4000 - p) >> 4, -((p - 32) >> 4) * (guess >= 0))
            seen[at] = new + np.minimum(run + 1, RUNS - 1) * hit
        self.before, self.last = self.last, ids.astype(np.uint32)


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum 1 << ORDER0_BITS, at least 1 for each id that occurs."""
    total = 1 << ORDER0_BITS
    scaled = np.maximum(counts * (total - np.count_nonzero(counts)) // max(int(counts.sum()), 1), 0) + (counts > 0)
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return scaled


def _blocks(n_ids: int) -> np.ndarray:
    return np.diff(np.r_[np.arange(0, n_ids, BLOCK), n_ids])


def _steps(sizes: np.ndarray):
    """Yield (step, lanes that have an id there); only the last block can be short, so lanes are a prefix."""
    full = int(sizes.max())
    for step in range(full):
        yield step, len(sizes) if step < sizes[-1] else len(sizes) - 1


def encode(ids: np.ndarray) -> bytes:
    """A chunk: header, frequencies, block lengths and checksums, blocks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    table = zstandard.ZstdCompressor(level=3).compress(counts.astype("<u4").tobytes())
    sizes = _blocks(len(ids))
    lengths, crcs, body = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.uint32), b""
    if len(ids):
        grid = np.zeros((len(sizes), BLOCK), np.int64)
        grid.reshape(-1)[: len(ids)] = ids
        grid = np.ascontiguousarray(grid.T)
        frequency = _frequencies(counts)
        start = np.cumsum(frequency) - frequency
        lengths, body = _encode_lanes(grid, sizes, frequency.astype(U64), start.astype(U64))
        crcs = np.array([zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(len(sizes))], np.uint32)
    head = MAGIC + struct.pack("<QII", len(ids), len(counts), len(table))
    return head + table + lengths.astype("<u4").tobytes() + crcs.astype("<u4").tobytes() + body


def _encode_lanes(grid: np.ndarray, sizes: np.ndarray, frequency: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, bytes]:
    n = len(sizes)
    model = _Model(n)
    low, width = np.zeros(n, U64), np.full(n, 2**64 - 1, U64)
    out, filled = np.zeros((n, 2 * BLOCK + 4), np.uint32), np.zeros(n, np.int64)

    def narrow(lanes: np.ndarray | slice, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        part = width[lanes] >> U64(bits)
        low[lanes] += part * begin
        width[lanes] = part * size
        settle(lanes)

    def settle(lanes) -> None:
        """Put out the upper word where it is fixed, or where the width got too small (it is then cut at the next word)."""
        bottom, size = low[lanes], width[lanes]
        fixed = ((bottom ^ (bottom + size)) >> U64(32)) == 0
        move = np.flatnonzero(fixed | (size < U64(1 << 32)))
        if not len(move):
            return
        k = np.arange(n)[lanes][move]
        size = np.where(fixed[move], size[move], (~bottom[move] + U64(1)) & WORD)
        out[k, filled[k]] = (bottom[move] >> U64(32)).astype(np.uint32)
        filled[k] += 1
        low[k] = bottom[move] << U64(32)
        width[k] = size << U64(32)

    for step, live in _steps(sizes):
        if live < len(model.last):
            model.keep(live)
        ids = grid[step, :live]
        two, one, share2, share1 = model.predict()
        is2 = two == ids
        is1 = ~is2 & (one == ids) & (share1 > 0)
        begin = np.where(is2, 0, np.where(is1, share2, share2 + share1))
        size = np.where(is2, share2, np.where(is1, share1, (1 << SHARE_BITS) - share2 - share1))
        narrow(slice(0, live), begin.astype(U64), size.astype(U64), SHARE_BITS)
        rest = np.flatnonzero(~is2 & ~is1)
        if len(rest):
            narrow(rest, start[ids[rest]], frequency[ids[rest]], ORDER0_BITS)
        model.learn(ids)
    lane = np.arange(n)
    for shift in (32, 0):
        out[lane, filled] = ((low >> U64(shift)) & WORD).astype(np.uint32)
        filled += 1
    return filled, out[np.arange(out.shape[1]) < filled[:, None]].astype("<u4").tobytes()


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk. Raises ValueError if it is no chunk, is cut off, or a block's checksum is wrong."""
    head = len(MAGIC) + struct.calcsize("<QII")
    if len(chunk) < head or chunk[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n_ids, n_counts, n_table = struct.unpack("<QII", chunk[len(MAGIC) : head])
    sizes = _blocks(n_ids)
    at = head + n_table
    if len(chunk) < at + 8 * len(sizes):
        raise ValueError("the chunk is cut off")
    counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(chunk[head:at]), "<u4").astype(np.int64)
    lengths = np.frombuffer(chunk, "<u4", len(sizes), at).astype(np.int64)
    crcs = np.frombuffer(chunk, "<u4", len(sizes), at + 4 * len(sizes))
    at += 8 * len(sizes)
    if len(counts) != n_counts or len(chunk) != at + 4 * lengths.sum():
        raise ValueError("the chunk is cut off")
    if not n_ids:
        return np.zeros(0, np.uint32)
    frequency = _frequencies(counts)
    ids = _decode_lanes(np.frombuffer(chunk, "<u4", int(lengths.sum()), at), lengths, sizes, frequency)
    for k in range(len(sizes)):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != crcs[k]:
            raise ValueError(f"wrong checksum in block {k}")
    return ids


def _decode_lanes(words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    n = len(sizes)
    model = _Model(n)
    start = (np.cumsum(frequency) - frequency).astype(U64)
    owner = np.repeat(np.arange(len(frequency)), frequency)
    frequency = frequency.astype(U64)
    words = np.r_[words, np.zeros(4, words.dtype)].astype(U64)
    read = np.cumsum(lengths) - lengths
    code = (words[read] << U64(32)) | words[read + 1]
    read = read + 2
    low, width = np.zeros(n, U64), np.full(n, 2**64 - 1, U64)
    grid = np.zeros((BLOCK, n), np.int64)

    def settle(lanes) -> None:
        bottom, size = low[lanes], width[lanes]
        fixed = ((bottom ^ (bottom + size)) >> U64(32)) == 0
        move = np.flatnonzero(fixed | (size < U64(1 << 32)))
        if not len(move):
            return
        k = np.arange(n)[lanes][move]
        size = np.where(fixed[move], size[move], (~bottom[move] + U64(1)) & WORD)
        code[k] = (code[k] << U64(32)) | words[np.minimum(read[k], len(words) - 1)]
        read[k] += 1
        low[k] = bottom[move] << U64(32)
        width[k] = size << U64(32)

    for step, live in _steps(sizes):
        if live < len(model.last):
            model.keep(live)
        two, one, share2, share1 = model.predict()
        part = width[:live] >> U64(SHARE_BITS)
        value = np.minimum((code[:live] - low[:live]) // np.maximum(part, U64(1)), U64((1 << SHARE_BITS) - 1)).astype(np.int64)
        is2 = value < share2
        is1 = ~is2 & (value < share2 + share1)
        begin = np.where(is2, 0, np.where(is1, share2, share2 + share1)).astype(U64)
        size = np.where(is2, share2, np.where(is1, share1, (1 << SHARE_BITS) - share2 - share1)).astype(U64)
        low[:live] += part * begin
        width[:live] = part * size
        settle(slice(0, live))
        ids = np.where(is2, two, one).astype(np.int64)
        rest = np.flatnonzero(~is2 & ~is1)
        if len(rest):
            part = width[rest] >> U64(ORDER0_BITS)
            value = np.minimum((code[rest] - low[rest]) // np.maximum(part, U64(1)), U64((1 << ORDER0_BITS) - 1)).astype(np.int64)
            got = owner[value]
            ids[rest] = got
            low[rest] += part * start[got]
            width[rest] = part * frequency[got]
            settle(rest)
        grid[step, :live] = ids
        model.learn(ids)
    return grid.T.reshape(-1)[: int(sizes.sum())].astype(np.uint32)
