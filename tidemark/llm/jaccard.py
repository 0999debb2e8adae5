"""Exact n-gram Jaccard self-join as a metric-space join, and its classes.

1 - Jaccard is a metric on shingle sets. Documents of equal sets are one class and only classes are compared.

Regions. Random texts lie at distance 1 from any pivot document, where Voronoi regions of the whole space would hold
everything in their windows. So the space is cut in projections in which neighbours are at distance 0: sets are sorted into
rings by size (the distance to the empty set; by the triangle inequality a set within the window of the next ring is
replicated into it), and each ring's shingles are dealt to m sub-universes, m more than the elements in which two linked sets of
the ring can differ, so that such sets are equal in at least one. A region is the classes of a ring that are equal in a
sub-universe. m leaves a margin, so that tiny projections, which random sets share, need not count.

Joins. In each region one class is the pivot; a class that is within the distance of its pivot is linked to it, and members
linked with one another need no comparing. After some rounds with other pivots, regions that still hold several
components are joined exactly. Linked sets share a known number of regions, so each class leaves out its largest ones, one fewer than that
(`few_regions`). Regions that share members then make a family, which is dealt to blocks of bounded size, and for each two blocks one task
compares the members that share a region; a member goes only where its regions have other members (`places`). (Splitting families further by Voronoi regions of their pivots was tried: with
windows of twice the distance nearly all members stay in all regions.)

Sketches. Each set has a bitmap in which every element flips one bit (`sketches`). Two bitmaps differ in no more bits than their sets in elements, so pairs
whose bitmaps differ in more than links allow are no links, and their texts need not be moved or cut into shingles. Pairs with pivots are
screened so, and families too, in wide blocks without texts (`screened_members`). What is left is compared by exact counts over whole sets.

Sets are compared by 64-bit hashes of shingles, classes by 64 bits of the set and its size, texts of one class by xxhash64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import ROWS, added, forget, written
from tidemark.llm.words import BASE, NOT_SPACE, U64, buffers, first_of, mixed, slices, windows, words

N = 3
#: Texts that have a word, as NOT_SPACE has it.
A_WORD = r"[^\x20\x09-\x0D]"
#: 100 * intersection >= PERCENT * union.
PERCENT = 90
RING = 1.5
#: Rounds of one pivot for each region, before regions are joined.
ROUNDS = 2
#: Members and shingles of a block; a task joins two blocks in memory.
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 800_000
#: A block of sketches, without texts, holds so many times more.
WIDE = 8
#: Bits of a sketch at least, as a power of two; sketches that are compared at a time.
LEAST_BITS = 8
COMPARED = 1 << 16
#: Stars that fill more than this part of a block are dealt out member by member.
STAR_PART = 0.25
#: Bits of the marks of wanted texts: so many for each text, and at most.
MARK_BITS = 16
MOST_BITS = 1 << 25
#: Regions of classes that a task holds before it gives them out, and about so many that are sorted at a time.
HELD_ROWS = 500_000
PART_ROWS = 200_000
#: Bytes of texts that are cut into shingles at a time, so that the arrays stay in a core's cache.
TEXT_BYTES = 500_000
#: Shingles that are counted at a time, or those of one set.
COLUMNS = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash) of each document's distinct shingles in order of (doc, hash), and set sizes. A text of fewer than n words, but not none, is one shingle."""
    w = words(data, offsets, NOT_SPACE, lower=True)
    hashes, n_words = w.hashes(), w.per_doc()
    total, first = windows(hashes, w.doc, n)
    doc = w.doc[first]
    for k in range(1, n):
        short = n_words == k
        if short.any():
            mine = short[w.doc]
            some, at = windows(hashes[mine], w.doc[mine], k)
            total, doc = np.concatenate([total, some]), np.concatenate([doc, w.doc[mine][at]])
            order = np.argsort(doc, kind="stable")
            total, doc = total[order], doc[order]
    # sorted document by document: far less work than one sort by document and hash
    ends = np.cumsum(np.bincount(doc, minlength=w.n_docs)).tolist()
    for a, b in zip([0, *ends], ends):
        total[a:b].sort()
    keep = first_of(total) | first_of(doc)
    doc, total = doc[keep], total[keep]
    return doc, total, np.bincount(doc, minlength=w.n_docs)


def classes_of(doc: np.ndarray, hashes: np.ndarray, n_docs: int, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    total = np.zeros(n_docs, U64)
    np.add.at(total, doc, mixed(hashes ^ U64(0x5851F42D4C957F2D)))
    return mixed(total + sizes.astype(U64) * BASE).view(np.int64)


def ring_of(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / math.log(RING) + 1e-9).astype(np.int64)


def ring_start(ring: np.ndarray) -> np.ndarray:
    """A lower bound of the sizes in a ring, safe against rounding."""
    return RING ** ring.astype(float) * (1 - 1e-6)


def universes(ring: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Number of sub-universes of a ring, and how many of them are margin.

    Linked sets x, y differ in d elements with 100 (|x| + |y| - d) >= percent (|x| + |y| + d), so d <= (100 - percent) (|x| + |y|) / (100 + percent), and
    neither set is larger than the ring.
    """
    differ = np.floor((100 - percent) * 2 * ring_start(ring + 1) * (1 + 3e-6) / (100 + percent)).astype(np.int64)
    margin = np.where(differ >= 8, 1 + differ // (15 if least_content(percent) > 1 else 4), 0)
    return differ + 1 + margin, margin


def least_content(percent: int) -> int:
    """Elements below which a projection is tiny. Wide limits need so many sub-universes that only empty projections can be left out."""
    return 3 if percent >= 88 else 1


def regions_of(doc: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, region, tag) of sets: for its own ring and each further ring that its window reaches, one where percent is 67 or more.

    The tag holds the ring and, in its low 16 bits, how many regions of it the set shares at least with each set that it is linked to:
    all sub-universes but those in which they differ and those that are left out as tiny.
    """
    out = []
    own = ring_of(sizes)
    for up in range(2 + math.floor(math.log(100 / percent) / math.log(RING) + 1e-9)):
        ring = own + up
        takes = sizes > 0
        if up:
            takes &= sizes * 100 >= percent * ring_start(ring) * (1 - 1e-6)
        m, margin = universes(ring, percent)
        chosen = takes[doc]
        d, h = doc[chosen], hashes[chosen]
        base = np.where(takes, m, 0)
        base = np.cumsum(base) - base
        place = base[d] + (mixed(h + U64(0x632BE59BD9B4E019)) % m[d].astype(U64)).astype(np.int64)
        cells = int(np.where(takes, m, 0).sum())
        content, count = np.zeros(cells, U64), np.bincount(place, minlength=cells)
        np.add.at(content, place, mixed(h))
        owner = np.repeat(np.arange(len(sizes)), np.where(takes, m, 0))
        # at most `margin` tiny projections: then two linked sets are also equal in one that is not tiny
        tiny = count < least_content(percent)
        needs_tiny = np.bincount(owner[tiny], minlength=len(sizes)) > margin
        keep = ~tiny | needs_tiny[owner]
        key = content + (np.arange(cells) - base[owner]).astype(U64) * BASE + mixed(ring[owner].astype(U64) + U64(1))
        n_tiny = np.bincount(owner[tiny], minlength=len(sizes))
        need = np.clip(1 + margin - n_tiny, 1, 0xFFFF)
        out.append((owner[keep], mixed(key).view(np.int64)[keep], (ring << 16 | need)[owner[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def keyed(docs: DataFrame, text: str, n: int, drop: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """docs with __n (set size) and __class (null for an empty set), and the compressed text if `packed`."""

    def factory():
        press = zstandard.ZstdCompressor(level=3)

        def make(batch):
            data, offsets = buffers(batch.column(text))
            sizes, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in slices(offsets, TEXT_BYTES):
                doc, hashes, size = shingle_sets(data, offsets[a : b + 1], n)
                sizes.append(size)
                keys.append(classes_of(doc, hashes, b - a, size))
            size = np.concatenate(sizes)
            out = {"__n": pa.array(size, pa.int64()), "__class": pa.array(np.concatenate(keys), pa.int64(), mask=size == 0)}
            if packed:
                out["__packed"] = _pressed(press, data, offsets)
            return out

        return make

    return added(docs, factory, {"__n": "long", "__class": "long"} | ({"__packed": "binary"} if packed else {}), drop)


def _pressed(press: zstandard.ZstdCompressor, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = memoryview(data)
    return pa.array([press.compress(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def marks(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low bits of 64-bit hashes, 4 MB at most however many there are."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (MARK_BITS * hashes.count()).bit_length()))
    bit = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("part"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for row in parts.collect():
        out[row.k - 1] = np.frombuffer(row.part, np.uint8)
    return out.reshape(-1)


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Flags of the hashes that may be among those of the bitmap."""
    bit = hashes & (8 * len(bitmap) - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def pressed(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(__text, __packed): hash and compressed text of rows whose text may be wanted, repeats in a task once. wanted has __text."""
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(wanted, "__text"))

    def run(batches):
        press, done = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            hashes = batch.column("__text").to_numpy()
            rows = []
            for k in np.flatnonzero(marked(bitmap.value, hashes)).tolist():
                if hashes[k] not in done:
                    done.add(hashes[k])
                    rows.append(k)
            for at in range(0, len(rows), ROWS):
                some = batch.take(pa.array(rows[at : at + ROWS], pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("__text"), _pressed(press, *buffers(some.column("__in")))], ["__text", "__packed"])

    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__text"), F.col(text).alias("__in"))
    return rows.mapInArrow(run, "__text long, __packed binary")


MEMBER = ["key", "class", "tag", "region", "pivot"]


def members_in_tasks(docs: DataFrame, text: str, n: int, percent: int, parts: int) -> DataFrame:
    """(part, key, class, tag, region, pivot): arrays of the keys that fall to a part, of each task's distinct classes, in portions of about HELD_ROWS.

    A row for each part instead of one for each key: a text has about a hundred keys.

    In a portion, the first class of each of the task's regions goes by the region (key), without region and pivot; it meets those of other tasks, so a
    hot region has one such row per portion. Where a region holds several classes of the portion, all are its members, with the first as
    pivot; they are settled already, so their key is their class.
    """

    def run(batches):
        for batch in _members_in_task(batches, n, percent):
            part = (mixed(batch.column("key").to_numpy().view(U64)) % U64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            begin = np.flatnonzero(first_of(part[order]))
            ends = pa.array(np.append(begin, len(part)), pa.int32())
            rows = batch.take(pa.array(order))
            nested = [pa.ListArray.from_arrays(ends, rows.column(c)) for c in MEMBER]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][begin]), *nested], ["part", *MEMBER])

    schema = "part int, " + ", ".join(f"{c} array<long>" for c in MEMBER)
    return docs.select(F.col(text).alias("__text")).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def _members_in_task(batches, n: int, percent: int):
    seen, parts, held = np.zeros(0, np.int64), [], 0
    for batch in batches:
        data, offsets = buffers(batch.column("__text"))
        for a, b in slices(offsets, TEXT_BYTES):
            doc, hashes, size = shingle_sets(data, offsets[a : b + 1], n)
            keys = classes_of(doc, hashes, b - a, size)
            order = np.argsort(keys, kind="stable")
            new = first_of(keys[order])
            fresh = np.zeros(b - a, bool)
            fresh[order[new]] = True
            at = np.minimum(np.searchsorted(seen, keys), max(len(seen) - 1, 0))
            fresh &= (seen[at] != keys) if len(seen) else True
            fresh &= size > 0
            seen = np.union1d(seen, keys[fresh])
            mine = fresh[doc]
            owner, region, tag = regions_of(doc[mine], hashes[mine], np.where(fresh, size, 0), percent)
            parts.append(np.stack([region, keys[owner], tag]))
            held += len(region)
            if held >= HELD_ROWS:
                yield from _portion(parts)
                held = 0
    yield from _portion(parts)


def _portion(parts: list[np.ndarray]):
    """Batches of the (region, class, tag) in parts, which is emptied."""
    if not parts:
        return
    region, cls, tag = np.concatenate(parts, axis=1)
    parts.clear()
    order = np.lexsort((cls, region))
    region, cls, tag = region[order], cls[order], tag[order]
    first = first_of(region)
    begin = np.flatnonzero(first)
    several = np.diff(np.append(begin, len(region))) > 1
    group = np.cumsum(first) - 1
    local = np.flatnonzero(several[group])
    for rows, settled in ((begin, False), (local, True)):
        for at in range(0, len(rows), HELD_ROWS):
            k = rows[at : at + HELD_ROWS]
            more = [pa.array(region[k]), pa.array(cls[begin[group[k]]])] if settled else [pa.nulls(len(k), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cls[k] if settled else region[k]), pa.array(cls[k]), pa.array(tag[k]), *more], MEMBER)


#: Members with too few shared regions are taken out so often at most, and again only if that took out this part.
PRUNES = 3
WORTH = 0.05


def region_members(docs: DataFrame, text: str, n: int, percent: int, shingles: int) -> DataFrame:
    """(region, class, tag, pivot) of regions with two classes or more that may be linked, in one pass over the texts and one shuffle by region.

    A class has one row in a region. shingles: about how many all sets hold, for the number of parts.
    """
    parts = max(1, math.ceil(4 * shingles * (100 - percent) / (100 + percent) / PART_ROWS))
    dealt = members_in_tasks(docs, text, n, percent, parts).repartition(parts, "part").sortWithinPartitions("part")
    names = ["region", "class", "tag", "pivot"]

    def run(batches):
        held, part = [], None

        def out():
            """Members that are settled, and regions of several different classes; the first class is the pivot."""
            columns = {c: pa.concat_arrays([x.column(c).flatten() for x in held]) for c in MEMBER}
            held.clear()
            settled = columns["pivot"].is_valid()
            yield pa.RecordBatch.from_arrays([columns[c].filter(settled) for c in names], names)
            key, cls, tag = (columns[c].filter(pa.compute.invert(settled)).to_numpy() for c in MEMBER[:3])
            order = np.lexsort((cls, key))
            key, cls, tag = key[order], cls[order], tag[order]
            keep = first_of(key) | first_of(cls)
            key, cls, tag = key[keep], cls[keep], tag[keep]
            first = first_of(key)
            begin, group = np.flatnonzero(first), np.cumsum(first) - 1
            k = np.flatnonzero((np.diff(np.append(begin, len(key))) > 1)[group])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[k], cls[k], tag[k], cls[begin[group[k]]])], names)

        for batch in batches:
            at = batch.column("part").to_numpy()
            begin = np.flatnonzero(first_of(at)).tolist() if len(at) else []
            for a, b in zip(begin, [*begin[1:], len(at)]):
                if held and at[a] != part:
                    yield from out()
                part = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    members = written(dealt.mapInArrow(run, "region long, class long, tag long, pivot long"), "members")
    left, size = members.select("region", "class", "tag").distinct(), members.count()
    for _ in range(PRUNES):
        # a linked class shares as many regions of the ring as its tag says with one other class, so it has as many
        left = left.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("class", "tag"))).where(F.col("shared") >= F.col("tag").bitwiseAND(F.lit(0xFFFF)))
        by = Window.partitionBy("region")
        left = left.withColumns({"pivot": F.min("class").over(by), "last": F.max("class").over(by)}).where("pivot < last")
        before, members = members, written(left.select(*names), "members")
        forget(before)
        left, size, was = members.select("region", "class", "tag"), members.count(), size
        if size > (1 - WORTH) * was:
            break
    return members


def sketches(doc: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a bitmap of each set: as many bits as elements, up to a power of two, each flipped by every element that falls to it."""
    bits = np.int64(1) << np.maximum(LEAST_BITS, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.r_[0, np.cumsum(bits)]
    place = base[doc] + (mixed(hashes ^ U64(0xA0761D6478BD642F)) & (bits[doc] - 1).astype(U64)).astype(np.int64)
    odd = np.bincount(place, minlength=base[-1]).astype(np.uint8) & 1
    return np.packbits(odd), base // 8


def sketched(texts: DataFrame, n: int) -> DataFrame:
    """texts with the sketch of each packed text."""

    def factory():
        unpress = zstandard.ZstdDecompressor()

        def make(batch):
            raw = [unpress.decompress(x) for x in batch.column("packed").to_pylist()]
            offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
            made = [sketches(*shingle_sets(data, offsets[a : b + 1], n)) for a, b in slices(offsets, TEXT_BYTES)]
            out = [pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(x)]) for x, at in made]
            return {"sketch": pa.concat_arrays([x.cast(pa.binary()) for x in out]) if out else pa.array([], pa.binary())}

        return make

    return added(texts, factory, {"sketch": "binary"})


class Sketches:
    """Sketches side by side, one array for each width."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.width, self.row, self.of = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64), {}
        for w in np.unique(self.width).tolist():
            k = np.flatnonzero(self.width == w)
            self.row[k] = np.arange(len(k))
            self.of[w] = data[offsets[k][:, None] + np.arange(w)].view(U64)

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which sketches a differ from sketches b: no more than elements in which their sets differ."""
        out = np.zeros(len(a), np.int64)
        kind = self.width[a] << 32 | self.width[b]
        for both in np.unique(kind).tolist():
            wide, other = both >> 32, both & 0xFFFFFFFF
            k = np.flatnonzero(kind == both)
            step = max(1, COMPARED * 64 // max(wide, other))
            for at in range(0, len(k), step):
                some = k[at : at + step]
                x, y = _folded(self.of[wide][self.row[a[some]]], other), _folded(self.of[other][self.row[b[some]]], wide)
                out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches of at most so many bytes: halves of one of twice the width, added bit by bit, are the sketch of half the width."""
    while 8 * bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(differ: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Flags of pairs of sizes na and nb that are linked if their sets differ in so many elements: 100 * common >= percent * union, in whole numbers."""
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def screened(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be links by their sizes and sketches. texts has class, n and sketch."""
    side = lambda c: texts.select(F.col("class").alias(c), F.col("sketch").alias(f"__{c}"), F.col("n").alias(f"__n{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    both = both.where(F.lit(100) * F.least("__na", "__nb") >= F.lit(percent) * F.greatest("__na", "__nb"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 10 * ROWS):
                batch = whole.slice(at, 10 * ROWS)
                m = batch.num_rows
                found = Sketches(*_bytes_of([batch.column("__a"), batch.column("__b")])).differences(np.arange(m), np.arange(m, 2 * m))
                keep = may_link(found, *(batch.column(c).to_numpy() for c in ("__na", "__nb")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _bytes_of(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of binary columns, one after the other."""
    column = pa.concat_arrays([x.cast(pa.large_binary()) for x in columns])
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def links_of(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Texts are moved and cut into shingles only where sketches leave it open."""
    left = written(screened(pairs, texts, percent), "screened")
    wanted = left.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    some = texts.select("class", "packed", "n").join(wanted, "class", "left_semi")
    return written(distances(left, some, n).where(near(percent)).select("a", "b"), "links")


def distances(pairs: DataFrame, texts: DataFrame, n: int, percent: int = 0) -> DataFrame:
    """pairs (a, b, ...) with the exact size of intersection and union of their sets; without the pairs whose sizes alone keep them
    below `percent`."""
    side = lambda c: texts.select(F.col("class").alias(c), F.col("packed").alias(f"__{c}"), F.col("n").alias(f"__n{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(F.lit(100) * F.least("__na", "__nb") >= F.lit(percent) * F.greatest("__na", "__nb")).drop("__na", "__nb")

    def factory():
        unpress = zstandard.ZstdDecompressor()

        def make(batch):
            raw = [unpress.decompress(x) for pair in zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist()) for x in pair]
            offsets = np.cumsum([0, *map(len, raw)])
            data = np.frombuffer(b"".join(raw), np.uint8)
            common, union = np.zeros(len(raw) // 2, np.int64), np.zeros(len(raw) // 2, np.int64)
            ends = offsets[::2]
            for a, b in slices(ends):
                doc, hashes, size = shingle_sets(data, offsets[2 * a : 2 * b + 1], n)
                pair = doc // 2
                order = np.lexsort((hashes, pair))
                same = ~(first_of(hashes[order]) | first_of(pair[order]))
                common[a:b] = np.bincount(pair[order][same], minlength=b - a)
                union[a:b] = size.reshape(-1, 2).sum(axis=1) - common[a:b]
            return {"common": pa.array(common), "union": pa.array(union)}

        return make

    return added(both, factory, {"common": "long", "union": "long"}, drop=("__a", "__b"))


def near(percent: int) -> Column:
    return F.lit(100) * F.col("common") >= F.lit(percent) * F.col("union")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _mixed(members: DataFrame) -> DataFrame:
    """(region, size) of regions with more than one label."""
    found = members.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
    return found.where("lo < hi").select("region", "size")


def _pairs(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def class_labels(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(class, label): the component of every class that is linked with another. Without tags, linked classes share one region or more.

    A class has one row in a region.
    """
    if "tag" not in members.columns:
        members = members.withColumn("tag", F.lit(1).cast("long"))
    if "sketch" not in texts.columns:
        texts = written(sketched(texts, n), "texts")

    def labels_of(links: DataFrame) -> DataFrame:
        return written(components(links).select(F.col("node").alias("class"), F.col("root").alias("label")), "labels")

    # every class with the pivot that it shares most regions with
    best = members.where("class != pivot").groupBy("class", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = best.groupBy("class").agg(F.max(F.struct("shared", "pivot"))["pivot"].alias("pivot"))
    links, open_ = links_of(_pairs(F.col("class"), F.col("pivot"), best), texts, n, percent), members.select("region", "class", "tag")
    for turn in range(ROUNDS + 1):
        known = labels_of(links)
        now = _labelled(open_, known)
        open_ = written(now.join(_mixed(now), "region"), "open")
        if turn < ROUNDS:
            # one pivot for each region that is still mixed, the same in all regions where it comes first
            first = open_.groupBy("region").agg(F.min_by(F.struct("class", "label"), F.xxhash64("class", F.lit(turn))).alias("p"))
            spread = _pairs(F.col("class"), F.col("p.class"), open_.join(first, "region").where("label != p.label"))
            links = links.unionByName(links_of(spread, texts, n, percent))
            open_ = open_.select("region", "class", "tag")
    few = written(few_regions(open_), "few")
    few = written(few.join(_mixed(few).select("region"), "region"), "few")
    if not few.isEmpty():
        few = few.join(screened_members(few, texts, percent), "class", "left_semi")
        few = written(few.join(_mixed(few).select("region"), "region"), "few")
    if few.isEmpty():
        return known
    return labels_of(links.unionByName(written(family_links(few, texts, n, percent), "links")))


def few_regions(open_: DataFrame) -> DataFrame:
    """(region, class, label): of all mixed regions of each class, so many that it still shares one with each class that it is linked to.

    Two linked classes share as many regions of a ring as both their tags say. In one order of all regions, the first that they share is
    followed by the others, so it is not among the last of either class, one fewer than that. The largest regions come last.
    """
    by = Window.partitionBy("class", "tag")
    ranked = open_.withColumns({"rank": F.row_number().over(by.orderBy("size", "region")), "all": F.count(F.lit(1)).over(by)})
    return ranked.where(F.col("rank") <= F.col("all") - F.col("tag").bitwiseAND(F.lit(0xFFFF)) + 1).select("region", "class", "label")


def places(open_: DataFrame, sizes: DataFrame, wide: int = 1) -> DataFrame:
    """(family, block, other, class, label, regions): the blocks, its own included, in which a region of a member has members of another label.

    Members with the same least neighbour, a star, are in one block where it has room for them, so that regions lie in few blocks. In a family
    of one block all members meet. sizes has class and n. No text is moved before it is known where it goes. Blocks are `wide` times their usual size.
    """
    most, shingles = BLOCK_MEMBERS * wide, BLOCK_SHINGLES * wide
    at = written(open_.join(open_.groupBy("region").agg(F.min("class").alias("head")), "region"), "heads")
    family = written(components(at.select(F.col("class").alias("a"), F.col("head").alias("b"))), "families")
    own = at.groupBy("class").agg(F.first("label").alias("label"), F.collect_set("region").alias("regions"), F.min("head").alias("star"))
    rows = written(family.select(F.col("node").alias("class"), F.col("root").alias("family")).join(own, "class").join(sizes, "class"), "own")
    # families of several blocks and stars without room are few: each has a fixed number of members or shingles at least
    several = rows.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(most), F.sum("n") / F.lit(shingles))).cast("int").alias("blocks")).where("blocks > 1")
    stars = rows.groupBy("star").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    stars = stars.where((F.col("members") > most * STAR_PART) | (F.col("shingles") > shingles * STAR_PART)).select("star", F.lit(True).alias("wide"))
    rows = rows.join(F.broadcast(several), "family", "left").join(F.broadcast(stars), "star", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.when(F.col("wide"), F.col("class")).otherwise(F.col("star"))), F.col("blocks")).cast("int"))
    rows = written(rows.select("class", "label", "family", "blocks", "block", "regions"), "blocks")
    spread = rows.where("blocks > 1").select("class", "label", "block", F.explode("regions").alias("region"))
    held = spread.groupBy("region", F.col("block").alias("other")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    held = held.groupBy("region").agg(F.collect_list(F.struct("other", "lo", "hi")).alias("held"))
    # one row for each region of a member, whatever the number of blocks that hold the region
    others = F.transform(F.filter("held", lambda x: (x["lo"] != F.col("label")) | (x["hi"] != F.col("label"))), lambda x: x["other"])
    meets = spread.join(held, "region").select("class", others.alias("others")).groupBy("class").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    meets = meets.select("class", F.explode("others").alias("other"))
    alone = rows.where("blocks = 1").select("class", F.col("block").alias("other"))
    return rows.join(meets.unionByName(alone), "class").select("family", "block", "other", "class", "label", "regions")


def screened_members(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(class) of open_ that can be linked, by sizes and sketches, with a class of another label in one of their regions.

    Sketches are so much smaller than texts that a block holds more members, and few members go to several blocks. A task gives out each of its
    members once at most, never pairs.
    """
    meeting = [F.col("family"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    rows = places(open_, texts.select("class", "n"), WIDE).select(*meeting, "class", "label", "regions")
    dealt = rows.join(texts.select("class", "n", "sketch"), "class").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches):
        held, key = [], None

        def out():
            rows = pa.Table.from_batches(held)
            cls, label, n = (rows.column(c).to_numpy() for c in ("class", "label", "n"))
            regions = pa.concat_arrays(rows.column("regions").chunks)
            found = _may_link_within(_bytes_of(rows.column("sketch").chunks), label, n, regions.flatten().to_numpy(), np.diff(regions.offsets.to_numpy()), percent)
            return pa.RecordBatch.from_arrays([pa.array(cls[found])], ["class"])

        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("family", "i", "j")], axis=1)
            begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)][: len(at)])
            for a, b in zip(begin, [*begin[1:], len(at)]):
                if held and at[a].tolist() != key:
                    yield out()
                    held = []
                key = at[a].tolist()
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return dealt.mapInArrow(run, "class long").distinct()


def _members_of_regions(regions: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(region, own, member, first): regions as numbers, where those of each member begin, and the members of region r from first[r] on. count: regions of each member."""
    _, region = np.unique(regions, return_inverse=True)
    order = np.argsort(region, kind="stable")
    return region, np.r_[0, np.cumsum(count)], np.repeat(np.arange(len(count)), count)[order], np.searchsorted(region[order], np.arange(len(region) + 1))


def _may_link_within(packed: tuple[np.ndarray, np.ndarray], label: np.ndarray, size: np.ndarray, regions: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Members that can be linked with a member of another label that shares a region. packed: bytes and offsets of their sketches."""
    m, sketch = len(label), Sketches(*packed)
    region, own, member, first = _members_of_regions(regions, count)
    found, left, right, held = np.zeros(m, bool), [], [], 0

    def compare():
        a, b = np.repeat([k for k, _ in left], [n for _, n in left]), np.concatenate(right)
        near = may_link(sketch.differences(a, b), size[a], size[b], percent)
        found[a[near]] = found[b[near]] = True

    for a in range(m):
        mine = region[own[a] : own[a + 1]]
        b = np.flatnonzero(np.bincount(member[_ranges(first[mine], first[mine + 1])], minlength=m))
        b = b[(b > a) & (label[b] != label[a])]
        b = b[100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])]
        if len(b):
            left.append((a, len(b)))
            right.append(b)
            held += len(b)
        if held >= COMPARED or held and a == m - 1:
            compare()
            left, right, held = [], [], 0
    return np.flatnonzero(found)


def family_links(open_: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between members of mixed regions that have different labels, enough of them to join all labels that links join.

    Regions that share members are one family, so that a member is sent once and not for each of its regions. A family is dealt to
    blocks of bounded size, and each two blocks of it meet in one task.
    """
    meeting = [F.col("family"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    rows = places(open_, texts.select("class", "n")).select(*meeting, "class", "label", "regions")
    dealt = rows.join(texts.select("class", "packed"), "class").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "class")

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        held, key = [], None

        def out():
            if len({x[1] for x in held}) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            cls, label = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            a, b = _links_within([unpress.decompress(x[2]) for x in held], cls, label, [x[3] for x in held], n, percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "i", "j", "class", "label", "packed")]
            regions, ends = batch.column("regions").values.to_numpy(), batch.column("regions").offsets.to_numpy()
            for *at, cls, label, packed, a, b in zip(*columns, ends[:-1], ends[1:]):
                if at != key:
                    if len(held) > 1:
                        yield out()
                    held, key = [], at
                held.append((cls, label, packed, regions[a:b].copy()))
        if len(held) > 1:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    size = end - start
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _links_within(raw: list[bytes], cls: np.ndarray, label: np.ndarray, regions: list[np.ndarray], n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of classes that join all labels that links join, by counting the common shingles of members that share a region.

    Labels that pairs found before have joined are one component, so members of a large group are not compared with one another again.
    """
    none = np.zeros(0, np.int64)
    if len(set(label.tolist())) < 2:
        return none, none
    m, data, offsets = len(raw), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    parts = [(a, shingle_sets(data, offsets[a : b + 1], n)) for a, b in slices(offsets)]
    hashes, size = np.concatenate([x[1] for _, x in parts]), np.concatenate([x[2] for _, x in parts])
    del parts
    distinct, shingle = np.unique(hashes, return_inverse=True)
    shingle, marked = shingle.astype(np.int32), np.zeros(len(distinct), bool)
    at = np.r_[0, np.cumsum(size)]
    # members of each region, and regions of each member
    region, own, member, first = _members_of_regions(np.concatenate(regions), np.array([len(x) for x in regions]))
    # the component of each member, by the links found so far
    joined = np.unique(label, return_inverse=True)[1]
    x, y = [], []
    for a in range(m):
        mine = region[own[a] : own[a + 1]]
        b = np.flatnonzero(np.bincount(member[_ranges(first[mine], first[mine + 1])], minlength=m))
        b = b[(b > a) & (joined[b] != joined[a])]
        b = b[100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])]
        if not len(b):
            continue
        marked[shingle[at[a] : at[a + 1]]] = True
        for i, j in slices(np.r_[0, np.cumsum(size[b])], COLUMNS):
            some = b[i:j]
            found = marked[shingle[_ranges(at[some], at[some + 1])]]
            common = np.add.reduceat(found, np.cumsum(size[some]) - size[some], dtype=np.int64)
            # the same on both sides of the sign, in whole numbers: (100 + percent) * common >= percent * (size + size)
            some = some[(100 + percent) * common >= percent * (size[a] + size[some])]
            met, one = np.unique(joined[some], return_index=True)
            one = one[met != joined[a]]
            if len(one):
                x += [a] * len(one)
                y += some[one].tolist()
                joined[np.isin(joined, met)] = joined[a]
        marked[shingle[at[a] : at[a + 1]]] = False
    return cls[np.array(x, np.int64)], cls[np.array(y, np.int64)]


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs without the text, with n_shingles and component_id: the least id that links of 100 * intersection >= percent * union reach.

    One row per row of docs. Null texts and texts without words have no shingles, link with nothing and are their own
    component. Rows of equal text are linked. Null ids are not the least of a component that has others.
    """
    sets = written(keyed(docs.select(doc_id, text, F.xxhash64(text).alias("__text")), text, n, drop=(text,)), "sets")
    members = region_members(docs, text, n, percent, sets.agg(F.sum("__n")).first()[0] or 0)
    # one text of each class, found again by its hash, so that texts are cut into shingles once and not again to be sent;
    # written, so that Spark knows its size and need not shuffle all texts where it is small
    one = sets.where("__class IS NOT NULL").groupBy(F.col("__class").alias("class")).agg(F.min("__text").alias("__text"), F.first("__n").alias("n"))
    wanted = written(one.join(members.select("class").distinct(), "class", "left_semi"), "wanted")
    # only texts that may be wanted are shuffled; a text's hash has one class, so that one shuffle by the hash is enough
    texts = pressed(docs, text, wanted).join(wanted, "__text").groupBy("__text", "class").agg(F.first("__packed").alias("packed"), F.first("n").alias("n"))
    texts = written(sketched(texts.select("class", "packed", "n"), n), "texts")
    labels = class_labels(members, texts, n, percent)
    of_class = sets.where("__class IS NOT NULL").groupBy("__class").agg(F.min(doc_id).alias("__least"))
    of_class = of_class.join(labels, of_class["__class"] == labels["class"], "left").withColumn("__label", F.coalesce("label", "__class"))
    least = of_class.groupBy("__label").agg(F.min("__least").alias("component_id"))
    of_class = of_class.join(least, "__label").select("__class", "component_id")
    out = sets.join(of_class, "__class", "left")
    own = F.when(F.col("__class").isNull(), F.col(doc_id)).otherwise(F.col("component_id"))
    return out.select(doc_id, F.col("__n").alias("n_shingles"), own.alias("component_id"), F.col("__class").alias("shingle_class"), F.col("__text").alias("text_hash"))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one of the least id, of rows that repeat id and text any one. Columns of docs.

    Rows of null id stay if no row of their component has an id; rows without shingles all stay.
    """
    # columns of docs may have any name, also those that are added on the way
    given = docs.columns
    inner = [f"__in{k}" for k in range(len(given))]
    docs, doc_id, text = docs.toDF(*inner), inner[given.index(doc_id)], inner[given.index(text)]
    found = written(linked_components(docs, doc_id, text, n, percent), "components")
    least = found.where(F.col("shingle_class").isNotNull() & F.col(doc_id).eqNullSafe(F.col("component_id")))
    # a component's least id can have several texts; one of them is kept
    first = least.groupBy(F.col(doc_id).alias("__id")).agg(F.min(F.struct("shingle_class", "text_hash"))["text_hash"].alias("__kept"), F.count(F.lit(1)).alias("__rows"))
    first = written(first.select("__id", "__kept", "__rows"), "kept")
    # rows are found by the hash of their text, and those without a word need no shingles to be known
    has_word = F.coalesce(F.col(text).rlike(A_WORD), F.lit(False))
    rows = docs.withColumn("__text", F.when(has_word, F.xxhash64(text)))
    rows = rows.join(first, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__kept")), "left")
    rows = rows.where(F.col("__text").isNull() | F.col("__kept").isNotNull())
    names = [F.col(c).alias(g) for c, g in zip(inner, given)]
    if first.where("__rows > 1").isEmpty():
        return rows.select(names)
    many = rows.where("__rows > 1").dropDuplicates([doc_id, "__text"])
    return rows.where("__rows IS NULL OR __rows = 1").select(names).unionByName(many.select(names))
