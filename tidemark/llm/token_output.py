"""Token ids of a corpus in binary files, in order of document id.

Documents are dealt by ranges of their ids. Each task encodes its texts, appends the end id and writes chunks of whole
documents (about CHUNK ids, more only for a single longer document). A chunk is a row of a Parquet file: where it stands
(part, chunk), the ids and lengths of its documents, and the payload of `range_coder`. Spark's writer commits whole tasks, so
that a lost executor leaves no torn file, and any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import range_coder
from tidemark.llm.words import Words, buffers, slices

CHUNK = 3_000_000
#: Distinct pieces of text whose ids a task remembers; all are forgotten beyond that.
REMEMBERED = 1_500_000
#: New pieces that one call of the library gets as one text.
JOINED = 50
END = 0

#: First bytes of characters that may be white space beyond ASCII.
_WIDE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)
AFTER_CUT = np.ones(256, bool)
AFTER_CUT[[*range(0x21), *_WIDE_SPACE]] = False
#: Kinds of bytes: ASCII letters, other visible ASCII characters that are no digits, line ends, digits.
LETTER, SIGN, LINE_END, DIGIT = 1, 2, 4, 8
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x0A] = LINE_END


class Encoder:
    """Encodes texts with a byte-level tokenizer of the `tokenizers` library, each distinct piece once.

    The pre-tokenizer's pattern always begins a token at a single space before a character that is no white space, so texts
    are cut there, so are they between a letter and a sign or line end, and between a lone line end and a letter (ASCII all of them), which keeps
    words apart from what follows them; pieces are encoded by the library and their ids joined. New pieces go to the library many at a time as one text,
    in which all but the first begin at such a space, and are told apart by the bytes of their tokens.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        # a character of a byte-level token stands for one byte
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.filled = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _add(self, hashes: np.ndarray, where: np.ndarray, pieces: list[bytes], at_space: np.ndarray) -> None:
        first = ~at_space
        first[::JOINED] = True
        begin = np.flatnonzero(first).tolist()
        texts = [b"".join(pieces[a:b]).decode() for a, b in zip(begin, [*begin[1:], len(pieces)])]
        flat = np.concatenate([np.array(e.ids, self.ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends, piece_ends = np.cumsum(self.n_bytes[flat]), np.cumsum([len(x) for x in pieces])
        last = np.searchsorted(ends, piece_ends)
        if last[-1] != len(ends) - 1 or (ends[last] != piece_ends).any():
            raise ValueError("tokens don't end where pieces end: no byte-level tokenizer")
        size = np.diff(last, prepend=-1)
        if self.filled + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids[: self.filled], np.zeros(self.filled + 2 * len(flat), self.ids.dtype)]
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.known = np.insert(self.known, where, hashes)
        self.at = np.insert(self.at, where, self.filled + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.filled += len(flat)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of documents with an end id after each, and the number of ids of each document."""
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        n_docs, filled = len(offsets) - 1, offsets[:-1] < offsets[1:]
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & AFTER_CUT[data[1:]]
        kind = KIND[data]
        cut[1:] |= (kind[:-1] == LETTER) & (kind[1:] & (SIGN | LINE_END) > 0)
        cut[2:] |= (kind[1:-1] == LINE_END) & (kind[2:] == LETTER) & (kind[:-2] & (LETTER | SIGN | DIGIT) > 0)
        # a space that ends a document has nothing after it; a line end that begins one is alone, whatever is before it
        last = offsets[1:][filled] - 1
        cut[last[data[last] == 0x20]] = False
        cut[offsets[:-1][filled]] = True
        start = np.flatnonzero(cut)
        doc = np.searchsorted(offsets, start, "right") - 1
        end = np.minimum(np.r_[start[1:], len(data)], offsets[doc + 1])
        hashes = Words(data, offsets, start, end, doc, n_docs, cut).hashes()
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > REMEMBERED:
            self.forget()
        where = np.searchsorted(self.known, unique)
        new = np.flatnonzero(self.known[np.minimum(where, len(self.known) - 1)] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            a, b = start[at[new]], end[at[new]]
            at_space = (data[a] == 0x20) & (b - a > 1) & AFTER_CUT[data[np.minimum(a + 1, len(data) - 1)]]
            self._add(unique[new], where[new], [raw[x:y] for x, y in zip(a.tolist(), b.tolist())], at_space)
        row = np.searchsorted(self.known, unique)[inverse]
        size = self.size[row]
        per_doc = np.bincount(doc, size, n_docs).astype(np.int64)
        # each piece's ids, moved by one place for every end id before it
        to = np.cumsum(size) - size + doc
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out = np.full(total + n_docs, END, np.uint32)
        out[np.repeat(to, size) + step] = self.ids[np.repeat(self.at[row], size) + step]
        return out, per_doc + 1


@lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str) -> Encoder:
    """The encoder that all tasks of a Python worker use, one after another, so that a piece is encoded once for all of them."""
    return Encoder(tokenizer_json)


SCHEMA = "part int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> None:
    """Write the ids of all texts to a new folder. Null and empty texts have the end id alone; null ids come first and repeated ids
    follow one another in order of their texts' hashes. An empty table makes a folder without chunks."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        encoder, part, number = encoder_of(tokenizer_json), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list = []
        sizes: list[np.ndarray] = []
        held = 0

        def out():
            nonlocal ids, names, sizes, held, number
            flat = np.concatenate(ids)
            values = [[part], [number], [len(flat)], [names], [np.concatenate(sizes).tolist()], [range_coder.encode(flat)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            ids, names, sizes, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], SCHEMA.replace(",", "").split()[::2])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            of = batch.column("id").to_pylist()
            for a, b in slices(offsets):
                got, size = encoder.slice(data, offsets[a : b + 1])
                ids.append(got)
                sizes.append(size)
                names += of[a:b]
                held += len(got)
                if held >= chunk:
                    yield out()
        if held:
            yield out()

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def chunk_starts(files: DataFrame) -> DataFrame:
    """(part, chunk, chunk_start): ids before each chunk. Parts are summed first, so the ordered window over all of them has a row per task."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("part_start"))
    own = files.select("part", "chunk", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(before("part").orderBy("chunk")), F.lit(0)))
    return own.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("own")).alias("chunk_start"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, place, doc_id, ids): the decoded documents, each with its end id. A damaged chunk fails the job."""
    return _decoded(spark, path, lambda ids, ends: [ids[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:])], "ids", "array<long>", pa.list_(pa.int64()))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, place, doc_id, start_in_chunk, n_tokens, ids_crc32) of the decoded documents: crc32 of little-endian 32-bit ids."""

    def crcs(ids, ends):
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]

    return _decoded(spark, path, crcs, "ids_crc32", "long", pa.int64())


def _decoded(spark: SparkSession, path: str, of_documents, column: str, ddl: str, kind: pa.DataType) -> DataFrame:
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = range_coder.decode(batch.column("payload")[row].as_py())
                lengths = batch.column("lengths")[row].values.to_numpy()
                ends = np.r_[0, np.cumsum(lengths)]
                n = len(lengths)
                if ends[-1] != len(ids):
                    raise ValueError("document lengths don't add up to the chunk's ids")
                for a in range(0, n, 5000):
                    b = min(a + 5000, n)
                    at = [np.full(b - a, batch.column(c)[row].as_py(), np.int32) for c in ("part", "chunk")]
                    values = [*map(pa.array, at), pa.array(np.arange(a, b, dtype=np.int32)), batch.column("doc_ids")[row].values.slice(a, b - a), pa.array(ends[a:b]), pa.array(lengths[a:b]), pa.array(of_documents(ids, ends[a : b + 1]), kind)]
                    yield pa.RecordBatch.from_arrays(values, ["part", "chunk", "place", "doc_id", "start_in_chunk", "n_tokens", column])

    return files.mapInArrow(run, f"part int, chunk int, place int, doc_id long, start_in_chunk long, n_tokens long, {column} {ddl}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files."""
    starts = chunk_starts(spark.read.schema(SCHEMA).parquet(path).select("part", "chunk", "n_ids"))
    rows = read_checksums(spark, path).join(starts, ["part", "chunk"])
    return rows.select("doc_id", (F.col("chunk_start") + F.col("start_in_chunk")).alias("start"), "n_tokens", "ids_crc32")
