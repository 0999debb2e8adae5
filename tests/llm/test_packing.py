"""Packing against the library's ids: every id once, no gaps, no padding but at powers of two."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries
from test_tokens import random_lines

JSON = open(queries.tokenizer_file("word_bpe_49k.json"), encoding="utf-8").read()


def library(texts):
    t = Tokenizer.from_str(JSON)
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs, length):
    """rows: pieces with ids; docs: {id: ids}."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        assert ids == docs[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(docs[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, whole in ((pieces, {d: len(x) for d, x in docs.items()}), (sequences, None)):
        for name, spans in parts.items():
            at = 0
            for start, size in sorted(spans):
                assert start == at
                at += size
            assert at == whole[name] if whole else at == length or at < length and at & (at - 1) == 0
    assert set(pieces) == set(docs)
    short = sum(1 for s in sequences.values() if sum(x for _, x in s) < length)
    assert short <= length.bit_length()


def encoded(encoder, texts):
    return [[*ids.tolist(), 1] for ids in encoder.encode_all([t.encode() for t in texts])]


@pytest.mark.parametrize("segment", [50, 10**6])
def test_encoder_equals_the_library(monkeypatch, segment):
    monkeypatch.setattr(packing, "SEGMENT", segment)
    texts = random_lines(1500, 4) + ["", "a" * 300 + " b", "Ünï CAFÉ don't we'LL 123 ΑΣ ΑΣ́", "e\u0301 é \u0301a", "İstanbul ŒUVRE Ĳ ŉ ſ ÿŸ I\u0307"]
    assert encoded(packing.WordEncoder(JSON), texts) == library(texts)


def test_letters_digits_and_signs_are_cut_as_by_the_library():
    rng = random.Random(6)
    some = [chr(c) for c in (*range(0x21, 0x180), 0x300, 0x301, 0x307, 0x2019, 0x4E00)]
    texts = ["".join(rng.choice(rng.choice([some, "abc1,.'ß"])) for _ in range(rng.randint(1, 8))) for _ in range(20_000)] + some + [2 * c for c in some]
    assert encoded(packing.WordEncoder(JSON), texts) == library(texts)


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encoder, texts = packing.WordEncoder(JSON), random_lines(60, 8)
    assert encoded(encoder, texts * 2) == library(texts * 2)


@pytest.mark.parametrize("fan_in", [2, 256])
def test_pieces_of_many_tasks(spark, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Quick", "xyzzyq", "ünd", "4711"]) for _ in range(rng.choice([0, 1, 5, 20, 90, 200]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(11)
    check(packing.pack(df, JSON, length=64).collect(), dict(enumerate(library(texts))), 64)


def test_awkward_rows(spark, awkward, empty):
    rows = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = {r.doc_id: r.text for r in rows.collect()}
    check(packing.pack(rows, JSON).collect(), dict(zip(docs, library(docs.values()))), packing.LENGTH)
    # repeated rows and null ids are documents of their own
    got = packing.pack(awkward, JSON, with_ids=False).collect()
    assert sum(r.length for r in got) == sum(map(len, library([r.text for r in awkward.collect()]))) and all(r.ids is None for r in got)
    assert packing.pack(empty, JSON).count() == 0


def test_best_fit_and_fullest():
    packer = packing.Packer(length=10, windows=2)
    ids = lambda n: np.arange(n, dtype=np.int32)
    assert list(packer.add("a", ids(6))) == [] and list(packer.add("b", ids(5))) == [] and packer.used == [6, 5]
    # fits in both: the fuller one
    assert list(packer.add("c", ids(2))) == [] and packer.used == [8, 5]
    # fits in the emptier one alone
    assert list(packer.add("d", ids(4))) == [] and packer.used == [8, 9]
    # fits in none: the fullest is filled up and emitted
    (out,) = packer.add("e", ids(4))
    assert [(p[0], p[1], len(p[2])) for p in out] == [("b", 0, 5), ("d", 0, 4), ("e", 0, 1)] and packer.used == [8, 3]
    # whole sequences of a long document pass through
    out = list(packer.add("f", ids(22)))
    assert [[(p[0], p[1], len(p[2])) for p in s] for s in out[:2]] == [[("f", 0, 10)], [("f", 10, 10)]]
    assert sum(len(p[2]) for p in packer.rest()) + sum(len(p[2]) for s in out[2:] for p in s) == 13
