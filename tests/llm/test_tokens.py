import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import queries, range_coder, token_counts, token_output
from tidemark.llm.words import buffers

BPE = open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()
ALPHABET = [" ", "  ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", "a", "the", "é", "日", "1", "23", ".", "!", "'s", "<|endoftext|>", "🎉", "​", "▁", "\0", "<unk>", "<0x0A>"]


def random_lines(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(vocabulary):
    t = Tokenizer(models.Unigram(list(zip(vocabulary.pieces, vocabulary.scores)), vocabulary.unk_id, vocabulary.byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def counted(vocabulary, texts):
    return token_counts.Counter(vocabulary).slice(*buffers(token_counts._clean(pa.array(texts, pa.string()), token_counts._stand_in(vocabulary)))).tolist()


def test_counts_equal_the_library():
    v = token_counts.from_sentencepiece(queries.tokenizer_file("piece_bpe_32k.model"))
    texts = random_lines(1500, 1) + ["", " ", "the" * 200, "x" * 500 + "日", None]
    assert counted(v, texts) == [len(e.ids) for e in library(v).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_fall_as_in_the_library(fallback):
    rng = random.Random(7)
    for _ in range(60):
        pieces = ["<unk>", *sorted({"".join(rng.choice("abcé日▁") for _ in range(rng.randint(1, 4))) for _ in range(12)})]
        v = token_counts.Vocabulary(pieces, [0.0, *(float(-rng.randint(1, 3)) for _ in pieces[1:])], 0, fallback)
        texts = ["".join(rng.choice("abcé日 x") for _ in range(rng.randint(0, 90))) for _ in range(25)]
        assert counted(v, texts) == [len(e.ids) for e in library(v).encode_batch(texts, add_special_tokens=False)]


def test_count_awkward_rows(awkward, empty):
    v = token_counts.from_sentencepiece(queries.tokenizer_file("piece_bpe_32k.model"))
    t = library(v)
    for r in token_counts.count_tokens(awkward, v, column="score").collect():
        assert r.score == len(t.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(empty, v).count() == 0


def test_forgotten_units_are_counted_again(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    v = token_counts.from_sentencepiece(queries.tokenizer_file("piece_bpe_32k.model"))
    c = token_counts.Counter(v)
    for seed in range(3):
        texts = random_lines(30, seed)
        assert c.slice(*buffers(token_counts._clean(pa.array(texts), token_counts._stand_in(v)))).tolist() == [len(e.ids) for e in library(v).encode_batch(texts, add_special_tokens=False)]


CASES = [[], [5], [0] * 3000, list(range(2500)), [50256] * 1024, [1, 2, 3] * 900, np.random.default_rng(1).integers(0, 50257, 5000).tolist(), np.random.default_rng(2).zipf(1.3, 4000).clip(0, 70_000).tolist()]


@pytest.mark.parametrize("ids", CASES, ids=range(len(CASES)))
def test_round_trip(ids):
    chunk = range_coder.encode(np.array(ids, np.uint32))
    assert range_coder.decode(chunk).tolist() == ids


def test_repeats_are_small():
    assert len(range_coder.encode(np.tile(np.arange(50), 400))) < 20_000 * 2 / 4


def test_damage_is_noticed():
    chunk = bytearray(range_coder.encode(np.arange(5000) % 997))
    chunk[-400] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(chunk))
    with pytest.raises(ValueError):
        range_coder.decode(bytes(chunk[:-4]))
    with pytest.raises(ValueError):
        range_coder.decode(b"something else")


def test_pieces_are_encoded_as_whole_texts():
    t = Tokenizer.from_str(BPE)
    t.encode_special_tokens = True
    texts = random_lines(3000, 5)
    ids, sizes = token_output.Encoder(BPE).slice(*buffers(pa.array(texts)))
    ends = np.r_[0, np.cumsum(sizes)]
    for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == [*e.ids, 0]


@pytest.mark.parametrize("chunk", [3_000_000, 100])
def test_files_hold_all_documents_in_order(spark, awkward, tmp_path, chunk):
    t = Tokenizer.from_str(BPE)
    path = str(tmp_path / "ids")
    token_output.write_ids(awkward, path, BPE, chunk=chunk)
    got = sorted(token_output.digests(spark, path).collect(), key=lambda r: r.start)
    texts = {}
    for r in awkward.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        texts.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in awkward.collect()), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    whole = {(r.part, r.chunk, r.place): r.ids for r in token_output.read_ids(spark, path).collect()}
    assert sum(map(len, whole.values())) == start


def test_empty_table(spark, empty, tmp_path):
    token_output.write_ids(empty, str(tmp_path / "ids"), BPE)
    assert token_output.digests(spark, str(tmp_path / "ids")).count() == 0
    assert json.loads(BPE)["model"]["type"] == "BPE"
