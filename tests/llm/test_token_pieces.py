"""Distinct pieces go to the library many at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, token_output
from tidemark.llm.words import buffers

BPE = open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()


def test_pieces_are_joined_and_told_apart():
    """Before, the library got one text for each distinct piece. Pieces that begin a document don't begin at a space."""
    t = Tokenizer.from_str(BPE)
    t.encode_special_tokens = True
    texts = [f"{a}w{k}{b} x{k}é{c} 日{k}'s  y" for k in range(300) for a, b, c in (("", "\n", "\u00a0"), (" ", "  ", "'"), ("s", "'", "<|endoftext|>"))] + ["", " ", "ed", "'s", "\u3000 a"]
    encoder, calls = token_output.Encoder(BPE), []

    class Counting:
        def encode_batch_fast(self, x, **options):
            calls.extend(x)
            return t.encode_batch_fast(x, **options)

        def get_vocab_size(self):
            return t.get_vocab_size()

    encoder.tokenizer = Counting()
    ids, sizes = encoder.slice(*buffers(pa.array(texts)))
    ends = np.r_[0, np.cumsum(sizes)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert len(calls) < 0.7 * len(encoder.known)


def whole(texts):
    t = Tokenizer.from_str(BPE)
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def told_apart(ids, sizes):
    ends = np.r_[0, np.cumsum(sizes)]
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


@pytest.mark.parametrize("seed", range(3))
def test_cuts_at_signs_and_line_ends(seed):
    rng = random.Random(seed)
    parts = ["\n", "\n", " ", "\t", "\r", "a", "The", "don't", "we'll", "'", "'s", ",", ".", "$$", "7", "é", "ß", "\u00a0", "\u3000", "_", "\x7f", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    assert told_apart(*token_output.Encoder(BPE).slice(*buffers(pa.array(texts)))) == whole(texts)


def test_words_are_known_apart_from_signs():
    """Before, a word was encoded anew with each sign or line end after it."""
    texts = [" " + f"word{a}ing{b}next" for a in "abcdefghij" for b in (",", ".", "!", "?", ";\n", ".\n", "\n")]
    encoder = token_output.Encoder(BPE)
    assert told_apart(*encoder.slice(*buffers(pa.array(texts)))) == whole(texts)
    assert len(encoder.known) < 40


def test_tasks_of_a_worker_share_an_encoder():
    """Before, every task read the tokenizer and encoded all its pieces again."""
    assert token_output.encoder_of(BPE) is token_output.encoder_of(BPE)
