"""The pipeline's near copies against brute force at 5 words and 0.8."""

import random

import corpus_pipeline
import test_jaccard

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(rng, first):
    """A text, a copy with 15 % appended, and one with 20 spread edits: both within 5 words and 0.8, not within 3 words and 0.9."""
    text = [f"w{rng.randrange(10**9)}" for _ in range(1000)]
    more = [f"w{rng.randrange(10**9)}" for _ in range(150)]
    edited = [f"e{k}" if k % 50 == 25 else w for k, w in enumerate(text)]
    return [(first + k, " ".join(w), "en", "s", 1) for k, w in enumerate((text, text + more, edited))]


def test_near_copies_at_five_words(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select(NAMES)
    docs = table.unionByName(spark.createDataFrame(planted(random.Random(3), 10**6), table.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    loose = {c if n else d for d, n, c in test_jaccard.brute(rows)}
    want = {c if n else d for d, n, c in test_jaccard.brute(rows, 80, n=5)}
    got = sorted(r.doc_id for r in corpus_pipeline.join(spark, docs, SF).collect())
    assert got == sorted(want) and {10**6 + 1, 10**6 + 2} <= loose - want
