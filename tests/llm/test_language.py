import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.learn(docs.where(~language.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(language.held_out(F.col("doc_id")))
    rows = language.identify(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_counts_equal_plain_trigrams(spark):
    docs = spark.createDataFrame([("Ab, É", "x"), ("ab", "y"), (None, "x"), ("ab", None), ("é", "x")], "text string, lang string")
    got = {(r.lang, r.bucket): r.n for r in language.trigram_counts(docs).collect()}
    bucket = lambda a, b, c: ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16
    a, b, e = ord("a"), ord("b"), "é".encode()
    want = {("x", bucket(0, a, b)): 1, ("x", bucket(a, b, 0)): 1, ("x", bucket(0, *e)): 2, ("x", bucket(*e, 0)): 2, ("y", bucket(0, a, b)): 1, ("y", bucket(a, b, 0)): 1}
    assert got == want


def test_mixtures_are_found(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 3000").orderBy(F.length("text")).collect()}
    mixed = docs["en"][:1500] + "\n" + docs["de"][:1000]
    rows = spark.createDataFrame([(mixed,), (docs["fr"],)], "text string")
    two, one = sorted(language.identify(rows, model).collect(), key=lambda r: r.lang_pred, reverse=True)[::-1]
    assert two.lang_pred == "en" and 0.4 < two.score < 0.8 and set(two.lang_shares) == {"en", "de"}
    assert one.lang_pred == "fr" and one.score > 0.95


def test_em_is_at_a_fixed_point_of_the_likelihood():
    """More rounds never lower the likelihood, and no other proportion does better."""
    rng = np.random.default_rng(6)
    like, doc = rng.random((300, 3)), np.repeat([0, 1], 150)
    fits = [language.proportions(like, doc, 2, np.ones((2, 3)), rounds=n)[1] for n in (1, 5, 50, 400)]
    assert all((b >= a - 1e-9).all() for a, b in zip(fits, fits[1:]))
    for other in rng.dirichlet(np.ones(3), 200):
        assert (fits[-1] >= [np.log(like[doc == d] @ other).sum() - 1e-6 for d in (0, 1)]).all()


def test_awkward_rows(awkward, empty, model):
    rows = language.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter)
        assert has_letter or (r.score == 0 and r.lang_shares == {})
    assert language.identify(empty, model).count() == 0


def test_nothing_learned(awkward, empty):
    assert {r.lang_pred for r in language.identify(awkward, language.learn(empty)).collect()} == {"und"}


def test_held_out_ids(spark):
    import zlib

    got = {r.i: r.h for r in spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "i long").select("i", language.held_out(F.col("i")).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)} | {None: False}
