import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.llm.boosting import fit


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {i for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_plain_counts(awkward, random_texts, spark):
    forest = fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), np.zeros(len(quality.FEATURES)))
    both = awkward.select("doc_id", "text", "kept").union(spark.createDataFrame([(k, t, "") for k, t in enumerate(random_texts)], "doc_id long, text string, kept string"))
    rows = quality.score(both, forest).collect()
    assert len(rows) == both.count()
    for r in rows:
        want = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_monotone_trees_learn_and_keep_their_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1])) > 0.6).astype(float)
    forest = fit(x, y, np.array([1, 0, -1]))
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.95
    grid = np.tile(rng.random((40, 1, 3)), (1, 50, 1))
    for feature, sign in ((0, 1), (2, -1)):
        moved = grid.copy()
        moved[:, :, feature] = np.linspace(0, 1, 50)
        p = forest.probability(moved.reshape(-1, 3)).reshape(40, 50)
        assert (sign * np.diff(p, axis=1) >= -1e-12).all()


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_without_two_classes_the_model_is_constant(y):
    forest = fit(np.zeros((len(y), 2)), np.array(y), np.zeros(2))
    assert len(set(forest.probability(np.random.default_rng(1).random((5, 2))))) == 1


def test_held_out_accuracy(spark):
    """Fitted on the labels of even ids, the verdict agrees with those of odd ids."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(docs, labels.where("doc_id % 2 = 0"))
    test = quality.score(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").select("kept", labels["quality"].alias("label")).collect()
    assert np.mean([r.kept == (r.label == 1) for r in test]) > 0.95


def test_train_on_nothing(empty, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    forest = quality.train(empty, labels)
    assert quality.score(empty, forest).count() == 0
