"""Documents with every awkward case, for all operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, __n int, score string, kept string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null columns, empty, blank and very long texts, copies, repeated rows, and columns named like results."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["the", "of", "Wald", "und", "él", "niño", "x1", "mot,", "a"]) for _ in range(n))
    long = some(30_000)
    texts = [None, "", " \t\n", "one", "one two", "One TWO three", some(40), some(200), long, "日本語 テキスト です", "!!! ... 123", "a\n\na\nb\n"]
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s2", None][i % 3], None if i % 4 == 0 else 7, "mine", i, "s", None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (50, texts[7], "de", "s1", 1, None, 0, "", ""), (None, texts[6], "en", "s2", 1, "x", 1, "y", "z"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def random_texts():
    """Texts over few words, with near copies and shared passages."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 30, 80, 160, 300]))]
        if k % 4 == 0:
            text[len(text) // 2 : len(text) // 2] = passage
        out.append(text)
        if k % 3 == 0 and text:
            for _ in range(rng.randint(1, 4)):
                near = list(text)
                for _ in range(rng.randint(0, 1 + len(near) // 60)):
                    near[rng.randrange(len(near))] = rng.choice(words)
                out.append(near)
    return [" ".join(x) for x in out]
