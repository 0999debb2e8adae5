import itertools
import random

from tidemark.operators import news as nws
from tidemark.operators.groups import connected


def brute(docs, percent=80, n=5):
    """The least id that links reach, by comparing all pairs."""
    sets = {}
    for d, text in docs:
        words = (text or "").lower().split()
        if words:
            sets[d] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if 100 * len(x & y) >= percent * len(x | y):
            links += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in docs}, links


def groups(spark, docs):
    df = spark.createDataFrame(docs, "doc long, text string")
    return {r["doc"]: r["group"] for r in nws.near_copies(df, "doc", "text").collect()}


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_edited_reprints_equal_brute_force(spark):
    rng, docs = random.Random(5), []
    for story in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for changes in [0] * rng.randrange(4) + [1, 2, 4, 9]:
            docs.append((len(docs), edited(base, rng, changes)))
    # edits of edits: the ends of the chain are linked only through the texts between
    chain = [f"c{i}" for i in range(300)]
    for step in range(12):
        docs.append((len(docs), " ".join(chain)))
        chain[step * 20 + 7] = f"d{step}"
    want, links = brute(docs)
    got = groups(spark, docs)
    assert links > 100 and len(set(want.values())) < len(docs)
    right = sum(got[d] == want[d] for d in want)
    assert right >= 0.98 * len(docs)
    # what is linked is linked by exact counts: no group spans two of the true ones
    assert all(want[d] == want[got[d]] for d in want)


def test_large_family_is_one_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, edited(base, rng, 1)) for i in range(600)] + [(600 + i, " ".join(base)) for i in range(600)]
    assert set(groups(spark, docs).values()) == {0}


def test_texts_without_words_are_alone(spark):
    docs = [(1, None), (2, ""), (3, " .,! "), (4, "one two"), (5, "One, two!"), (6, "one"), (7, None)]
    assert groups(spark, docs) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert groups(spark, []) == {}


def test_connected(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5), (None, 3), (4, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
