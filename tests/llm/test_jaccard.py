import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import components
from tidemark.llm.words import buffers

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent=90, n=3):
    """(n_shingles, component) per row, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def found(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_components(df, **options).collect()), key=repr)


def test_awkward_rows_equal_all_pairs(awkward):
    assert found(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_empty_table(empty):
    assert found(empty) == [] and jaccard.one_per_component(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_random_texts_equal_all_pairs(spark, random_texts, monkeypatch, block):
    """Also with families that fill several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = list(enumerate(random_texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (90, 75)[: 2 if block > 5 else 1]:
        assert found(df, percent=percent) == brute(rows, percent)


def test_a_region_of_many_unlike_members_is_split(spark, monkeypatch):
    """Members that share one region but not a component: all pairs that are near are linked whichever way regions are cut."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 9)):
            text[at] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(text)))
    texts = dict(rows)
    sets = spark.createDataFrame(rows, "doc_id long, text string")
    members = jaccard.keyed(sets, "text", 3).selectExpr("1L AS region", "__class AS class", "doc_id")
    pivot = members.agg({"class": "min"}).first()[0]
    packed = jaccard.keyed(sets, "text", 3, packed=True).selectExpr("__class AS class", "__packed AS packed", "__n AS n").dropDuplicates(["class"])
    labels = jaccard.class_labels(jaccard.written(members.selectExpr("region", "class", f"{pivot}L AS pivot").distinct()), jaccard.written(packed), 3, 90)
    label = {r["class"]: r.label for r in labels.collect()}
    of = {r.doc_id: label.get(r["class"], r["class"]) for r in members.collect()}
    want = {doc: component for doc, _, component in brute(rows)}
    groups = lambda x: sorted(sorted(d for d in x if x[d] == v) for v in set(x.values()))
    assert groups(of) == groups(want) and len(texts) == 60


def test_linked_sets_share_a_region():
    """The promise behind the regions: sets at the limit of the distance are equal in a projection that both keep."""
    rng = np.random.default_rng(2)
    for n in (9, 10, 17, 40, 77, 180, 181, 700, 2500):
        for _ in range(20):
            a = rng.integers(1, 2**63, n, dtype=np.uint64)
            differ = n // 9
            drop = int(rng.integers(0, differ + 1))
            b = np.r_[a[drop:], rng.integers(1, 2**63, (differ - drop), dtype=np.uint64)]
            if 100 * (n - drop) < 90 * (n + differ - drop):
                continue
            got = []
            for s in (a, b):
                s = np.sort(s)
                _, region, _ = jaccard.regions_of(np.zeros(len(s), np.int64), s, np.array([len(s)]))
                got.append(set(region.tolist()))
            assert got[0] & got[1], n


def test_set_of_a_text():
    data, offsets = buffers(pa.array(["A b c A b C", "x", None, "p  q\n", ""]))
    _, _, sizes = jaccard.shingle_sets(data, offsets)
    assert sizes.tolist() == [3, 1, 0, 1, 0]


def test_one_row_of_each_component_stays(awkward):
    kept = jaccard.one_per_component(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    components_with_id = {c for _, n, c in want if n and c is not None}
    assert sorted(r.doc_id for r in rows if shingles(r.text)) == sorted(components_with_id)
    assert sum(not shingles(r.text) for r in rows) == sum(not n for _, n, _ in want)


def test_components(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(k, k + 1) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and a != b:
            ra, rb = root.setdefault(a, a), root.setdefault(b, b)
            for k in [k for k in root if root[k] == max(ra, rb)]:
                root[k] = min(ra, rb)
    assert got == root
