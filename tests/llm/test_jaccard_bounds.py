"""What tasks of the join hold and compare stays bounded, and texts are found again by their hash."""

import numpy as np
import pyarrow as pa

from tidemark.llm import jaccard
from tidemark.llm.words import buffers


def near_texts(n, words=200):
    return [" ".join(f"w{k}" if k != 3 * i % words else f"x{i}" for k in range(words)) for i in range(n)]


def test_members_of_a_large_group_are_joined_by_few_links():
    """Before, each two of 60 near texts gave a pair."""
    raw = [x.encode() for x in near_texts(60)]
    cls, regions = np.arange(60) + 100, [np.array([1])] * 60
    a, b = jaccard._links_within(raw, cls, cls.copy(), regions, 3, 90)
    root = {int(c): int(c) for c in cls}
    for x, y in zip(a.tolist(), b.tolist()):
        root = {k: root[x] if v == root[y] else v for k, v in root.items()}
    assert len(a) == 59 and len(set(root.values())) == 1


def test_links_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    raw = []
    for k in range(90):
        text = [f"{k % 7}b{j}" for j in range(120)]
        for at in rng.integers(0, 120, rng.integers(1, 5)):
            text[at] = f"x{rng.integers(0, 9)}"
        raw.append(" ".join(text).encode())
    cls, label = np.arange(90), np.arange(90) // 2 * 2
    regions = [np.array([7])] * 90
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for t in (r.decode() for r in raw)]
    want = [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]

    def groups(links):
        root = label.copy()
        for i, j in links:
            root[root == root[i]] = root[j]
        return {tuple(np.flatnonzero(root == r)) for r in set(root.tolist())}

    got = list(zip(*(x.tolist() for x in jaccard._links_within(raw, cls, label, regions, 3, 90))))
    assert set(got) <= {(i, j) for a, b in want for i, j in ((a, b), (b, a))} and groups(got) == groups(want)


def test_regions_are_given_out_while_texts_are_read(monkeypatch):
    """Before, a task held the regions of all its texts."""
    monkeypatch.setattr(jaccard, "HELD_ROWS", 50)
    read = []

    def batches():
        for k in range(20):
            read.append(k)
            text = pa.array([" ".join(f"{k}-{i}-{j}" for j in range(300)) for i in range(3)])
            yield pa.RecordBatch.from_arrays([text], ["__text"])

    out = jaccard._members_in_task(batches(), 3, 90)
    first = next(out)
    assert len(read) == 1 and first.num_rows >= 50
    many = pa.Table.from_batches([first, *out])
    monkeypatch.setattr(jaccard, "HELD_ROWS", 10**9)
    one = pa.Table.from_batches(list(jaccard._members_in_task(batches(), 3, 90)))
    of = lambda t: sorted(zip(t["key"].to_pylist(), t["class"].to_pylist(), t["tag"].to_pylist()))
    assert of(many) == of(one)


def test_texts_are_cut_once_for_sets_and_once_for_regions(spark, monkeypatch):
    """Before, texts were cut into shingles again to be sent and to be kept."""
    calls = []
    keyed = jaccard.keyed
    monkeypatch.setattr(jaccard, "keyed", lambda *a, **b: calls.append(1) or keyed(*a, **b))
    text = near_texts(4)
    rows = [(1, text[0]), (2, text[1]), (2, text[1].replace(" ", "\n")), (2, text[1]), (3, None), (4, " \n\t\x0b"), (5, "\x1c"), (None, text[2]), (6, "far away from all")]
    kept = jaccard.one_per_component(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(calls) == 1
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id != 3) == [(1, text[0]), (4, " \n\t\x0b"), (5, "\x1c"), (6, "far away from all")]
    assert [r.text for r in kept if r.doc_id == 3] == [None]


def test_packed_texts_are_whole():
    import zstandard

    texts = pa.array(["a b", None, "", "é" * 999])
    got = [zstandard.ZstdDecompressor().decompress(x).decode() for x in jaccard._pressed(zstandard.ZstdCompressor(), *buffers(texts)).to_pylist()]
    assert got == ["a b", "", "", "é" * 999]
