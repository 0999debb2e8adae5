from collections import Counter

import numpy as np
import pytest

from tidemark.llm import sharding


def test_table_is_filled_by_turns():
    """Plain replay on a small prime: each shard in turn takes the first free slot it prefers."""
    import hashlib

    names, size = ["a", "b", "c"], 13
    prefer = {}
    for x in names:
        d = hashlib.sha256(x.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefer[x] = [(offset + k * skip) % size for k in range(size)]
        assert sorted(prefer[x]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for x in names:
            if len(owner) < size:
                owner[next(s for s in prefer[x] if s not in owner)] = x
    assert [names[k] for k in sharding.fill(dict.fromkeys(names, 1), size)] == [owner[s] for s in range(size)]


def test_even_and_stable():
    shards = {f"s{k}": 1 for k in range(50)}
    owner = sharding.fill(shards)
    assert np.ptp(np.bincount(owner)) <= 1
    names = sorted(shards)
    fewer = {k: v for k, v in shards.items() if k != "s7"}
    after = sharding.fill(fewer)
    moved = np.mean([names[a] != sorted(fewer)[b] for a, b in zip(owner, after)])
    assert moved < 0.06  # 0.02 had to move
    weighted = np.bincount(sharding.fill({"a": 3, "b": 1}))
    assert abs(weighted[0] / weighted[1] - 3) < 0.01


@pytest.mark.parametrize("shards, size", [({}, 7), ({"a": 1}, 8), ({"a": 0}, 7), ({str(k): 1 for k in range(9)}, 7)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.fill(shards, size)


def test_awkward_rows(awkward, empty, tmp_path):
    shards = {f"s{k}": 1 for k in range(5)}
    placed = sharding.place(awkward, shards)
    assert placed.columns == [c for c in awkward.columns if c != "shard"] + ["shard"] or set(placed.columns) == set(awkward.columns)
    rows = placed.collect()
    assert len(rows) == awkward.count() and all(r.shard in shards for r in rows)
    for doc in {r.doc_id for r in rows} - {None}:
        assert len({r.shard for r in rows if r.doc_id == doc}) == 1
    assert sharding.place(empty, shards).count() == 0
    sharding.write_shards(awkward, str(tmp_path / "out"), shards)
    back = awkward.sparkSession.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard for r in back.collect()) == Counter(r.shard for r in rows)
