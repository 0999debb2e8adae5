"""Links over several size rings, at limits below 67 %."""

import numpy as np
import pytest

from tidemark.llm import jaccard


@pytest.mark.parametrize("percent", [90, 80, 67, 50, 30])
def test_linked_sets_share_a_region(percent):
    """A set and the largest one that it is linked with, alone, so that no other set leads from one to the other."""
    rng = np.random.default_rng(5)
    for small in (40, 60, 100, 230):
        sizes = np.array([small, 100 * small // percent])
        large = np.sort(rng.integers(0, 2**63, sizes[1]).astype(np.uint64))
        hashes = np.concatenate([np.sort(rng.permutation(large)[:small]), large])
        owner, region, tag = jaccard.regions_of(np.repeat([0, 1], sizes), hashes, sizes, percent)
        sides = [dict(zip(region[owner == k].tolist(), tag[owner == k].tolist())) for k in (0, 1)]
        assert kept(*sides)


def kept(a, b):
    """Some ring in which two sets (region to tag) share as many regions as both of them need."""
    shared = {}
    for r in set(a) & set(b):
        assert a[r] >> 16 == b[r] >> 16
        shared.setdefault((a[r], b[r]), []).append(r)
    return any(len(x) >= max(tags[0] & 0xFFFF, tags[1] & 0xFFFF) for tags, x in shared.items())


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_the_regions_that_they_need(percent):
    """Sets of equal and unequal sizes at the limit, with elements replaced on both sides."""
    rng = np.random.default_rng(percent)
    for n in (12, 30, 60, 150, 400, 1500):
        for _ in range(25):
            whole = rng.integers(1, 2**63, n, dtype=np.uint64)
            lost = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            more = int((100 * (n - lost) - percent * n) // percent)
            b = np.r_[whole[lost:], rng.integers(1, 2**63, max(0, int(rng.integers(0, more + 1))), dtype=np.uint64)]
            assert 100 * (n - lost) >= percent * (n + len(b) - (n - lost))
            sides = []
            for s in (whole, b):
                _, region, tag = jaccard.regions_of(np.zeros(len(s), np.int64), np.sort(s), np.array([len(s)]), percent)
                sides.append(dict(zip(region.tolist(), tag.tolist())))
            assert kept(*sides), (n, lost, len(b))
