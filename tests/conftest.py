import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus="8", partitions="4", memory="6g")


@pytest.fixture(scope="session")
def path_of_prices():
    """A jumpy but reproducible price path per series."""
    import numpy as np

    def make(n, seed):
        rng = np.random.default_rng(seed)
        return np.round(100 * np.exp(np.cumsum(rng.normal(0.0003, 0.012, n))), 6)

    return make
