import sys
from pathlib import Path

import random

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, or from (id, text) pairs."""

    def build(texts, **more):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 7}", len(t or "")) for i, t in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded texts with words of few letters, so that pieces repeat."""

    def build(seed, n, low=5, high=120, words=400):
        rng = random.Random(seed)
        return [" ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(rng.randint(low, high))) for _ in range(n)]

    return build


