"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests_llm_odd import ODD
from tidemark.llm import periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def smallest_period(w):
    """By borders."""
    fail = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def brute_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def brute(doc_id, text, plant):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join("%d,%d,%d\n" % r for r in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(w), len(runs), *own, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts():
    rng = random.Random(5)
    word = lambda k: f"w{rng.randrange(k)}"
    out = []
    for k in (1, 2, 3, 50):
        out += [" ".join(word(k) for _ in range(rng.randrange(120))) for _ in range(25)]
    for q in [*range(1, 20), 31, 32, 33, 63, 64, 65, 100]:
        for k in (2, 3, 1000):
            root = [word(k) for _ in range(q)]
            n = int(q * rng.choice((3, 3.9, 4, 4.1, 5.5, 9))) + rng.randrange(2)
            out.append(" ".join([word(4) for _ in range(rng.randrange(30))] + (root * 12)[:n] + [word(4) for _ in range(rng.randrange(30))]))
    inner = "a a a a a a b " * 5  # runs inside the root of a run
    out += [inner * 1 + ("x " + inner + "y ") * 6, ("a " * 40 + "b ") * 5, ("c d " * 9 + "e ") * 7 + "c d"]
    a, b = "a", "a b"
    for _ in range(9):  # Fibonacci words
        a, b = b, b + " " + a
    return [*ODD, *out, b, "z " * 500]


def test_runs(make):
    rows = texts()
    rows = list(enumerate(rows)) + [(None, "a " * 9), (3, rows[3])]
    for plant in (False, True):
        got = periodic_runs.periodic_runs(make(rows).withColumnRenamed("n_chars", "start"), plant=plant).collect()
        assert sorted(map(repr, ((r.doc_id, *r[1:]) for r in got))) == sorted(repr((i, *brute(i, t, plant))) for i, t in rows)
    assert periodic_runs.periodic_runs(make([]), plant=True).collect() == []


@pytest.mark.parametrize("chunk", [1, 100])
def test_chunks(monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    rows = texts()[:150]
    got = periodic_runs.describe(list(range(150)), [None if t is None else t.encode() for t in rows], True)
    assert got == [brute(i, t, True) for i, t in enumerate(rows)]


def test_long_text_and_sparse_sets():
    rng = np.random.default_rng(1)
    root = rng.integers(0, 9, 5_000)
    codes = np.concatenate((rng.integers(0, 9, 30_000), np.tile(root, 6)[:27_000], rng.integers(0, 9, 10_000), np.full(100_000, 3))).astype(np.int32)
    runs = [r for r in periodic_runs.find_runs(codes, len(codes)) if r[2] > 7 or r[1] > 100]
    assert [r[2] for r in runs] == [5_000, 1] and runs[0][1] >= 27_000 and runs[1][1] >= 100_000
    assert len(periodic_runs._proposals(np.full(5_000, 7, np.uint64), 8, np.ones(5_008, bool))[0]) == 0
