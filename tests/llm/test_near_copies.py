"""Near copies planted at known similarities, held against brute force."""

import random

import pytest

from tidemark.llm import near_copies, simhash_dedup


def similarity(a, b):
    x, y = near_copies.shingles(a, 5), near_copies.shingles(b, 5)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [4, 64])
def test_planted_near_copies(make, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng, texts = random.Random(3), []
    for n in (60, 100, 300, 500):
        for _ in range(8):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for changed in (1, max(1, n // 100), n // 60, n // 20):
                copy = list(base)
                for i in rng.sample(range(n), changed):
                    copy[i] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(copy))
    base = [f"v{i}" for i in range(120)]
    texts += [" ".join([*base[:i], f"y{i}", *base[i + 1 :]]) for i in range(30)]  # a crowded group
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = sorted(r.doc_id for r in simhash_dedup.drop_near_duplicates(make(texts)).collect())
    assert kept == [i for i in range(len(texts)) if root[i] == i] and len(kept) < len(texts) / 2


def test_simhash_families_are_compared(make, monkeypatch):
    """By the SimHash step alone: of texts whose fingerprints lie within two bits, and that are alike, one stays."""
    monkeypatch.setattr(near_copies, "STEPS", near_copies.STEPS[:1])
    rng, texts = random.Random(8), []
    for n in (60, 300, 900):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts += [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in rng.sample(range(n), 8)]
    fps = [near_copies.simhash(near_copies._hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(make(texts)).collect()}
    # members of a family are all compared, so that a chain of fingerprints may tie more
    assert kept <= set(root) and len(set(root)) < len(texts) - 40 and len(kept) > 20


def pages(n, shared, own, seed=5):
    """Pages of one template: ``shared`` words in common, ``own`` words of their own, in runs of ten."""
    rng = random.Random(seed)
    out = []
    for p in range(n):
        runs = [[f"t{10 * i + k}" for k in range(10)] for i in range(shared // 10)]
        for i in range(own // 10):
            runs.insert(rng.randrange(len(runs) + 1), [f"p{p}_{10 * i + k}" for k in range(10)])
        out.append(" ".join(w for r in runs for w in r))
    return out


def test_pages_of_a_template_make_no_pairs(spark, make, monkeypatch):
    """Crowded fingerprints of texts that are not alike: candidates of the exact join do not grow with the square."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    made = {}
    keep = near_copies._meetings

    def counted(rows, share):
        found = keep(rows, share)
        made["pairs"] = found.count()
        return found

    monkeypatch.setattr(near_copies, "_meetings", counted)
    texts = pages(60, 290, 110)
    texts += [texts[7].replace("p7_30", "other"), texts[9].replace("p9_40", "other")]
    kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(make(texts)).collect()}
    assert kept == set(range(60)) and made["pairs"] <= 10


def test_prefix_filter_loses_no_pair(spark):
    """The exact join alone finds all pairs at 0.8, at and around the bound."""
    rng, texts = random.Random(11), []
    for n in (9, 10, 24, 60, 200):
        base = [f"b{n}_{i}" for i in range(n + 4)]
        texts += [" ".join(base[: n + 4 - k]) for k in range(0, n // 2, max(1, n // 20))]
        texts += [" ".join([*base[:i], "z", *base[i + 1 :]]) for i in rng.sample(range(n), 5)]
    texts += pages(12, 290, 30, 2)
    base = [f"c{i}" for i in range(90)]  # copies of one text, changed at one or two places each
    for _ in range(60):
        copy = list(base)
        for i in rng.sample(range(90), rng.choice((1, 2, 2, 3))):
            copy[i] = f"{copy[i]}x"
        texts.append(" ".join(copy))
    nodes = [(str(i).zfill(4).encode(), t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(nodes, "node binary, text string")
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def tie(i, j):
        x, y = sorted((find(i), find(j)))
        root[y] = x

    for i, t in enumerate(texts):
        for j in range(i):
            if similarity(t, texts[j]) >= 0.8 - 1e-12:
                tie(i, j)
    want = [find(i) for i in range(len(texts))]
    root[:] = range(len(texts))
    found = near_copies.crowded_links(table.selectExpr("substr(node, 1, 1) AS key", "node", "node AS label"), table, 5, 0.8).collect()
    for r in found:
        i, j = int(bytes(r.a)), int(bytes(r.b))
        assert similarity(texts[i], texts[j]) >= 0.8 - 1e-12
        tie(i, j)
    assert [find(i) for i in range(len(texts))] == want and len(set(want)) < len(texts) - 40
