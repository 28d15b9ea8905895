"""Dedup operators against brute force, and their edge cases."""

import hashlib
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests_llm_odd import ODD
from tidemark.llm import exact_dedup, line_dedup, simhash_dedup, substring_dedup
from tidemark.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_substring(docs, size):
    """(n_words, n_removed, digest) by id."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("size, gram", [(50, 10), (12, 5)])
def test_substring_dedup(make, prose, size, gram):
    texts = prose(1, 120)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t if i % 5 else f"{t} {passage} {texts[i - 1]}" for i, t in enumerate(texts)] + texts[:10] + [passage] * 3 + [t for t in ODD]
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(make(docs), size=size, gram=gram).collect()}
    assert got == brute_substring(docs, size)


def test_substring_dedup_texts_and_repeats(make):
    p = " ".join(f"p{i}" for i in range(55))
    df = make([(1, p), (2, "lead " + p + " tail"), (2, "lead " + p + " tail"), (None, p), (None, None)]).withColumn("digest", F.lit(1)).withColumn("kept", F.lit("clash"))
    rows = substring_dedup.dedup(df, texts=True).collect()
    assert len(rows) == 5
    two = [r for r in rows if r.doc_id == 2]
    assert [(r.kept, [tuple(x) for x in r.removed]) for r in two] == [("lead tail", [(1, 56)])] * 2
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (1, None))
    assert substring_dedup.dedup(df.limit(0)).collect() == []


def brute_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_and_components(make, prose):
    texts = prose(2, 40, 150, 300) + [None, "", "A b", "a B", "one two three", "  "]
    texts += [t + " w1" for t in texts[:30]] + [t.replace("w2 ", "w3 ", 1) for t in texts[:30]]
    got = {r.doc_id: r for r in simhash_dedup.cluster(make(texts).withColumn("fp", F.lit(0))).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                linked += fps[i] != fps[j]
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert linked > 0
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small_key", [2, 24])
def test_links_lose_nothing(spark, monkeypatch, small_key):
    """Crowded and sparse keys give the components of brute force."""
    monkeypatch.setattr(simhash_dedup, "SMALL_KEY", small_key)
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(25):
            fps.add(x)
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
    fps = sorted(fps)
    rows = [(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)]
    labels = {r.node: r.label for r in components(simhash_dedup.links(spark.createDataFrame(rows, "fp long, node long"))).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert [labels.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_golay_keys_meet_within_two_bits():
    code, rng = simhash_dedup.Golay(), np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    (ra, ka), (rb, kb) = simhash_dedup.golay_keys(a, code), simhash_dedup.golay_keys(a ^ flips, code)
    assert {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))} == set(range(3000))


def test_near_duplicates_drop(make):
    kept = simhash_dedup.drop_near_duplicates(make([(5, "same words here again"), (3, "same words here again"), (9, "quite other text entirely"), (None, "x"), (7, None), (8, "")]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 9), (True, 0)]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash_dedup.cluster(make([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_dedup(make, support):
    texts = ["hot"] * 60 + ["warm"] * 20 + [f"t{i % 23}" for i in range(70)] + ODD
    df = make(texts).withColumn("row", F.lit(1)).withColumn("text_sha256", F.lit("clash"))
    got = {r.doc_id: r for r in exact_dedup.membership(df, support=support).collect()}
    for i, t in enumerate(texts):
        group = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest())
    kept = exact_dedup.drop_duplicates(df, support=support)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_exact_dedup_repeats_and_nulls(make):
    df = make([(4, "a"), (4, "a"), (None, "a"), (None, "b"), (None, "b")])
    rows = exact_dedup.membership(df).collect()
    assert sum(r.kept for r in rows) == 2 and len(rows) == 5
    assert sorted(str(r.doc_id) + r.text for r in exact_dedup.drop_duplicates(df).collect()) == ["4a", "Noneb"]
    assert exact_dedup.membership(df.limit(0)).collect() == []


def brute_lines(docs, least, leading=3):
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    lines = {i: (t or "").split("\n") for i, t in docs}
    leaf = lambda m: (len(m), m[:leading])
    seen, leaves = {}, {}
    for i, own in lines.items():
        for m in {mask(x) for x in own} - {()}:
            seen.setdefault(m, set()).add(i)
            leaves.setdefault(leaf(m), set()).add(i)
    often = {m: d for m, d in seen.items() if len(leaves[leaf(m)]) >= least}
    at = {}
    for m, d in often.items():
        for k in range(leading, len(m)):
            if m[k] != "<*>":
                at.setdefault((leaf(m), k, m[k]), set()).update(d)
    template = {m: m[:leading] + tuple(x if len(at.get((leaf(m), leading + k, x), ())) >= least else "<*>" for k, x in enumerate(m[leading:])) for m in often}
    total = {}
    for m, t in template.items():
        total.setdefault(t, set()).update(often[m])
    dropped = {m for m, t in template.items() if len(total[t]) >= least and 2 * sum(x != "<*>" for x in t) >= len(t)}
    return {i: (len(own), sum(mask(x) in dropped for x in own), "\n".join(x for x in own if mask(x) not in dropped)) for i, own in lines.items()}


def test_line_dedup(make, prose):
    lines = prose(3, 90, 1, 12)
    texts = [f"{a}\nError {i} at line {i * 7} in module core\n{a}\nAll rights reserved.\nHello {'x' if i % 2 else 'y'}{i} dear user of the site" if i % 3 else f"{a}\n\n{a}" for i, a in enumerate(lines)] + [t for t in ODD]
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup(make(docs).withColumn("line", F.lit(0)), min_docs=6).collect()}
    assert got == brute_lines(docs, 6)
    assert got[1][1] >= 2


def test_line_dedup_counts_documents(make):
    """A document with many lines of one template does not make it recur; ten documents with one each do."""
    alone = "\n".join(f"Job step {'abcdefghijkl'[i] * 3} of the nightly run has ended well" for i in range(12))
    shared = [f"Backup of disk {'abcdefghij'[i] * 4} on host main was made today\nOwn line {i} x" for i in range(10)]
    both = ["Backup of disk zzzz on host main was made today\nBackup of disk yyyy on host main was made today"]
    docs = list(enumerate([alone, *shared, *both]))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup(make(docs), min_docs=10).collect()}
    assert got == brute_lines(docs, 10)
    assert got[0][1] == 0 and all(got[i][1] == 2 for i in range(1, 11)) and got[11][1] == 2
    nine = list(enumerate([*shared[:8], *both]))
    assert all(r.n_removed == 0 for r in line_dedup.dedup(make(nine), min_docs=10).collect())


def test_line_dedup_edges(make):
    df = make([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None)])
    assert sorted((r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup(df, min_docs=3).collect()) == [(1, 0, ""), (1, 1, ""), (1, 1, ""), (1, 1, "")]
    assert line_dedup.dedup(df.limit(0)).collect() == []


def test_line_dedup_of_one_long_document(make):
    """The lines of a document are not compared with each other: 120,000 different ones are done in time."""
    letters = "abcdefghij"
    name = lambda i: "".join(letters[int(d)] for d in str(i))
    long = "\n".join(f"the entry {name(i)} is\there" for i in range(120_000))
    docs = [(0, long), *((i, f"All rights reserved {i}\n{name(i)}") for i in range(1, 12))]
    line_dedup.dedup(make(docs[1:]), min_docs=10).collect()
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup(make(docs), min_docs=10).collect()}
    assert time.perf_counter() - began < 60
    assert got[0] == (120_000, 0, long) and all(got[i] == (2, 1, name(i)) for i in range(1, 12))
