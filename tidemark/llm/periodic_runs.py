"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a maximal stretch of words with smallest period q and a length of at least max(MIN_WORDS, MIN_POWER * q).

Texts are worked on in chunks: the words of several texts become one array of numbers with a mark of its own after each
text, so that nothing repeats across texts.

* Periods below SMALL come from comparing the array with itself moved by the period.
* For a scale s (SMALL, 2 * SMALL, ...) and periods in [s, 2s), a position is in the synchronising set if the least hash
  of the s-word fragments that start at it and at the s positions after it is that of the first or of the last of them.
  Whether a position is in the set depends on the next 2s words alone, so a run holds equal contexts a period apart.
  Fragments inside a run already found with a period of at most s / 4 take no part, which keeps the set sparse there; the
  small periods that this leaves out have been supplied by the smaller scales.
* Next occurrences of equal 2s-word contexts at a distance in [s, 2s) propose a period; the words themselves are then
  compared in both directions, so that every run reported is exact.

Why no run is missed: let a run have period q in [s, 2s) and length L >= 4q.  Unless all s-word fragments that start in
its first 2s positions have periods of at most s / 4 (by Fine and Wilf its first 3s - 1 words would then have one such
period, which would divide q, against q being smallest), one of its first s positions is in the set, and so is the one q
further on, as 3s - 1 + q <= L.  The context is longer than q, so it does not occur in between.  Two different fragments
share a 64-bit hash with odds of about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, pieces
from tidemark.shipping import ship

MIN_WORDS, MIN_POWER = 6, 4
#: Periods below this are found by direct comparison; the smallest scale.
SMALL = 8
#: Words of short texts that are worked on together.
CHUNK = 1 << 18
_TOP = np.uint64(np.iinfo(np.uint64).max)
NAMES = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
SCHEMA = "doc_id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of True that are at least ``least`` long."""
    at = np.flatnonzero(same)
    if len(at) < least:
        return at[:0], at[:0]
    ends = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate(([0], ends + 1))], at[np.concatenate((ends, [len(at) - 1]))]
    long = last - first + 1 >= least
    return first[long], (last - first + 1)[long]


def _least_ahead(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values: minima of blocks from both sides."""
    n = len(h) - size + 1
    padded = np.full(-(-len(h) // size) * size, _TOP)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[size - 1 : size - 1 + n])


def _same_ahead(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from ``a`` and ``b`` (a < b) on, going forwards (step 1) or backwards (-1, both excluded)."""
    found, size = 0, 64
    room = len(codes) - b if step == 1 else a
    while found < room:
        n = min(size, room - found)
        if step == 1:
            differ = codes[a + found : a + found + n] != codes[b + found : b + found + n]
        else:
            differ = (codes[a - found - n : a - found] != codes[b - found - n : b - found])[::-1]
        if differ.any():
            return found + int(differ.argmax())
        found, size = found + n, size * 2
    return found


def _proposals(hashes: np.ndarray, scale: int, quiet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of equal contexts; ``hashes`` are of ``scale``-word fragments, ``quiet`` those that take no part."""
    n = len(hashes) - scale
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.where(quiet[: len(hashes)], _TOP, hashes)
    least = _least_ahead(h, scale + 1)
    at = np.flatnonzero(((least == h[:n]) | (least == h[scale : scale + n])) & (least != _TOP))
    context = _mix(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + scale])
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    apart = at[1:] - at[:-1]
    good = (context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale)
    at, apart = at[:-1][good], apart[good]
    order = np.lexsort((at, apart))
    return at[order], apart[order]


def _add(runs: dict[tuple[int, int], int], start: int, length: int, period: int) -> None:
    """A stretch that is a run of a smaller period as a whole is that run."""
    key = (start, length)
    runs[key] = min(period, runs.get(key, period))


def find_runs(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of an array of numbers, by start and period; no text in it is longer than ``longest``."""
    runs: dict[tuple[int, int], int] = {}
    for q in range(1, min(SMALL, longest // MIN_POWER + 1)):
        starts, lengths = _stretches(codes[:-q] == codes[q:], max(MIN_WORDS, MIN_POWER * q) - q)
        for s, n in zip(starts.tolist(), lengths.tolist()):
            _add(runs, s, n + q, q)
    # the hashes of fragments of 1, 2, 4, ... words
    hashes, size = _mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1
    while MIN_POWER * size <= longest:
        if size >= SMALL:
            edge = np.zeros(len(codes) + 1, np.int32)
            for (s, n), q in runs.items():
                if 4 * q <= size <= n:
                    edge[s] += 1
                    edge[s + n - size + 1] -= 1
            at, apart = _proposals(hashes, size, np.cumsum(edge[:-1]) > 0)
            q, end = 0, 0
            for p, d in zip(at.tolist(), apart.tolist()):
                if d == q and p < end - d:
                    continue
                start = p - _same_ahead(codes, p, p + d, -1)
                q, end = d, p + d + _same_ahead(codes, p, p + d, 1)
                if end - start >= MIN_POWER * d:
                    _add(runs, start, end - start, d)
        hashes = _mix(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:]) if size < len(hashes) else hashes[:0]
        size *= 2
    return sorted((s, n, q) for (s, n), q in runs.items())


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the period that the id plants in them, if it does (ids whose CRC-32 is divisible by ten)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of one text after its id."""
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best: tuple = (None, None, None, None)
    if runs:
        s, n, q = runs[0]
        for run in runs[1:]:
            left, right = run[1] * q, n * run[2]
            if left > right:
                s, n, q = run
        gone = np.zeros(len(words) + 1, np.int32)
        for a, size, period in runs:
            gone[a + period] += 1
            gone[a + size] -= 1
        kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
        best, words_left = (s, n, q, 1000 * n // q), [words[i] for i in kept]
    else:
        words_left = words
    return (len(words), len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(words_left)).hexdigest())


def _chunk(texts: list[list[bytes]]) -> list[tuple]:
    """The columns of several texts, given by their words."""
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    own = flat.indices.to_numpy().astype(np.int32)
    sizes = np.array([len(w) for w in texts])
    ends = np.cumsum(sizes)
    codes = np.insert(own, ends, np.arange(len(texts), dtype=np.int32) + len(flat.dictionary))
    begins = np.concatenate(([0], (ends + np.arange(1, len(texts) + 1))[:-1]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(codes, int(sizes.max(initial=0)))
    owner = np.searchsorted(begins, [s for s, _, _ in runs], "right") - 1
    for (s, n, q), i in zip(runs, owner.tolist()):
        found[i].append((s - int(begins[i]), n, q))
    return [_digests(w, r) for w, r in zip(texts, found)]


def describe(ids: list, texts: list[bytes | None], plant: bool) -> list[tuple]:
    """The columns of each text after its id; texts of like length are worked on together, a long one alone."""
    out: list[tuple] = [()] * len(texts)
    held: list[tuple[int, list[bytes]]] = []

    def flush() -> None:
        for (i, _), row in zip(held, _chunk([w for _, w in held])):
            out[i] = row
        held.clear()

    size = 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or b"")):
        words = (texts[i] or b"").split()
        words = planted(ids[i], words) if plant else words
        if held and size + len(words) > CHUNK:
            flush()
            size = 0
        held.append((i, words))
        size += len(words) + 1
    if held:
        flush()
    return out


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_runs, the run of the greatest power (start, length, period, exponent_milli), digests of
    all runs and of the words that are left when every run keeps its first period alone.

    Words are runs of anything but ASCII white space.  Null, empty and blank texts have no words and no runs (nulls for
    the run, digests of nothing).  Of runs with equal powers the earliest counts, then the shortest period.  Repeated
    rows and rows with a null id are kept; very long texts are read whole, in memory of about 100 bytes a word; an empty
    table gives an empty result; other columns are not read.  With ``plant`` the texts are altered by ``planted`` first,
    for which ids are whole numbers; a null id plants nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 1, 1 << 22):
                rows = describe(part.column(0).to_pylist(), part.column(1).to_pylist(), plant)
                columns = [pa.array([r[k] for r in rows], pa.string() if k > 5 else pa.int64()) for k in range(8)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], NAMES)

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lean(work), SCHEMA.format(kind=kind))

