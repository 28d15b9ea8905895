"""Substring dedup by Rabin-Karp window hashes.

Every window of ``SIZE`` consecutive words has a Rabin-Karp hash (differences of one running sum over word hashes).
A window is removed if the same word sequence starts in a document with a smaller id.  Windows are counted in Spark;
repeated ones merge into maximal removal intervals.

Moving a hash for every word of the corpus would cost more than the corpus.  Three exact reductions come first:

* documents with equal word sequences are grouped by a digest; only the smallest id goes on, since in the others every
  window starts in it;
* each window has an anchor, the least hash of its ``GRAM``-word pieces.  Equal windows have equal anchors, neighbours
  mostly share theirs, so anchors are about 5 % of the windows; those found in one document only cannot repeat;
* only windows with a shared anchor are hashed again (64 + 31 bits), counted and joined.

Equal hashes are taken for equal word sequences.  Both window hashes come from 64-bit hashes of words, so two different
words are confused with probability 2**-64 a pair, and two windows of different word hashes with about 2**-95.

Counts and minima combine on the map side and the joins are plain shuffles that Spark may split where a passage is hot.
Nothing is collected, and a group never holds more than the positions of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.wordhash import spans, windows, word_hashes
from tidemark.shipping import ship

SIZE = 50
GRAM = 10
SECOND_BASE = 0xA0761D6478BD642F
#: Bytes of text that are hashed at once.
PIECE = 2 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows with about ``PIECE`` bytes."""
    texts, first, held = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append((t.as_py() or "").encode())
        held += len(texts[-1])
        if held >= PIECE:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class Texts:
    """The words of several texts as one array, with the text each belongs to."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        self.size = size
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.starts, self.ends = spans(data)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(bounds, self.starts, "right")
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))
        self.hashes = word_hashes(data, self.starts, self.ends)

    def whole(self) -> np.ndarray:
        """Numbers of the words at which a window of one text starts."""
        n = len(self.hashes) - self.size + 1
        return np.flatnonzero(self.owner[:n] == self.owner[self.size - 1 :]) if n > 0 else np.empty(0, np.int64)

    def anchors(self, gram: int) -> np.ndarray:
        """For each word the anchor of the window that starts there."""
        n = len(self.hashes) - self.size + 1
        return _sliding_min(windows(self.hashes, gram), self.size - gram + 1)[:n] if n > 0 else np.empty(0, np.uint64)


def _profile(df: DataFrame, size: int, gram: int) -> DataFrame:
    """doc_id, text_key, n_words, digest of the word sequence, anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch, "text"):
                t = Texts(texts, size)
                at, anchors = t.whole(), t.anchors(gram)
                own, anchors = t.owner[at], anchors[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])
                ends = np.concatenate(([0], np.cumsum(np.bincount(own[new], minlength=len(texts)))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        batch.column("text_key").slice(first, len(texts)),
                        pa.array(t.counts.astype(np.int64)),
                        pa.array([hashlib.sha256(b" ".join(x.split())).hexdigest() for x in texts]),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(anchors[new].view(np.int64))),
                    ],
                    ["doc_id", "text_key", "n_words", "digest", "anchors"],
                )

    return df.mapInArrow(work, "doc_id long, text_key long, n_words long, digest string, anchors array<long>")


def _windows(candidates: DataFrame, size: int, gram: int) -> DataFrame:
    """A row for each window of the candidates whose anchor is shared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("anchors")
            for first, texts in _pieces(batch, "text"):
                t = Texts(texts, size)
                lists = shared.slice(first, len(texts))
                wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                # an anchor that is shared is shared wherever it occurs
                at = t.whole()
                at = at[np.isin(t.anchors(gram)[at], wanted)]
                own, one, two = t.owner[at], windows(t.hashes, size), windows(t.hashes, size, SECOND_BASE)
                for i in range(0, max(1, len(at)), 1 << 17):
                    a, o = at[i : i + (1 << 17)], own[i : i + (1 << 17)]
                    rows = pa.array(first + o)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(rows),
                            batch.column("text_key").take(rows),
                            pa.array((a - t.firsts[o]).astype(np.int32)),
                            pa.array(one[a].view(np.int64)),
                            pa.array((two[a] >> np.uint64(33)).astype(np.int32)),
                        ],
                        ["doc_id", "text_key", "at", "h1", "h2"],
                    )

    return candidates.mapInArrow(work, "doc_id long, text_key long, at int, h1 long, h2 int")


def _cut(hits: DataFrame, size: int) -> DataFrame:
    """Removal intervals and digest of what is kept, for documents with repeated windows at ``at``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept_texts, intervals = [], [], [], []
            for text, at in zip(batch.column("text"), batch.column("at")):
                words = (text.as_py() or "").encode().split()
                at = np.unique(at.values.to_numpy())
                delta = np.zeros(len(words) + 1, np.int32)
                delta[at] += 1
                delta[at + size] -= 1
                gone = np.cumsum(delta)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                intervals.append([{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(intervals, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept_texts, pa.string()),
                ],
                ["doc_id", "text_key", "n_removed", "kept_sha256", "removed", "kept"],
            )

    kinds = "doc_id long, text_key long, n_removed long, kept_sha256 string, removed array<struct<begin: int, end: int>>, kept string"
    return hits.mapInArrow(work, kinds)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, removed (word intervals, end exclusive).

    With ``texts`` also ``kept``: the kept words joined by one space, null where nothing was removed.  Null text has no
    words.  A document with fewer than ``size`` words has no window and is kept.  A null id is neither smaller nor
    larger than another: such a document is kept whole and removes nothing.  Rows that repeat an id do not remove from
    each other.  Ids must be whole numbers.  Very long texts are read whole.  An empty table gives an empty result; other
    columns are not read.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    base = written(_profile(docs, size, gram))
    first = base.where(F.col("n_words") >= size).groupBy("digest").agg(F.min("doc_id").alias("least"))
    # ids are spread within a group of copies, so the join key has no hot value
    marked = base.join(
        first.select(F.col("digest").alias("__digest"), "least"), (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("least")), "left"
    )
    marked = written(marked.select("doc_id", "text_key", "n_words", "digest", F.col("least").isNotNull().alias("first"), F.when(F.col("least").isNotNull(), F.col("anchors")).alias("anchors")))
    anchored = marked.where("first").select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    shared = anchored.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("anchor")
    # written, so that the join has a shuffle of its own on both sides and a hot key can be split
    shared = written(shared)
    flagged = anchored.join(shared, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))
    candidates = written(docs.join(flagged, ["doc_id", "text_key"]))
    # written, as it is read twice
    found = written(_windows(candidates, size, gram))
    owners = written(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").drop("top"))
    repeats = found.join(owners, ["h1", "h2"]).where("doc_id > low").groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("at"))
    unique = candidates.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "text")
    cut = _cut(unique.join(repeats, ["doc_id", "text_key"]), size)
    cut = cut if texts else cut.drop("kept")
    out = marked.drop("anchors").join(cut, ["doc_id", "text_key"], "left")
    copy = ~F.col("first") & (F.col("n_words") >= size) & F.col("doc_id").isNotNull()
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<begin: int, end: int>>")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
