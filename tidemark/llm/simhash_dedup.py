"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits (the last padded with zeros).  Two fingerprints
within two bits of each other agree on one whole segment, since two errors cannot touch three segments, and differ by at
most two bits in the next one.  The perfect binary Golay code [23, 12, 7] turns the latter into equality: decoding a
segment and its 23 one-bit neighbours gives at most a few codeword indices, and words at distance two or less share a
neighbour and thus an index.  So (segment number, exact segment, codeword index of the next segment) are the join keys,
about 18 for each distinct fingerprint, and no link is lost.

Keys are counted first.  A key held by few fingerprints is verified pair by pair within its row.  A key held by many (a
large group of near copies) is settled without pairs: each of its fingerprints emits the 65 words of its radius-one
ball, two fingerprints are within two bits exactly if they share such a word, and no word has more than 65 owners.
Each fingerprint is a node, whatever rows hold it; components come from alternating large-star and small-star steps over
the links, all in Spark, and are then named by the smallest id of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import near_copies
from tidemark.llm.common import lean, written
from tidemark.llm.graph import components
from tidemark.llm.wordhash import simhash
from tidemark.shipping import ship
from tidemark.storage import discard, mark

#: Fingerprints under a key up to which its pairs are verified within one row.
SMALL_KEY = 24
SHINGLE = 3
SEED = 42
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the XXH64 values of the shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) < SHINGLE:
        parts = [whole]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]).tolist()
        starts = [0, *ends]
        parts = [whole[a : b - 1] for a, b in zip(starts, ends[SHINGLE - 1 :])]
    return simhash(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit value.  Null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(work), f"doc_id {kind}, fp long")


def _syndromes() -> np.ndarray:
    """Remainders of all 12-bit highs and lows: [0] of x << 12, [1] of x."""

    def remainder(x: int) -> int:
        for bit in range(23, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    return np.array([[remainder(x << 12) for x in range(2048)] + [0] * 2048, [remainder(x) for x in range(4096)]])


class Golay:
    """Decoding of 23-bit words to the 12-bit index of the nearest codeword, vectorised."""

    def __init__(self) -> None:
        self.high, self.low = _syndromes()
        self.error = np.zeros(2048, np.int64)
        bits = [1 << i for i in range(23)]
        patterns = {a | b | c for a in bits for b in bits for c in bits} | {a | b for a in bits for b in bits} | {0}
        words = np.array(sorted(patterns))
        self.error[self.syndrome(words)] = words
        self.near = np.array([0, *bits])

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.high[x >> 12] ^ self.low[x & 4095]

    def index(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.error[self.syndrome(x)]) >> 11

    def indices(self, x: np.ndarray) -> np.ndarray:
        """For each word the sorted indices of it and its one-bit neighbours (repeats included): shape (n, 24)."""
        return np.sort(self.index(x[:, None] ^ self.near), axis=1)


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) pairs of unsigned fingerprints."""
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        near = code.indices(parts[(i + 1) % 3])
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append((i << 40) | (exact[r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            fps = b.column(0).to_numpy()
            rows, keys = golay_keys(fps.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows]), b.column(1).take(pa.array(rows))], ["key", "fp", "node"])

    return distinct.select("fp", "node").mapInArrow(work, "key long, fp long, node long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) node pairs whose connected components are those of all fingerprints at two or fewer differing bits.

    ``distinct`` has one row per fingerprint (fp) with its node number.  Pairs under small keys are verified.  Under
    large keys nodes are tied to the smallest node that shares a radius-one word, which links the same components.
    """
    keyed = written(_keyed(distinct))
    sizes = keyed.groupBy("key").count().where("count > 1")
    shared = written(keyed.join(sizes, "key"))
    member = F.struct("node", "fp")
    small = shared.where(F.col("count") <= SMALL_KEY).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("m"))
    near = F.filter(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size("m") - 1),
                lambda i: F.transform(
                    F.slice("m", i + 1, F.size("m")),
                    lambda y: F.struct(
                        F.element_at("m", i).node.alias("a"), y.node.alias("b"), F.bit_count(F.element_at("m", i).fp.bitwiseXOR(y.fp)).alias("d")
                    ),
                ),
            )
        ),
        lambda p: p.d <= 2,
    )
    pairs = small.select(F.explode(near).alias("p")).select("p.a", "p.b").distinct()
    crowd = shared.where(F.col("count") > SMALL_KEY).select("fp", "node").distinct()
    ball = crowd.select(
        "node",
        F.explode(F.array_append(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), F.col("fp"))).alias("word"),
    )
    # at most 65 fingerprints hold a word
    stars = ball.groupBy("word").agg(F.array_sort(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    stars = stars.select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, 65)).alias("b")).distinct()
    return pairs.unionByName(stars).distinct()


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and blank texts have fingerprint zero and link like any other.  Rows with a null id link others and get their
    component, but never name one, unless all ids of a component are null (then component_id is null).  Ids may be of any
    type with an order.  Repeated rows are kept; very long texts are read whole; an empty table gives an empty result;
    other columns are not read.
    """
    rows = written(fingerprints(df, id_col, text_col))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = written(components(links(nodes.select("fp", F.col("fp").alias("node")))))
    tied = nodes.join(labels, nodes["fp"] == labels["node"]).select("fp", "least", "label")
    named = tied.groupBy("label").agg(F.min("least").alias("component_id"))
    known = nodes.join(tied.join(named, "label").select("fp", "component_id"), "fp", "left")
    known = known.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def families(fps: DataFrame) -> DataFrame:
    """(fp, family) of the distinct fingerprints (fp) that link with others: family is the smallest one reachable."""
    since = mark(fps.sparkSession)
    nodes = written(fps.select("fp", F.col("fp").alias("node")))
    found = written(components(links(nodes)).select(F.col("node").alias("fp"), F.col("label").alias("family")))
    discard(fps.sparkSession, since, keep=1)
    return found


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group of near copies; rows with a null id stay.

    Near copies share ``similarity`` or more of their shingles.  Texts whose SimHash fingerprints (over ``shingle``
    words) link at two or fewer bits by the Golay-code keys are compared first; as that bound of shared shingles is
    far beyond two bits, min-hash bands add the candidates further apart.  See ``near_copies``, which compares.
    """
    return near_copies.drop_near_copies(df, id_col, text_col, shingle, similarity, families)
