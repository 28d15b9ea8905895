"""Near copies: SimHash and banded min-hashes find candidates, an exact count of shared shingles decides.

The SimHash of a text's set of shingles comes first: fingerprints that link at two bits or less (by the Golay-code keys
of ``simhash_dedup``) are a family, and texts of one family are candidates.  Two texts of similarity 0.8 differ by some
ten bits, where no key is selective.  So beside it each text gets BANDS fingerprints of ROWS min-hashes each.  Two texts
of similarity s agree on one of them with probability 1 - (1 - s^ROWS)^BANDS (0.9996 at s = 0.8), and every pair that
does is a candidate, too.

Candidates are settled without listing the pairs of a large group, and a text travels once for each block that it is in:

* SimHash families are taken first, then bands a few at a time, and of each only fingerprints whose members are not
  yet of one component.
* The members of a fingerprint that up to BLOCK texts share form one block, in which all pairs are compared.
* Of a more crowded one each component sends one member, dealt into blocks of about BLOCK, again and again until nothing
  more is found.  Copies, however many, end up in one component after a few rounds.
* Fingerprints that are crowded with several components even then (pages of one template, copies that have each been
  changed elsewhere) go to an exact join over what each text has and lacks against most of its family.  Texts near the
  common base are linked to one of them; others meet only where they share one of their rarest differences, so pairs of
  a template's pages, or of a text's independently changed copies, are not made.

The components are those of all candidate pairs, and of what pairs the exact join adds.  Shingles are compared by 64-bit
hashes; two of a pair of texts share one with odds of about n * m / 2**64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, pieces, sized, unused, written
from tidemark.llm.graph import components
from tidemark.llm.wordhash import simhash
from tidemark.shipping import ship

BANDS, ROWS = 20, 5
#: Band of the SimHash families.
SIMHASH = -1
#: Bands that are settled together: most copies agree on the first few.
STEPS = ((SIMHASH, 0), (0, 1), (1, 3), (3, 8), (8, BANDS))
#: Texts that are compared with each other in one task.
BLOCK = 64
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, size: int) -> set[bytes]:
    """The runs of ``size`` words of a text, ASCII letters in lower case; a shorter text is one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    whole = b" ".join(w)
    if len(w) < size:
        return {whole}
    starts = np.cumsum([0, *(len(x) + 1 for x in w)]).tolist()
    return {whole[a : b - 1] for a, b in zip(starts, starts[size:])}


def marks(text: str | None, size: int, factors: np.ndarray) -> tuple[bytes, list[int], int]:
    """(digest of the shingle set, its BANDS fingerprints, its SimHash), the latter as signed 64-bit values."""
    h = np.sort(np.array([xxhash.xxh64_intdigest(p, SEED) for p in shingles(text, size)], np.uint64))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        least = np.minimum(least, (h[i : i + 4096, None] * factors).min(axis=0))
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return xxhash.xxh3_128_digest(h.tobytes()), keys.view(np.int64).tolist(), int(np.uint64(simhash(h)).view(np.int64))


def marked(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, text, node, keys, fp) of every row; rows of equal shingle sets share a node."""
    factors = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [marks(t.as_py(), size, factors) for t in b.column(1)]
            node, keys = pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.list_(pa.int64()))
            fp = pa.array([x[2] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, keys, fp], ["doc_id", "text", "node", "keys", "fp"])

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(work), f"doc_id {kind}, text string, node binary, keys array<long>, fp long")


def _hashes(text: str | None, size: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(p, SEED) for p in shingles(text, size)], np.uint64)


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for each of ``nodes``."""
    return written(rows.select("node", "text").join(sized(written(nodes.distinct())), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    held = count[place] > 1
    owner, column = owner[held], common[place[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(common[-1]) + 1, 1 << 14):
        i, j = np.searchsorted(column, (low, low + (1 << 14)))
        table = np.zeros((len(sets), 1 << 14), np.float32)
        table[owner[i:j], column[i:j] - low] = 1
        shared += np.rint(table @ table.T).astype(np.int64)
    return shared


def _block_links(size: int, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """The links that join the components of a block's texts (node, label, text): as few as do."""

    def work(table: pa.Table) -> pa.Table:
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        sets = [_hashes(t, size) for t in table["text"].to_pylist()]
        n, root, links = np.array([len(x) for x in sets]), {x: x for x in labels}, []

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        if len(root) > 1:
            shared = _overlaps(sets)
            alike = shared >= similarity * (n[:, None] + n[None, :] - shared) - 1e-9
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1)))):
                a, b = find(labels[i]), find(labels[j])
                if a != b:
                    root[a] = b
                    links.append((nodes[i], nodes[j]))
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return work


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (key, node, held, label) of the fingerprints that more than one component holds."""
    with_label = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = with_label.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return written(with_label.join(spread, "key").select("key", "node", "held", "label"))


def groups(rows: DataFrame, families: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, label) of the nodes that are near copies of others: label is the smallest node of the component.

    ``families`` are (fp, family) of the SimHash fingerprints that link with others.
    """
    alike = rows.select("node", "fp").join(families, "fp", "left").select("node", F.lit(SIMHASH).alias("band"), F.coalesce("family", "fp").alias("key"))
    keyed = rows.select("node", F.posexplode("keys").alias("band", "key")).unionByName(alike).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    members = written(keyed.join(shared, "key"))
    texts = _texts(rows, members.select("node"))
    links, labels = rows.sparkSession.createDataFrame([], "a binary, b binary"), None
    for low, high in STEPS:
        some = members.where(F.col("band").between(low, high - 1))
        while True:
            open_ = _labelled(some, labels)
            crowd = open_.where(F.col("held") > BLOCK).groupBy("key", "label").agg(F.min("node").alias("node"))
            of = crowd.groupBy("key").agg(F.count("*").alias("count"))
            dealt = crowd.join(of, "key").select("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / BLOCK)).alias("block"), "node", "label")
            whole = open_.where(F.col("held") <= BLOCK).select("key", F.lit(0).cast("long").alias("block"), "node", "label")
            work = written(whole.unionByName(dealt))
            found = written(sized(work).join(texts, "node").groupBy("key", "block").applyInArrow(_block_links(size, similarity), "a binary, b binary"))
            if found.isEmpty():
                break
            links = written(links.unionByName(found))
            labels = written(components(links))
            if open_.where(F.col("held") > BLOCK).isEmpty():
                break
            some = some.where(F.col("held") > BLOCK)
    open_ = _labelled(members.where(F.col("held") > BLOCK), labels)
    if open_.isEmpty():
        return labels if labels is not None else rows.sparkSession.createDataFrame([], "node binary, label binary")
    found = written(crowded_links(open_.select("key", "node", "label"), texts, size, similarity))
    if not found.isEmpty():
        labels = written(components(links.unionByName(found)))
    return labels if labels is not None else rows.sparkSession.createDataFrame([], "node binary, label binary")


def _differences(nodes: DataFrame, texts: DataFrame, size: int, share: float) -> DataFrame:
    """(family, node, label, n, d, s) of nodes (family, node, label).

    ``d`` are the shingles in which a node differs from what most of its family has: those only it has, and those it
    lacks.  Two nodes differ by d of the one without d of the other, and are alike if that is at most ``share`` of all
    their shingles; so by s = |d| - share * n they must have at least (s + s') / 2 differences in common.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 3, 1 << 20):
                sets = [_hashes(t, size).view(np.int64) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.list_(pa.int64()))], ["family", "node", "label", "h"])

    with_text = nodes.join(texts, "node").select("family", "node", "label", "text")
    sets = written(with_text.mapInArrow(lean(work), "family binary, node binary, label binary, h array<long>"))
    sizes = sets.groupBy("family").agg(F.count("*").alias("members"))
    seen = sets.select("family", F.explode("h").alias("h")).groupBy("family", "h").agg(F.count("*").alias("f"))
    # no more than twice as many as a text of the family has on average
    base = seen.join(sizes, "family").where(2 * F.col("f") > F.col("members")).groupBy("family").agg(F.collect_list("h").alias("base"))
    both = sets.join(base, "family", "left").withColumn("base", F.coalesce("base", F.expr("array()").cast("array<long>")))
    d = F.concat(F.array_except("h", "base"), F.array_except("base", "h"))
    return both.select("family", "node", "label", F.size("h").alias("n"), d.alias("d")).withColumn("s", F.size("d") - share * F.col("n"))


def _meetings(rows: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs of nodes of different labels that are alike although both differ much from their family.

    Prefix filter over differences in the order of their frequency: a pair must share one of the first of either side,
    and what is left from there on must do for what they need in common.  Of the family's largest label no two members
    meet, as one side of a pair is always of another.
    """
    tokens = rows.select("family", F.explode("d").alias("h")).groupBy("family", "h").agg(F.count("*").alias("f")).where("f > 1")
    least = rows.groupBy("family").agg(F.min("s").alias("low"))
    exploded = rows.select("family", "node", F.size("d").alias("m"), "s", F.explode("d").alias("h"))
    shared = exploded.join(tokens, ["family", "h"]).groupBy("family", "node").agg(F.first("m").alias("m"), F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("f", "h"))).alias("g"))
    own = F.col("m") - F.size("g")  # differences that no other node has come first
    need = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-9))
    reach = F.greatest(F.lit(0), (F.col("m") - need((F.col("s") + F.col("low")) / 2) + 1 - own).cast("int"))
    placed = shared.join(least, "family").select("family", "node", "s", "m", own.alias("own"), F.posexplode(F.slice("g", F.lit(1), reach)).alias("i", "t"))
    placed = placed.withColumn("place", F.col("own") + F.col("i")).withColumn("short", F.col("place") < F.col("m") - need(F.col("s")) + 1)
    placed = written(placed.select("family", F.col("t.h").alias("h"), "node", "s", "m", "place", "short"))
    counts = rows.groupBy("family", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    about = written(rows.select("family", "node", "label", "n", "d").join(main, "family").withColumn("other", F.col("label") != F.col("main")).drop("main"))
    named = written(placed.join(about.select("node", "label", "n", "other"), "node"))
    side = lambda t, c: t.select("family", "h", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "label", "n", "s", "m", "place", "short", "other")))
    c = F.col
    lesser = (c("s_a") < c("s_b")) | ((c("s_a") == c("s_b")) & (c("node_a") < c("node_b")))
    once = ~c("other_b") | (c("node_a") < c("node_b"))
    fits = (c("n_a") >= (1 - share) / (1 + share) * c("n_b") - 1e-9) & (c("n_b") >= (1 - share) / (1 + share) * c("n_a") - 1e-9)
    enough = F.least(c("m_a") - c("place_a"), c("m_b") - c("place_b")) >= need((c("s_a") + c("s_b")) / 2)
    left, right = side(named.where("other"), "a"), side(named, "b").withColumnRenamed("family", "family_b").withColumnRenamed("h", "h_b")
    on = (c("family") == c("family_b")) & (c("h") == c("h_b")) & (c("label_a") != c("label_b")) & once & F.when(lesser, c("short_a")).otherwise(c("short_b")) & fits & enough
    pairs = written(left.join(right, on).select(c("node_a").alias("a"), c("node_b").alias("b"), ((c("s_a") + c("s_b")) / 2).alias("need")).distinct())
    d = lambda x: about.select(c("node").alias(x), c("d").alias(f"d_{x}"))
    return pairs.join(d("a"), "a").join(d("b"), "b").where(F.size(F.array_intersect("d_a", "d_b")) >= F.col("need") - 1e-9).select("a", "b")


def crowded_links(members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all alike members of a fingerprint; ``members`` are (key, node, label) of crowded ones.

    Fingerprints that share members are one family.  A text near what most of its family has is linked to the text
    nearest to that, which any text it could be linked to through their common base is alike to as well; texts further
    away must have differences in common and meet there.
    """
    share = (1 - similarity) / (1 + similarity)
    first = members.groupBy("key").agg(F.min("node").alias("a"))
    families = components(members.join(first, "key").select("a", F.col("node").alias("b")))
    nodes = members.select("node", "label").distinct().join(families.select("node", F.col("label").alias("family")), "node")
    rows = written(_differences(written(nodes), texts, size, share))
    center = rows.groupBy("family").agg(F.min(F.struct("s", "node", "label")).alias("c"))
    near = rows.join(center, "family").where((F.col("s") + F.col("c.s") <= 1e-9) & (F.col("label") != F.col("c.label")))
    return near.select(F.col("node").alias("a"), F.col("c.node").alias("b")).unionByName(_meetings(rows, share))


def drop_near_copies(df: DataFrame, id_col: str, text_col: str, size: int, similarity: float, families: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component; rows with a null id stay.

    ``families`` gives (fp, family) of the distinct SimHash fingerprints (fp) that link with others.
    Null and blank texts are alike.  Rows with a null id link others but name no component.  Repeated rows of an id stay
    or go together.  Very long texts are read whole.  An empty table gives an empty result; clashing columns do no harm.
    """
    own = unused(df, "__id")
    rows = written(marked(df, id_col, text_col, size))
    named = rows.join(groups(rows, families(rows.select("fp").distinct()), size, similarity), "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    kept = named.groupBy("label").agg(F.min("doc_id").alias(own)).where(F.col(own).isNotNull()).select(own).distinct()
    lone = df.where(F.col(id_col).isNull())
    return df.join(kept, df[id_col] == kept[own], "left_semi").unionByName(lone)
