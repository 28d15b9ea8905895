"""Exact dedup with a heavy-hitter split.

A Misra-Gries sketch (``stat.freqItems``) names every digest that may hold more than ``support`` of the rows: at most
``1 / support`` of them, a bound that no input changes.  Their true counts are taken with map-side combining, and the
verified winners are broadcast, so the copies of a hot text are settled where they are read and never meet in one task.
The remaining digests go through an ordinary shuffle: those held more than once are counted with map-side combining and
joined back, a join that Spark may split where a digest has many rows.  No group is ever held in one task.

Only (id, digest) pairs move.  They are written once to the shared folder, so the texts are read a single time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sized, unused, written

SUPPORT = 0.001


def membership(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Of equal texts the row with the largest id stays; among repeated rows of that id one
    stays.  A null id is smaller than any other.  Very long texts are digested whole.  An empty table gives an empty result;
    other columns are not read.
    """
    digests = written(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    best = F.max(F.struct("doc_id", "row"))
    candidates = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = written(
        digests.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), best.alias("best"))
        .where(F.col("group_size") > 1)
    )
    hot = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best")).where(F.col("group_size") > 1)
    rest = rest.join(groups, "text_sha256", "left").select(
        "doc_id",
        "row",
        "text_sha256",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("best", F.struct("doc_id", "row")).alias("best"),
    )
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``df`` that stay, with their own columns.  Of repeated rows (same id and text) one stays.

    What goes is joined by id and digest; where that is a small table it is broadcast, and no text moves.  Null text
    counts as empty, null ids are equal; an empty table gives an empty result; clashing columns do no harm.
    """
    key, own, stays = unused(df, "__digest"), unused(df, "__id"), unused(df, "__stays")
    members = written(membership(df, id_col, text_col, support))
    several = members.where("group_size > 1").groupBy(F.col("doc_id").alias(own), F.col("text_sha256").alias(key)).agg(F.max("kept").alias(stays), F.count("*").alias("n"))
    touched = written(several.where(f"NOT {stays} OR n > 1").select(own, key, stays))
    marked = df.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    match = lambda t: marked[id_col].eqNullSafe(t[own]) & (marked[key] == t[key])
    gone = sized(touched.select(own, key))
    rows = marked.join(gone, match(gone), "left_anti")
    repeated = written(touched.where(stays).select(own, key))
    if not repeated.isEmpty():
        once = sized(repeated)
        rows = rows.unionByName(marked.join(once, match(once), "left_semi").dropDuplicates([id_col, key]))
    return rows.drop(key)
