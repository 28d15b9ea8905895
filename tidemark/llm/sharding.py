"""Sharding by extendible hashing.

A document's place is 60 bits of the MD5 of its id.  The directory is indexed by hash prefixes: it starts with one
bucket of no bits, and only a bucket over the byte limit splits on one more bit, until every shard fits.  Bytes are
summed once at a depth that the total suggests, rolled up to every shorter prefix, and each fine bucket takes its
shortest prefix that fits; buckets that are too large even at that depth go on with more bits.  The directory is a
table of about as many rows as there are shards and stays in Spark.

A document over the limit gets a shard of its own.  Rows that no bit tells apart (repeats of one id) and that are too
large together are paged within the partitions they were read in, so a hot id never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import unused, written

BITS = 60
LIMIT = 16 * 1024 * 1024


def _prefix(depth: int) -> Column:
    return F.shiftright("place", BITS - depth)


def _fit(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Per prefix of ``high`` bits: the least depth from ``low`` on whose bucket fits (null: none), its bytes and rows."""
    fine = rows.groupBy(_prefix(high).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
    above = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    above = above.withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
    sums = above.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_docs"))
    sums = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = above.select("fine", "depth", "prefix").join(sums, ["depth", "prefix"], "left")
    fit = F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "prefix", "shard_bytes", "shard_docs"))
    return found.groupBy("fine").agg(F.min(fit).alias("best"))


def assign(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs; and the columns to ``carry``.

    Null text has no bytes; null ids hash like an empty id.  Rows that repeat an id share a shard while they fit it.  A
    very long text goes by its number of bytes, and alone where that is over the limit.  An empty table gives an empty
    result; other columns are not read.
    """
    base = ["doc_id", "n_bytes", *carry]
    rows = written(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("place"),
            *carry,
        )
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    parts, left = [], rows
    while True:
        fits = written(_fit(left, low, high, limit))
        placed = left.withColumn("fine", _prefix(high)).join(fits, "fine")
        parts.append(placed.where(F.col("best").isNotNull()).select(*base, "best.*"))
        if fits.where(F.col("best").isNull()).isEmpty():
            break
        left = written(placed.where(F.col("best").isNull()).select(*base, "place"))
        if high == BITS:
            parts.append(_pages(left, limit, base))
            break
        low, high = high + 1, min(BITS, high + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    page = F.concat(F.lit("/"), F.col("page")) if "page" in out.columns else F.lit(None).cast("string")
    return out.select("doc_id", "n_bytes", *carry, F.concat(bits, F.coalesce(page, F.lit(""))).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def _pages(rows: DataFrame, limit: int, base: list[str]) -> DataFrame:
    """Rows of overfull buckets at full depth, paged by the partition they lie in."""
    rows = written(rows.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()))
    bucket = Window.partitionBy("place", "part")
    per_page = F.greatest(F.lit(1), F.floor(limit / F.greatest(F.lit(1), F.max("n_bytes").over(bucket))))
    paged = rows.withColumn("page", F.floor((F.row_number().over(bucket.orderBy("n")) - 1) / per_page))
    whole = Window.partitionBy("place", "part", "page")
    return paged.select(
        *base, F.lit(BITS).alias("depth"), F.col("place").alias("prefix"), F.concat_ws(".", "part", "page").alias("page"),
        F.sum("n_bytes").over(whole).alias("shard_bytes"), F.count("*").over(whole).alias("shard_docs"),
    )


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the rows of ``df`` as one folder a shard, and returns the name of the folders' column: shard, or longer if ``df`` has one.

    Each row goes to the shard that it was given itself, so rows that repeat an id are spread where they do not fit one.
    """
    own, name = unused(df, "__row"), unused(df, "shard")
    # written, so that a row has the same number for both readers
    rows = written(df.withColumn(own, F.monotonically_increasing_id()))
    shards = assign(rows, limit, id_col, text_col, (own,)).select(own, F.col("shard").alias(name))
    rows.join(shards, own).drop(own).repartition(name).write.partitionBy(name).parquet(path)
    return name
