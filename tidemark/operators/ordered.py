"""Running sums and row windows over long ordered groups, without a task that holds a whole group.

There may be a handful of groups with very many rows each.  Rows are dealt out by ranges of (group, order); a range adds
up on its own, and sums of whole ranges, one row for each, tell what lies before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

#: Rows of a bucket of ``row_buckets``.
BUCKET = 20_000


def with_before(df: DataFrame, by: list[str], order: list[str], n: str | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of ``n`` (rows, if not given) over all rows of the group that come before in the order.

    The order must tell the rows of a group apart.
    """
    one = F.col(n) if n else F.lit(1)
    # written, so that ranges are the same whoever reads them
    placed = written(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "__range").agg(F.sum(one).alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("__within", F.coalesce(F.sum(one).over(within), F.lit(0)))
    return rows.join(offsets, [*by, "__range"]).withColumn(name, F.col("__ahead") + F.col("__within")).drop("__range", "__ahead", "__within")


def row_buckets(df: DataFrame, by: list[str], order: list[str], lookback: int) -> DataFrame:
    """Rows with their number from 1 in the group (i), by buckets that also hold the ``lookback`` rows before them (in_halo).

    Windows of up to so many rows back go by (group, bucket); drop what is in_halo after them.
    """
    numbered = with_before(df, by, order, name="i").withColumn("i", F.col("i") + 1)
    first, last = F.floor(F.col("i") / BUCKET), F.floor((F.col("i") + lookback) / BUCKET)
    return numbered.withColumn("bucket", F.explode(F.sequence(first, last))).withColumn("in_halo", F.col("bucket") != F.floor(F.col("i") / BUCKET))
