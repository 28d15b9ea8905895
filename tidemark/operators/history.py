"""The bounded history of snapshots of each coin, which a re-scale of the contract clears, and the rows of one cycle.

A snapshot is taken if it is later than every one taken before it, in the order of arrival.  Where its contract differs
from the last one known, a new generation begins: snapshots of different generations are never joined, as their prices
are per contracts of different sizes.  Running maxima and counts go over buckets of rows, so a coin may be as long as it
likes; what a cycle must remember (``remembered``) is bounded by age for each coin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import features as feat
from tidemark.operators import scans
from tidemark.shipping import ship
from tidemark.sources.views import SECOND


def admitted(snapshots: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``taken``, ``generation`` (from 0), ``changed_us`` (the latest re-scale) and ``known`` (the contract as last known).

    Needs coin, us and ``contract`` (null where the record lacks it).  Rows of an earlier history may come first in the
    order, with their ``base`` (generation) and ``base_changed_us`` in those columns, where there are such columns.
    """
    c, by = F.col, ["coin"]
    rows = scans.running(scans.numbered(snapshots, by, order), by, c("us"), "__latest")
    rows = rows.withColumn("taken", F.coalesce(c("us") > c("__latest"), F.lit(True))).drop("__latest")
    told = F.when(c("taken") & c("contract").isNotNull(), F.struct("i", "contract"))
    rows = scans.running(rows, by, told, "__told").withColumn("__was", c("__told.contract")).drop("__told")
    changed = F.coalesce(c("taken") & (c("contract") != c("__was")), F.lit(False))
    rows = rows.withColumn("__changed", changed).withColumn("known", F.when(c("taken"), F.coalesce("contract", "__was")).otherwise(c("__was")))
    rows = scans.running(rows, by, c("__changed").cast("long"), "__count", "sum")
    rows = scans.running(rows, by, F.when(c("__changed"), c("us")), "__change_us")
    generation = c("__count") + c("__changed").cast("long")
    change_us = F.when(c("__changed"), c("us")).otherwise(c("__change_us"))
    if "base" in snapshots.columns:
        base = snapshots.groupBy("coin").agg(F.max("base").alias("__base"), F.max("base_changed_us").alias("__base_us"))
        rows = rows.drop("base", "base_changed_us").join(base, "coin")
        generation, change_us = generation + F.coalesce("__base", F.lit(0)), F.coalesce(change_us, c("__base_us"))
    out = rows.withColumns({"generation": generation, "changed_us": change_us})
    return out.drop("i", "bucket", "__was", "__changed", "__count", "__change_us", "__base", "__base_us")


def held(taken: DataFrame, scale: int, rows: int = C.HISTORY_ROWS, age: int = C.HISTORY_AGE) -> DataFrame:
    """Adds the length of the history after each taken snapshot: those of its generation within ``age``, at most ``rows``.

    Times of a generation differ.  No more than ``rows`` before a row count, so buckets of rows with that many before
    them do, however crowded ``age`` is; a sliding frame in SQL would be counted anew for every row.
    """
    span, by = age * scale * SECOND, ["coin", "generation"]
    near = scans.with_halo(scans.numbered(taken, by, ["us"]), rows - 1).drop("i")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("us")
        us, own = table["us"].to_numpy(), pc.invert(table["in_halo"])
        length = np.minimum(rows, np.arange(1, len(us) + 1) - np.searchsorted(us, us - span))
        return table.drop_columns(["bucket", "in_halo"]).append_column("held", pa.array(length)).filter(own)

    ship(taken.sparkSession)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in taken.schema.fields)
    return near.groupBy(*by, "bucket").applyInArrow(run, kinds + "held long")


def remembered(taken: DataFrame, scale: int, age: int = C.HISTORY_AGE) -> DataFrame:
    """The history that the next cycle needs: what each coin's last generation has within ``age`` of its last snapshot.

    The longest window of a feature is shorter, so rows do not depend on how ticks were cut into cycles.
    """
    last = taken.groupBy("coin").agg(F.max("us").alias("__last"), F.max("generation").alias("__now"))
    near = taken.join(last, "coin").where((F.col("generation") == F.col("__now")) & (F.col("us") >= F.col("__last") - age * scale * SECOND))
    return near.drop("__last", "__now")


def cycle(spots: DataFrame, snapshots: DataFrame, scale: int) -> DataFrame:
    """The causal rows of ``spots`` with snapshots (admitted, taken) of their own generation only, with all quality flags.

    ``drops`` of a spot row, where there is such a column, are the cycles lost since the row before it.  The preview of a
    row that is not in the history yet is this function over the history and that row.
    """
    return feat.causal_features(spots, snapshots, scale)


def legacy(spots: DataFrame, snapshots: DataFrame, scale: int) -> DataFrame:
    """The simpler rows of the same cycle."""
    return feat.latest_rows(spots, snapshots, scale)
