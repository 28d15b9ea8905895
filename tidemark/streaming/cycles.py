"""Cycles as a stream: each micro-batch of ticks gives its causal rows, its legacy rows and its counters, once.

``foreachBatch`` runs the operators of a batch over the history that the batch before left and the new ticks, and writes
everything under the number of the batch: rows, counters and the history for the next one.  A batch that runs again after
a failure reads the same history and writes the same files over.  The preview of a tick is worked out by the same
functions and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import history as H
from tidemark.sources.views import SECOND
from tidemark.storage import written

KINDS = ("causal", "legacy", "counters")


def left_by(spark: SparkSession, base: str, batch: int, kind: str) -> DataFrame | None:
    """What the batch before ``batch`` left; none before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/state/batch={batch - 1}/{kind}")
    if batch == 0 or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(path.toString())


def together(spark: SparkSession, base: str, batch: int, spots: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spots, snapshots admitted and taken or not) of the history and of the batch; ``fresh_tick`` marks the latter."""
    old_spots, old_snapshots = left_by(spark, base, batch, "spots"), left_by(spark, base, batch, "snapshots")
    spots = spots.withColumn("fresh_tick", F.lit(True))
    new = snapshots.withColumns({"fresh_tick": F.lit(True), "base": F.lit(None).cast("long"), "base_changed_us": F.lit(None).cast("long")})
    if old_spots is not None:
        spots = old_spots.withColumn("fresh_tick", F.lit(False)).unionByName(spots)
    if old_snapshots is not None:
        before = old_snapshots.withColumns({"fresh_tick": F.lit(False), "contract": F.col("known"), "base": F.col("generation"), "base_changed_us": F.col("changed_us")})
        new = before.select(new.columns).unionByName(new)
    return spots, H.admitted(written(new), ["fresh_tick", "event_id"])


def preview(spark: SparkSession, base: str, batch: int, spots: DataFrame, scale: int) -> DataFrame:
    """The causal rows that ``spots`` would get in cycle ``batch`` if no snapshot came with them."""
    stored = left_by(spark, base, batch, "snapshots")
    old = left_by(spark, base, batch, "spots")
    rows = old.withColumn("fresh_tick", F.lit(False)).unionByName(spots.withColumn("fresh_tick", F.lit(True)))
    return H.cycle(rows.drop("fresh_tick"), stored, scale).join(spots.select("event_id"), "event_id", "left_semi")


def run_cycle(spark: SparkSession, base: str, batch: int, spots: DataFrame, snapshots: DataFrame, scale: int) -> None:
    """One cycle; whatever it writes stands under its number."""
    spots, known = together(spark, base, batch, spots, snapshots)
    spots, known = written(spots), written(known)
    taken = known.where("taken")
    fresh = spots.where("fresh_tick").select("event_id")
    rows = spots.drop("fresh_tick")
    to = f"{base}/{{}}/batch={batch}".format
    H.cycle(rows, taken, scale).join(fresh, "event_id", "left_semi").write.mode("overwrite").parquet(to("causal"))
    H.legacy(rows, taken, scale).drop("match").join(fresh, "event_id", "left_semi").write.mode("overwrite").parquet(to("legacy"))
    tick = known.where("fresh_tick").groupBy("coin").agg(F.count("*").alias("submitted"), F.count_if("taken").alias("taken"), F.max("generation").alias("generation"))
    row = spots.where("fresh_tick").groupBy("coin").agg(F.count("*").alias("rows"))
    tick.join(row, "coin", "full").fillna(0, ["submitted", "taken", "rows"]).write.mode("overwrite").parquet(to("counters"))
    last = spots.groupBy("coin").agg(F.max("us").alias("last"))
    spots.drop("fresh_tick").join(last, "coin").where(F.col("us") >= F.col("last") - C.HISTORY_AGE * scale * SECOND).drop("last").write.mode("overwrite").parquet(f"{to('state')}/spots")
    H.remembered(taken, scale).drop("fresh_tick", "taken").write.mode("overwrite").parquet(f"{to('state')}/snapshots")


def run(stream: DataFrame, base: str, scale: int, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """Runs a stream of ticks to its end, cycle by cycle; ``split`` makes (spots, snapshots) of a micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        ticks = written(batch)
        run_cycle(batch.sparkSession, base, number, *split(ticks), scale)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def read(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """All rows of one of KINDS, with the number of their cycle."""
    return spark.read.parquet(f"{base}/{kind}").withColumn("batch", F.col("batch").cast("long"))
