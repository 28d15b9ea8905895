"""The stateful parts as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.storage import shared_folder, written
from tidemark.streaming import cycles


def accepted(stream: DataFrame, base: str, keep: int = 600) -> None:
    """Runs a stream of ticks (coin, event_id, us) to its end: which each coin's bounded history takes, and its length then.

    A tick is taken if it is later than every one before it; arrival order is the event id.  Each micro-batch is scanned
    over buckets of rows, so a coin is no single task; what is carried on is a row a coin.  A batch that runs again
    writes the same files over.  Rows are read by ``cycles.read`` as "rows".
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, c = batch.sparkSession, F.col
        rows = written(batch.select("coin", "event_id", "us"))
        before = cycles.left_by(spark, base, number, "coins")
        old = before if before is not None else spark.createDataFrame([], "coin string, last long, was long")
        placed = scans.running(scans.numbered(rows, ["coin"], ["event_id"]), ["coin"], c("us"), "latest").join(old, "coin", "left")
        taken = F.coalesce(c("us") > F.greatest("latest", "last"), F.lit(True))
        counted = scans.running(placed.withColumn("taken", taken), ["coin"], c("taken").cast("long"), "n", "sum")
        held = F.least(F.lit(keep).cast("long"), F.coalesce("was", F.lit(0)) + c("n") + c("taken").cast("long"))
        out = written(counted.select("coin", "event_id", "us", "taken", held.alias("held")))
        out.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        now = out.groupBy("coin").agg(F.max("us").alias("last"), F.max_by("held", "event_id").alias("was"))
        now.unionByName(old).groupBy("coin").agg(F.max("last").alias("last"), F.max("was").alias("was")).write.mode("overwrite").parquet(f"{base}/state/batch={number}/coins")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now into a table of the shared folder, and reads that table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def closed_candles(ticks: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Candles of a stream with event time ``ts``; one is given out when the watermark has passed its end."""
    w = F.window("ts", f"{minutes} minutes")
    return ticks.withWatermark("ts", late).groupBy("coin", w).agg(F.min("px").alias("low"), F.max("px").alias("high"), F.count("*").alias("n")).select("coin", F.col("window.start").alias("start"), "low", "high", "n")
