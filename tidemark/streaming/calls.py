"""Pending calls as a join of two streams: a call waits for its market's result and is given up when none has come in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.trading import outcome_of


def pending(calls: DataFrame, results: DataFrame, late: str = "1 minute") -> DataFrame:
    """One row for each call, once it is settled or given up: ticker, called, close, up, settled, status.

    ``calls`` (ticker, called, close) and ``results`` (ticker, seen, result) are streams with event times ``called`` and
    ``seen``, calls at most ``late`` out of order.  Only final results take part, the first for each market (they are kept
    for SETTLE_REACH seconds, so that a repeated one is known as such); one that is known before the close counts from SETTLE_WAIT seconds after it.  A call whose result has not come SETTLE_GIVE_UP seconds
    after the close is given out without one, when the watermarks have passed that time; Spark then forgets it.
    """
    final = results.withColumn("up", outcome_of(F.col("result"))).where("up IS NOT NULL").withWatermark("seen", f"{C.SETTLE_REACH} seconds")
    first = final.dropDuplicatesWithinWatermark(["ticker"]).select(F.col("ticker").alias("of"), "seen", "up")
    waiting = calls.withWatermark("called", late)
    span = lambda s: F.expr(f"INTERVAL '{s}' SECOND")
    in_time = (F.col("seen") >= F.col("called")) & (F.col("seen") <= F.col("called") + span(C.SETTLE_REACH)) & (F.col("seen") <= F.col("close") + span(C.SETTLE_GIVE_UP))
    both = waiting.join(first, (F.col("ticker") == F.col("of")) & in_time, "left_outer")
    settled = F.when(F.col("of").isNotNull(), F.greatest("seen", F.col("close") + span(C.SETTLE_WAIT)))
    return both.select("ticker", "called", "close", "up", settled.alias("settled"), F.when(F.col("of").isNotNull(), "SETTLED").otherwise("GAVE_UP").alias("status"))
