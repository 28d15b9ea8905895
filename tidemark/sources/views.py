"""The driver's tables seen as market data.

``ticks`` come from events, ``markets`` from orders, ``observations`` from lineitem.  Times are microseconds since the
epoch, computed from the calendar fields, so that the session's time zone does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.market import logit, mid, premium_bps, sigmoid, spread_bps

SECOND = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    day = F.unix_date(ts.cast("date")).cast("long") * 86400
    return (day + F.hour(ts) * 3600 + F.minute(ts) * 60) * SECOND + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")


def coin_of(key: Column) -> Column:
    n = key % len(C.COINS)
    out = F.when(n == 0, C.COINS[0])
    for i, name in enumerate(C.COINS[1:], 1):
        out = out.when(n == i, name)
    return out


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 0")
    us = micros(F.col("ts"))
    return e.select(
        "event_id",
        coin_of(F.col("user_id")).alias("coin"),
        us.alias("us"),
        F.col("value").alias("px"),
        F.when(F.col("event_type").isin("view", "click"), "spot").otherwise("perp").alias("kind"),
        F.floor(us / (7 * 86400 * SECOND)).cast("long").alias("session"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def snapshots(ticks: DataFrame, scale: int) -> DataFrame:
    """Perp side: one row per snapshot, with every status kept."""
    i, px = F.col("event_id"), F.col("px")
    low, high = px * (1 - F.col("k") * 1e-5), px * (1 + F.col("k") * 1e-5)
    crossed = i % 53 == 0
    out = ticks.where("kind = 'perp'").select(
        "event_id",
        "coin",
        "us",
        "session",
        F.when(crossed, high).otherwise(low).alias("bid"),
        F.when(crossed, low).otherwise(high).alias("ask"),
        F.when(i % 47 != 0, px * (1 + (i % 21 - 10) * 1e-4)).alias("index_price"),
        (px * (1 + (i % 13 - 6) * 1e-4)).alias("mark"),
        (px * (1 + (i % 11 - 5) * 1e-4)).alias("last_price"),
        F.when(i % 41 == 0, "error").otherwise("fresh").alias("source_status"),
        (i % 19).alias("index_age_s"),
        F.when(i % 29 != 0, (i % 100 - 50) * 1e-6).alias("funding_rate"),
    )
    out = out.withColumn("mid", mid(F.col("bid"), F.col("ask")))
    return out.select(
        "*",
        spread_bps(F.col("bid"), F.col("ask")).alias("spread"),
        premium_bps(F.col("mid"), F.col("index_price")).alias("premium"),
        ((F.col("source_status") == "fresh") & (F.col("index_age_s") <= C.STALE)).alias("fresh"),
    )


def spots(ticks: DataFrame) -> DataFrame:
    """Spot side: one telemetry row per observation."""
    i = F.col("event_id")
    return ticks.where("kind = 'spot'").select("event_id", "coin", "us", "session", F.col("px").alias("spot"), (i % 31 != 0).alias("binary_ok"), (i % 200).alias("latency_ms"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = sigmoid((F.col("o_totalprice") - 250000) / 1e5)
    return o.select(
        F.col("o_orderkey").alias("ticker"),
        coin_of(F.col("o_custkey")).alias("coin"),
        (micros(F.col("o_orderdate")) + (F.col("o_orderkey") % 96) * C.MARKET_SECONDS * SECOND).alias("close_us"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("up"),
        F.round(p, 6).alias("p"),
        F.when(p >= 0.5, "UP").otherwise("DOWN").alias("fav"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry row per order line, with its market."""
    l = table(spark, sf_dir, "lineitem")
    m = markets(spark, sf_dir)
    rows = l.select(
        F.col("l_orderkey").alias("ticker"),
        "l_linenumber",
        (F.col("l_suppkey") % 12).alias("early"),
        (F.col("l_discount") + 0.0).alias("f1"),
        (F.col("l_tax") + 0.0).alias("f2"),
        F.col("l_quantity").alias("f3"),
        F.col("l_extendedprice").alias("f4"),
        (F.col("l_returnflag") == "A").alias("signal"),
        F.col("l_partkey").alias("row_id"),
    )
    return rows.join(m, "ticker").select(
        "ticker", "coin", "close_us", "up", "p", "fav",
        (F.col("close_us") - (F.col("l_linenumber") * 120 + F.col("early")) * SECOND).alias("us"),
        F.col("l_linenumber").alias("line"), "row_id", "f1", "f2", "f3", "f4", "signal", F.round(logit(F.col("p")), 6).alias("base_logit"),
    )


def candles(spots: DataFrame, seconds: int) -> DataFrame:
    """Open, high, low, close of each coin by intervals of ``seconds``."""
    at = F.struct("us", "event_id")
    return spots.groupBy("coin", (F.floor(F.col("us") / (seconds * SECOND)) * seconds).alias("t")).agg(
        F.min_by("spot", at).alias("open"), F.max("spot").alias("high"), F.min("spot").alias("low"), F.max_by("spot", at).alias("close")
    )


#: The same views for DuckDB.
SQL = {
    "ticks": """ticks AS (
        SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'XRP' END AS coin, epoch_us(ts) AS us, value AS px,
               CASE WHEN event_type IN ('view', 'click') THEN 'spot' ELSE 'perp' END AS kind, epoch_us(ts) // 604800000000 AS session,
               (props::JSON ->> '$.k')::INT AS k FROM events WHERE value > 0)""",
    "snapshots": """books AS (
        SELECT event_id, coin, us, session, CASE WHEN event_id % 53 = 0 THEN px * (1 + k * 1e-5::DOUBLE) ELSE px * (1 - k * 1e-5::DOUBLE) END AS bid,
               CASE WHEN event_id % 53 = 0 THEN px * (1 - k * 1e-5::DOUBLE) ELSE px * (1 + k * 1e-5::DOUBLE) END AS ask,
               CASE WHEN event_id % 47 <> 0 THEN px * (1 + (event_id % 21 - 10) * 1e-4::DOUBLE) END AS index_price,
               px * (1 + (event_id % 13 - 6) * 1e-4::DOUBLE) AS mark, px * (1 + (event_id % 11 - 5) * 1e-4::DOUBLE) AS last_price,
               CASE WHEN event_id % 41 = 0 THEN 'error' ELSE 'fresh' END AS source_status, event_id % 19 AS index_age_s,
               CASE WHEN event_id % 29 <> 0 THEN (event_id % 100 - 50) * 1e-6::DOUBLE END AS funding_rate FROM ticks WHERE kind = 'perp'),
        mids AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 AND bid <= ask THEN (bid + ask) / 2 END AS mid FROM books),
        snapshots AS (
        SELECT *, (ask - bid) / mid * 10000 AS spread, CASE WHEN mid > 0 AND index_price > 0 THEN (mid / index_price - 1) * 10000 END AS premium,
               source_status = 'fresh' AND index_age_s <= 15 AS fresh FROM mids)""",
    "spots": """spots AS (
        SELECT event_id, coin, us, session, px AS spot, event_id % 31 <> 0 AS binary_ok, event_id % 200 AS latency_ms FROM ticks WHERE kind = 'spot')""",
    "markets": """markets AS (
        SELECT o_orderkey AS ticker, CASE o_custkey % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'XRP' END AS coin,
               epoch_us(o_orderdate) + (o_orderkey % 96) * 900000000 AS close_us, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS up,
               round(1 / (1 + exp(-(o_totalprice - 250000) / 1e5::DOUBLE)), 6) AS p, CASE WHEN o_totalprice >= 250000 THEN 'UP' ELSE 'DOWN' END AS fav FROM orders)""",
    "observations": """observations AS (
        SELECT ticker, coin, close_us, up, p, fav, close_us - (l_linenumber * 120 + l_suppkey % 12) * 1000000 AS us, l_linenumber AS line, l_partkey AS row_id,
               l_discount + 0.0::DOUBLE AS f1, l_tax + 0.0::DOUBLE AS f2, l_quantity AS f3, l_extendedprice AS f4, l_returnflag = 'A' AS signal,
               round(ln(least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))), 6) AS base_logit
        FROM lineitem JOIN markets ON l_orderkey = ticker)""",
}


def sql(*names: str, body: str) -> str:
    """A query over the views named, in this order."""
    return "WITH " + ",\n    ".join(SQL[n] for n in names) + ("," if body.lstrip().split(" ", 2)[1:2] == ["AS"] else "") + "\n" + body
