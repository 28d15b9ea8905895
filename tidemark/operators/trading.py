"""Indicators, paper settlement and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.operators import scans
from tidemark.operators.ordered import row_buckets
from tidemark.storage import written


def indicators(candles: DataFrame, n: int = 14, bands: int = 20) -> DataFrame:
    """Average true range, Bollinger position and moving average of each candle; null before enough candles."""
    candles = row_buckets(candles, ["coin"], ["t"], max(n, bands))
    w = Window.partitionBy("coin", "bucket").orderBy("t")
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = candles.withColumn("tr", F.when(before.isNotNull(), true_range))
    ranges, closes = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(bands - 1), 0)
    mean, sd = F.avg("close").over(closes), F.stddev_pop("close").over(closes)
    full = F.col("i") >= bands
    place = (
        F.when(full & (F.col("close") > mean + 2 * sd), "ABOVE").when(full & (F.col("close") < mean - 2 * sd), "BELOW").when(full, "INSIDE")
    )
    found = rows.select("coin", "t", "close", F.when(F.col("i") > n, F.avg("tr").over(ranges)).alias("atr"), F.when(full, mean).alias("mean"), F.when(full, sd).alias("sd"), place.alias("band"), "in_halo")
    return found.where(~F.col("in_halo")).drop("in_halo")


def wilder_rsi(candles: DataFrame, n: int = 14) -> DataFrame:
    """RSI by Wilder's smoothing, its place in its last ``n`` values (50 where they are all the same) and where that place went
    (compared at nine digits, so that the order of a sum cannot show).

    The mean gain and loss of the first ``n`` steps, and x = (x (n - 1) + step) / n from there on, are one linear
    recurrence, scanned over buckets of candles.
    """
    rows = scans.with_halo(scans.numbered(candles.select("coin", "t", "close"), ["coin"], ["t"]), 1)
    step = F.col("close") - F.lag("close").over(Window.partitionBy("coin", "bucket").orderBy("i"))
    steps = rows.withColumn("step", F.coalesce(step, F.lit(0.0))).where(~F.col("in_halo")).drop("in_halo")
    maps = steps.select("coin", "t", "close", "i", "bucket", F.when(F.col("i") > n, (n - 1) / n).otherwise(1.0).alias("a"), (F.greatest("step", F.lit(0.0)) / n).alias("gain"), (F.greatest(-F.col("step"), F.lit(0.0)) / n).alias("loss"))
    smooth = scans.linear_scan(maps, ["coin"], "a", ["gain", "loss"])
    rsi = F.when(F.col("i") >= n, F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss"))))
    halo = scans.with_halo(written(smooth.select("coin", "t", "close", "i", "bucket", rsi.alias("rsi"))), n)
    w = Window.partitionBy("coin", "bucket").orderBy("i")
    last = w.rowsBetween(-(n - 1), 0)
    low, high = F.min("rsi").over(last), F.max("rsi").over(last)
    place = F.when(F.col("i") >= 2 * n - 1, F.when(high > low, 100 * (F.col("rsi") - low) / (high - low)).otherwise(50.0))
    placed = halo.withColumn("stoch", place).withColumn("before", F.lag("stoch").over(w))
    arrow = F.when(F.col("i") >= 2 * n, F.when(F.round("stoch", 9) >= F.round("before", 9), "UP").otherwise("DOWN"))
    return placed.withColumn("arrow", arrow).where(~F.col("in_halo")).select("coin", "t", "close", "rsi", "stoch", "arrow")


def trailing_vol(candles: DataFrame, step: int, lookback: int = C.VOL_LOOKBACK, least: int = C.VOL_MIN) -> DataFrame:
    """Adds ``vol``: sample deviation of log returns between the candles there are in the last ``lookback`` steps."""
    # buckets of time with the lookback before them; the first candle of a frame needs none before it
    width = 64 * lookback * step
    own, last = F.floor(F.col("t") / width), F.floor((F.col("t") + lookback * step) / width)
    candles = candles.withColumn("__bucket", F.explode(F.sequence(own, last))).withColumn("__halo", F.col("__bucket") != own)
    w = Window.partitionBy("coin", "__bucket").orderBy("t")
    frame = w.rangeBetween(-lookback * step, 0)
    ret = F.log(F.col("close") / F.lag("close").over(w))
    rows = candles.withColumn("__r", ret)
    # the first candle's return reaches out of the frame: its moments are taken back out
    n, first = F.count("close").over(frame), F.coalesce(F.first("__r").over(frame), F.lit(0.0))
    total = F.coalesce(F.sum("__r").over(frame), F.lit(0.0)) - first
    square = F.coalesce(F.sum(F.col("__r") * F.col("__r")).over(frame), F.lit(0.0)) - first * first
    variance = (square - total * total / (n - 1)) / (n - 2)
    return rows.withColumn("vol", F.when(n >= least, F.sqrt(F.greatest(variance, F.lit(0.0))) * C.VOL_MULT)).where(~F.col("__halo")).drop("__r", "__bucket", "__halo")


def market_evaluation(candles: DataFrame, step: int) -> DataFrame:
    """Every candle judged against the strike at its market's start: probability, confidence, edge and the first reason."""
    size = 15 * step
    rows = trailing_vol(candles, step).withColumn("open_t", F.floor(F.col("t") / size) * size)
    strikes = candles.where(F.col("t") % size == 0).select("coin", F.col("t").alias("open_t"), F.col("close").alias("strike"))
    rows = rows.join(strikes, ["coin", "open_t"])
    rows = rows.withColumn("minutes_left", 15 - (F.col("t") - F.col("open_t")) / step)
    conf, side = M.conf_side(F.col("close"), F.col("strike"), F.col("vol"), F.col("minutes_left"))
    rows = rows.withColumn("conf", F.round(conf, 4)).withColumn("side", F.when(F.col("vol").isNotNull(), side))
    w = Window.partitionBy("coin", "open_t").orderBy("t")
    above = (F.col("close") >= F.col("strike")).cast("int")
    rows = rows.withColumn("crossed", F.coalesce(F.abs(above - F.lag(above).over(w)), F.lit(0)))
    rows = rows.withColumn("crossings", F.sum("crossed").over(w).cast("long")).drop("crossed")
    ask = F.least(F.lit(99.0), F.round(F.col("conf") - F.col("t") / step % 7, 2))
    rows = rows.withColumn("side_ask", ask).withColumn("net_edge", F.round(F.col("conf") - ask - C.ENTRY_COST, 4))
    reason = (
        F.when(F.col("vol").isNull() | ~(F.col("vol") > 0), "BLOCK_STALE_DATA").when(F.col("minutes_left") > C.ENTRY_MINUTES[1], "WAIT_TOO_EARLY")
        .when(F.col("minutes_left") < C.ENTRY_MINUTES[0], "WAIT_LATE").when(F.col("crossings") > C.CHOP_LIMIT, "BLOCK_CHOP").when(F.col("conf") < C.CONF_MIN, "WAIT_LOW_CONFIDENCE")
        .when(F.col("side_ask") < C.PRICE_MIN, "WAIT_BAD_PRICE").when(F.col("net_edge") <= 0, "WAIT_NO_EDGE").otherwise("ENTER")
    )
    return rows.withColumn("reason", reason)


def backtest(candles: DataFrame, step: int) -> DataFrame:
    """One trade at most for each 15-step market: first confident minute in the entry window, stop scan, settlement."""
    size = 15 * step
    rows = trailing_vol(candles, step)
    opened = F.floor(F.col("t") / size) * size
    # the candle at a market's end is the next one's start
    rows = rows.withColumn("open_t", F.explode(F.when(F.col("t") % size == 0, F.array(opened, opened - size)).otherwise(F.array(opened))))
    rows = rows.withColumn("elapsed", ((F.col("t") - F.col("open_t")) / step).cast("int"))
    key = ["coin", "open_t"]
    strikes = rows.where("elapsed = 0").select(*key, F.col("close").alias("strike"))
    ends = rows.where("elapsed = 15").select(*key, F.col("close").alias("final"))
    rows = rows.join(strikes, key)
    low, high = 15 - C.ENTRY_MINUTES[1], 15 - C.ENTRY_MINUTES[0]
    conf, side = M.conf_side(F.col("close"), F.col("strike"), F.col("vol"), 15 - F.col("elapsed"))
    judged = rows.withColumn("conf", conf).withColumn("side", side)
    entries = judged.where(F.col("elapsed").between(low, high) & (F.col("vol") > 0) & (F.col("conf") >= C.CONF_MIN))
    entries = entries.groupBy(*key).agg(F.min_by(F.struct("elapsed", "conf", "side", "vol"), "elapsed").alias("e")).select(*key, "e.*")
    later = rows.drop("conf").select(*key, F.col("elapsed").alias("at"), "close", "strike", F.col("vol").alias("vol_at"))
    stop = F.lit(C.STOPS[C.COINS[0]])
    for coin in C.COINS[1:]:
        stop = F.when(F.col("coin") == coin, C.STOPS[coin]).otherwise(stop)
    held = entries.withColumn("stop", F.col("conf") * stop).join(later, key).where(F.col("at") > F.col("elapsed"))
    c2, s2 = M.conf_side(F.col("close"), F.col("strike"), F.coalesce("vol_at", "vol"), F.greatest(15 - F.col("at"), F.lit(1e-4)))
    our = F.when(s2 == F.col("side"), c2).otherwise(100 - c2)
    stops = held.where(our <= F.col("stop")).groupBy(*key).agg(F.min("at").alias("stopped_at"))
    trades = entries.withColumn("stop", F.col("conf") * stop).join(strikes, key).join(stops, key, "left").join(ends, key, "left")
    win = F.when((F.col("final") >= F.col("strike")) == (F.col("side") == "UP"), 1).otherwise(0)
    trades = trades.withColumn("win", F.when(F.col("final").isNotNull(), win))
    stopped = F.col("stopped_at").isNotNull()
    pnl = F.when(stopped, F.col("stop") - F.col("conf") - C.ENTRY_COST).when(F.col("win") == 1, 100 - F.col("conf") - C.ENTRY_COST).otherwise(-F.col("conf") - C.ENTRY_COST)
    return trades.where(stopped | F.col("win").isNotNull()).select(*key, "elapsed", F.round("conf", 3).alias("conf"), "side", "stopped_at", "win", F.round(pnl, 3).alias("pnl"))


def recent_crossings(rows: DataFrame, key: str, order: str, closes: int = 16) -> DataFrame:
    """Adds how often the last closes, this one with them, went over or under the row's strike; touching it is no crossing yet."""
    w = Window.partitionBy(key, "bucket").orderBy("i").rowsBetween(-(closes - 1), 0)
    staged = row_buckets(rows, [key], [order], closes - 1).withColumn("recent", F.collect_list("close").over(w))
    n, k = F.size("recent"), F.col("strike")
    steps = F.zip_with(F.slice("recent", 1, n - 1), F.slice("recent", 2, n), lambda a, b: ((b > k) & (a <= k)) | ((b < k) & (a >= k)))
    return staged.where(~F.col("in_halo")).withColumn("crossings", F.size(F.filter(steps, lambda x: x))).drop("bucket", "in_halo", "i", "recent")


def quote_ranges(calls: DataFrame, quotes: DataFrame, bucket: int) -> DataFrame:
    """Lowest bid and ask and highest ask of a call's market between the call and its close.

    A range join: calls are spread over the time buckets they span, so that it is an equality join on (market, bucket).
    """
    spans = calls.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("call_us") / bucket), F.floor(F.col("close_us") / bucket))))
    found = spans.join(quotes.withColumn("bucket", F.floor(F.col("us") / bucket)), ["ticker", "bucket"]).where("us > call_us AND us <= close_us")
    seen = found.groupBy("ticker").agg(F.min("bid").alias("bid_lo"), F.min("ask").alias("ask_lo"), F.max("ask").alias("ask_hi"), F.count("*").alias("quotes"))
    return calls.join(seen, "ticker", "left").fillna(0, ["quotes"])


def settle(calls: DataFrame) -> DataFrame:
    """Settles calls (entry, stop, contracts, maker, side, up, bid_lo, ask_lo): unfilled, stopped or held to the result.

    A resting order fills only if the ask later came down to it.  A stop exits at the worse of stop and lowest bid and
    is a loss whatever the result.  A market without a result is not settled.
    """
    filled = ~F.col("maker") | F.coalesce(F.col("ask_lo") <= F.col("entry"), F.lit(False))
    low = F.coalesce("bid_lo", "entry")
    stopped = low <= F.col("stop")
    settled_win = M.favored_win(F.col("up"), F.col("side"))
    exit_price = F.when(stopped, F.least(low, F.col("stop"))).otherwise(settled_win * 100.0)
    fee = M.fee_cents(F.col("entry"), F.lit(1)) + M.fee_cents(exit_price, F.lit(1))
    per = F.when(filled, F.round(exit_price - F.col("entry") - fee, 1)).otherwise(0.0)
    return calls.where("up IS NOT NULL").select(
        "*",
        F.when(~filled, "unfilled").when(stopped, "stop").otherwise("settle").alias("exit_reason"),
        F.when(filled, F.round(exit_price, 1)).otherwise(0.0).alias("exit_price"),
        F.when(filled, F.when(stopped, 0).otherwise(settled_win)).cast("int").alias("win"),
        per.alias("per_contract"),
        F.round(per * F.col("contracts"), 1).alias("pnl"),
    )


def outcome_of(result: Column) -> Column:
    """1 for yes, 0 for no, whatever the case and the space around it; null for anything else."""
    text = F.lower(F.trim(result))
    return F.when(text == "yes", 1).when(text == "no", 0)


def pending(calls: DataFrame, results: DataFrame, as_of_us: int) -> DataFrame:
    """What has become of each call (ticker, close_us) by a time: status, up, settled_us.

    The result of a market is asked for from SETTLE_WAIT seconds after its close on (WAITING before that); the first final
    one seen by then, up to SETTLE_GIVE_UP seconds after the close, settles the call, and a call without one is PENDING
    until that time and then GAVE_UP.  ``results`` are (ticker, seen_us, result), as often as they were seen.
    """
    final = results.withColumn("up", outcome_of(F.col("result"))).where(F.col("up").isNotNull() & (F.col("seen_us") <= as_of_us))
    first = final.groupBy("ticker").agg(F.min(F.struct("seen_us", "up")).alias("first"))
    rows = calls.join(first, "ticker", "left")
    opens, ends = F.col("close_us") + C.SETTLE_WAIT * 1_000_000, F.col("close_us") + C.SETTLE_GIVE_UP * 1_000_000
    good = F.coalesce(F.col("first.seen_us") <= ends, F.lit(False)) & (opens <= as_of_us)
    status = F.when(opens > as_of_us, "WAITING").when(good, "SETTLED").when(ends < as_of_us, "GAVE_UP").otherwise("PENDING")
    return rows.select(*calls.columns, status.alias("status"), F.when(good, F.col("first.up")).alias("up"), F.when(good, F.greatest(F.col("first.seen_us"), opens)).alias("settled_us"))
