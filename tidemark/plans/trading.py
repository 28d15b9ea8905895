"""Queries about paper trades: quotes, settlement, statistics, indicators, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.operators import cohorts
from tidemark.operators import trading as T
from tidemark.operators.groups import overall_and_by, share
from tidemark.plans.evaluation import SIGNAL_SQL, observed
from tidemark.sources import views as V

STEP = 3600
DAY = 86400 * V.SECOND
#: Reports look back from here.
AS_OF_US = 883612800 * V.SECOND


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper call per market, at its first signal."""
    first = cohorts.first_signals(observed(spark, sf_dir).withColumn("up", F.coalesce("up", F.lit(-1))))
    entry = (60 + F.col("row_id") % 35).cast("double")
    return first.select(
        "ticker", "coin", "close_us", F.when(F.col("up") >= 0, F.col("up")).alias("up"), F.col("fav").alias("side"), F.col("us").alias("call_us"), entry.alias("entry"),
        F.round(entry * 0.75, 1).alias("stop"), F.col("f3").cast("int").alias("contracts"), (F.col("line") % 2 == 0).alias("maker"), "p",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = (40 + F.col("row_id") * 7 % 55).cast("double")
    return observed(spark, sf_dir).select("ticker", "us", bid.alias("bid"), (bid + 2).alias("ask"))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.settle(T.quote_ranges(calls(spark, sf_dir), quotes(spark, sf_dir), 900 * V.SECOND))


def settle_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, sf_dir).select("ticker", "coin", "side", "entry", "stop", "contracts", "maker", "bid_lo", "ask_lo", "ask_hi", "quotes", "exit_reason", "exit_price", "win", "per_contract", "pnl")


def fees_and_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    conf = F.greatest("p", 1 - F.col("p")) * 100
    price = F.col("entry")
    share_of = F.when(conf - price - C.ENTRY_COST > 0, M.kelly_fraction(conf, price)).otherwise(0.0)
    return rows.select(
        "ticker", F.round(M.fee_cents(price, F.col("contracts")), 2).alias("fee"), F.round(share_of, 6).alias("fraction"), F.floor(F.round(share_of * 1000 / (price / 100), 6)).cast("int").alias("size"),
        F.round(conf - price, 4).alias("raw_edge"), F.round(conf - price - C.ENTRY_COST, 4).alias("net_edge"),
    )


def _record(rows: DataFrame, by: list[str]) -> DataFrame:
    """Wins, settled calls, percentages, the winning streak at the end, money."""
    played = F.col("win").isNotNull()
    order = F.struct("close_us", "ticker")
    last_loss = rows.groupBy(*by).agg(F.max(F.when(F.col("win") == 0, order)).alias("last_loss"))
    after = rows.join(last_loss, by).withColumn("after", played & (F.col("win") == 1) & (F.col("last_loss").isNull() | (order > F.col("last_loss"))))
    staked = F.sum(F.when(played, F.col("entry") * F.col("contracts")))
    return after.groupBy(*by).agg(
        F.sum("win").alias("w"), F.count("win").alias("n"), share(F.sum("win"), F.count("win"), 1).alias("pct"), F.count_if("after").alias("streak"),
        F.round(F.sum("pnl"), 1).alias("pnl"), F.round(F.sum("pnl") / staked * 100, 3).alias("margin"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))


def call_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(_grouped(settled(spark, sf_dir)), ["grp"])


def live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of calls closed in the last 30, 365 and all days before the report."""
    rows = _grouped(settled(spark, sf_dir)).where(F.col("close_us") <= AS_OF_US)
    spans = F.array(F.lit("all"), F.when(F.col("close_us") > AS_OF_US - 365 * DAY, "d365"), F.when(F.col("close_us") > AS_OF_US - 30 * DAY, "d30"))
    return _record(rows.withColumn("span", F.explode(F.array_compact(spans))), ["grp", "span"])


def week_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(spark, sf_dir).where("win IS NOT NULL").withColumn("week", F.floor((F.col("close_us") / DAY + 3) / 7).cast("long"))
    return rows.groupBy("week").agg(F.count("*").alias("n"), F.sum("win").alias("w"), F.round(F.sum("pnl"), 1).alias("pnl"))


def _weekday() -> F.Column:
    """0 is Monday; days are UTC."""
    return F.pmod(F.floor(F.col("close_us") / DAY) + 3, F.lit(7)).cast("int")


def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By weekday, with the best day and the best hour of at least 20 calls."""
    rows = settled(spark, sf_dir).where("win IS NOT NULL").withColumn("day", _weekday()).withColumn("hour", F.pmod(F.floor(F.col("close_us") / (3600 * V.SECOND)), F.lit(24)).cast("int"))
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("win").alias("w"), F.round(F.sum("pnl"), 1).alias("pnl"))
    best_day = days.agg(F.max_by("day", F.struct(F.col("w") / F.col("n"), -F.col("day"))).alias("best_day"))
    hours = rows.groupBy("hour").agg(F.count("*").alias("n"), F.sum("win").alias("w")).where("n >= 20")
    best_hour = hours.agg(F.max_by("hour", F.struct(F.col("w") / F.col("n"), -F.col("hour"))).alias("best_hour"))
    # two tables of one row
    return days.join(F.broadcast(best_day), how="left").join(F.broadcast(best_hour), how="left")


def side_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(spark, sf_dir)
    return rows.groupBy("coin", "side", "exit_reason").agg(F.count("*").alias("n"), F.sum("win").alias("w"), F.round(F.avg("per_contract"), 3).alias("mean_pc"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles: their number grows with time, not with ticks, so that a window over a coin stays small."""
    return V.candles(V.spots(V.ticks(spark, sf_dir)), STEP)


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.candles(V.spots(V.ticks(spark, sf_dir)), 900)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.indicators(hourly(spark, sf_dir)).select("coin", "t", "close", *[F.round(c, 5).alias(c) for c in ("atr", "mean", "sd")], "band")


def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI of the candles that stand for minutes in this module (STEP)."""
    return T.wilder_rsi(hourly(spark, sf_dir)).select("coin", "t", F.round("rsi", 5).alias("rsi"), F.round("stoch", 4).alias("stoch"), "arrow")


def market_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.market_evaluation(hourly(spark, sf_dir), STEP).select("coin", "t", "open_t", "minutes_left", "conf", "side", "crossings", "net_edge", "reason")


def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.backtest(hourly(spark, sf_dir), STEP)


def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = T.backtest(hourly(spark, sf_dir), STEP)
    wr = F.avg("win")
    return overall_and_by(trades, "coin", [
        F.count("*").alias("n"), F.sum("win").alias("w"), F.round(100 * wr, 2).alias("wr"), F.round(wr * 10 - (1 - wr) * 90 - C.ENTRY_COST, 3).alias("exp90"), F.round(F.avg("pnl"), 3).alias("avg_pnl"),
        F.round(F.sum("pnl"), 2).alias("net"), F.count("stopped_at").alias("stopped"), *[F.count_if((F.col("conf") >= a) & (F.col("conf") < b)).alias(f"band_{a}") for a, b in ((80, 85), (85, 90), (90, 95), (95, 101))],
    ])


def pending_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has become of each call by the middle of its market's minute-by-minute results; a third of them are seen twice."""
    made = calls(spark, sf_dir).select("ticker", "coin", "close_us", "up")
    seen = made.withColumn("nth", F.explode(F.when(F.col("ticker") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = F.col("close_us") + (F.col("ticker") % 45 - 2 + 5 * F.col("nth")) * 60 * V.SECOND
    text = F.when(F.col("up") == 1, F.when(F.col("ticker") % 2 == 0, "yes").otherwise(" YES ")).when(F.col("up") == 0, "no").otherwise("void")
    results = seen.select("ticker", at.alias("seen_us"), text.alias("result"))
    return T.pending(made.drop("up"), results, AS_OF_US)


def queries() -> dict:
    own = (pending_calls, settle_calls, fees_and_sizing, call_record, live_stats, week_stats, weekly_report, side_report, candles, indicators, rsi, market_eval, backtest_trades, backtest_summary)
    return {f.__name__: f for f in own}


_FEE = "CASE WHEN {c} <= 0 THEN 0 ELSE greatest(ceil(0.07::DOUBLE * {c} * {p} * (1 - {p}) * 100 - 1e-9::DOUBLE), 1) END"


def _fee(price: str, contracts: str) -> str:
    p = f"greatest(0.01::DOUBLE, least(0.99::DOUBLE, {price} / 100))"
    return _FEE.format(c=contracts, p=p)


CALLS_SQL = """first_calls AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY us, row_id) AS place FROM observations WHERE signal AND (close_us - us) / 60000000 BETWEEN 2 AND 8) WHERE place = 1),
    calls AS (SELECT ticker, coin, close_us, up, fav AS side, us AS call_us, (60 + row_id % 35)::DOUBLE AS entry, round((60 + row_id % 35)::DOUBLE * 0.75::DOUBLE, 1) AS stop, f3::INT AS contracts, line % 2 = 0 AS maker, p FROM first_calls)"""
SETTLED_SQL = CALLS_SQL + f""", quotes AS (SELECT ticker, us, (40 + row_id * 7 % 55)::DOUBLE AS bid, (42 + row_id * 7 % 55)::DOUBLE AS ask FROM observations),
    ranged AS (SELECT c.*, q.* EXCLUDE (tk), coalesce(n, 0) AS quotes FROM calls c LEFT JOIN (SELECT c.ticker AS tk, min(bid) AS bid_lo, min(ask) AS ask_lo, max(ask) AS ask_hi, count(*) AS n
               FROM calls c JOIN quotes q ON q.ticker = c.ticker AND q.us > c.call_us AND q.us <= c.close_us GROUP BY 1) q ON tk = ticker),
    staged AS (SELECT *, NOT maker OR coalesce(ask_lo <= entry, false) AS filled, coalesce(bid_lo, entry) AS low, coalesce(bid_lo, entry) <= stop AS stopped, CASE side WHEN 'UP' THEN up ELSE 1 - up END AS settled_win FROM ranged WHERE up IS NOT NULL),
    priced AS (SELECT *, CASE WHEN stopped THEN least(low, stop) ELSE settled_win * 100.0::DOUBLE END AS xp FROM staged),
    settled AS (SELECT *, CASE WHEN NOT filled THEN 'unfilled' WHEN stopped THEN 'stop' ELSE 'settle' END AS exit_reason, CASE WHEN filled THEN round(xp, 1) ELSE 0 END AS exit_price,
               CASE WHEN filled THEN CASE WHEN stopped THEN 0 ELSE settled_win END END AS win, CASE WHEN filled THEN round(xp - entry - {_fee("entry", "1")} - {_fee("xp", "1")}, 1) ELSE 0 END AS per_contract FROM priced),
    done AS (SELECT *, round(per_contract * contracts, 1) AS pnl FROM settled)"""
HOURLY_SQL = f"""hourly AS (SELECT coin, us // {STEP * V.SECOND} * {STEP} AS t, arg_min(spot, us) AS open, max(spot) AS high, min(spot) AS low, arg_max(spot, us) AS close FROM spots GROUP BY ALL)"""
VOL_SQL = f"""returns AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY coin ORDER BY t)) AS r FROM hourly),
    vols AS (SELECT coin, t, close, CASE WHEN n >= 20 THEN sqrt(greatest((sq - s * s / (n - 1)) / (n - 2), 0)) * 1.15::DOUBLE END AS vol FROM (
        SELECT coin, t, close, count(*) OVER w AS n, coalesce(sum(r) OVER w, 0) - coalesce(first_value(r) OVER w, 0) AS s, coalesce(sum(r * r) OVER w, 0) - coalesce(first_value(r) OVER w, 0) ** 2 AS sq
        FROM returns WINDOW w AS (PARTITION BY coin ORDER BY t RANGE BETWEEN {60 * STEP} PRECEDING AND CURRENT ROW)))"""


def _cdf(spot: str, strike: str, vol: str, left: str) -> str:
    z = f"(ln({spot} / {strike}) / ({vol} * sqrt(greatest({left}, 1e-4::DOUBLE))))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2)))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    upper = f"(1 - 0.5::DOUBLE * {poly} * exp(-{z} * {z} / 2))"
    return f"CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END"


def _record_sql(by: str) -> str:
    return f"""SELECT {by}, sum(win)::BIGINT AS w, count(win) AS n, round(100 * sum(win) / nullif(count(win), 0), 1) AS pct, count(*) FILTER (win = 1 AND (last_loss IS NULL OR (close_us, ticker) > last_loss)) AS streak,
        round(sum(pnl), 1) AS pnl, round(sum(pnl) / sum(CASE WHEN win IS NOT NULL THEN entry * contracts END) * 100, 3) AS margin
        FROM (SELECT *, max(CASE WHEN win = 0 THEN (close_us, ticker) END) OVER (PARTITION BY {by}) AS last_loss FROM recorded) GROUP BY {by}"""


def oracle_sql() -> dict[str, str]:
    obs = "WITH " + V.SQL["markets"] + ", " + V.SQL["observations"] + ", "
    both = "SELECT 'ALL' AS grp, * FROM done UNION ALL SELECT coin, * FROM done"
    market = "WITH " + ", ".join([V.SQL["ticks"], V.SQL["spots"], HOURLY_SQL]) + " "
    size = 15 * STEP
    stops = "CASE coin " + " ".join(f"WHEN '{c}' THEN {s}::DOUBLE" for c, s in C.STOPS.items()) + " END"
    trades = market.rstrip() + f""", {VOL_SQL},
        placed AS (SELECT *, (t - open_t) // {STEP} AS elapsed FROM (SELECT *, t // {size} * {size} AS open_t FROM vols UNION ALL SELECT *, t - {size} FROM vols WHERE t % {size} = 0)),
        struck AS (SELECT p.*, s.close AS strike FROM placed p JOIN placed s ON s.coin = p.coin AND s.open_t = p.open_t AND s.elapsed = 0),
        judged AS (SELECT *, {_cdf("close", "strike", "vol", "(15 - elapsed)")} AS cdf FROM struck),
        entries AS (SELECT * FROM (SELECT *, greatest(cdf, 1 - cdf) * 100 AS conf, CASE WHEN cdf >= 0.5 THEN 'UP' ELSE 'DOWN' END AS side, row_number() OVER (PARTITION BY coin, open_t ORDER BY elapsed) AS place
                    FROM judged WHERE elapsed BETWEEN 7 AND 13 AND vol > 0 AND greatest(cdf, 1 - cdf) * 100 >= 80) WHERE place = 1),
        held AS (SELECT e.coin, e.open_t, l.elapsed AS at_step, e.conf * {stops.replace("coin", "e.coin")} AS stop, e.side, {_cdf("l.close", "l.strike", "coalesce(l.vol, e.vol)", "(15 - l.elapsed)")} AS cdf
                 FROM entries e JOIN struck l ON l.coin = e.coin AND l.open_t = e.open_t AND l.elapsed > e.elapsed),
        stops AS (SELECT coin, open_t, min(at_step) AS stopped_at FROM held WHERE CASE WHEN (cdf >= 0.5) = (side = 'UP') THEN greatest(cdf, 1 - cdf) * 100 ELSE 100 - greatest(cdf, 1 - cdf) * 100 END <= stop GROUP BY ALL),
        ended AS (SELECT e.*, stopped_at, CASE WHEN f.close IS NOT NULL THEN ((f.close >= e.strike) = (side = 'UP'))::INT END AS win, e.conf * {stops.replace("coin", "e.coin")} AS stop
                  FROM entries e LEFT JOIN stops s ON s.coin = e.coin AND s.open_t = e.open_t LEFT JOIN placed f ON f.coin = e.coin AND f.open_t = e.open_t AND f.elapsed = 15),
        trades AS (SELECT coin, open_t, elapsed::INT AS elapsed, round(conf, 3) AS conf, side, stopped_at::INT AS stopped_at, win,
                   round(CASE WHEN stopped_at IS NOT NULL THEN stop - conf - 2 WHEN win = 1 THEN 100 - conf - 2 ELSE -conf - 2 END, 3) AS pnl FROM ended WHERE stopped_at IS NOT NULL OR win IS NOT NULL) """
    weekday = "((close_us // 86400000000) + 3) % 7"
    return {
        "settle_calls": obs + SETTLED_SQL + " SELECT ticker, coin, side, entry, stop, contracts, maker, bid_lo, ask_lo, ask_hi, quotes, exit_reason, exit_price, win, per_contract, pnl FROM done",
        "pending_calls": obs + CALLS_SQL + f""", seen AS (SELECT ticker, close_us + (ticker % 45 - 2 + 5 * nth) * 60000000 AS seen_us, CASE WHEN up = 1 THEN 'yes' WHEN up = 0 THEN 'no' ELSE 'void' END AS result
                FROM calls, (SELECT unnest([0, 1])::INT AS nth) WHERE nth = 0 OR ticker % 3 = 0),
            finals AS (SELECT ticker, min(seen_us) AS seen_us, arg_min(CASE result WHEN 'yes' THEN 1 ELSE 0 END, seen_us) AS final FROM seen WHERE result IN ('yes', 'no') AND seen_us <= {AS_OF_US} GROUP BY ticker),
            matched AS (SELECT c.ticker, coin, close_us, seen_us, final, close_us + {C.SETTLE_WAIT * V.SECOND} AS opens, close_us + {C.SETTLE_GIVE_UP * V.SECOND} AS ends FROM calls c LEFT JOIN finals USING (ticker)),
            judged AS (SELECT *, coalesce(seen_us <= ends, false) AND opens <= {AS_OF_US} AS good FROM matched)
            SELECT ticker, coin, close_us, CASE WHEN opens > {AS_OF_US} THEN 'WAITING' WHEN good THEN 'SETTLED' WHEN ends < {AS_OF_US} THEN 'GAVE_UP' ELSE 'PENDING' END AS status, CASE WHEN good THEN final END AS up, CASE WHEN good THEN greatest(seen_us, opens) END AS settled_us FROM judged""",
        "fees_and_sizing": obs + CALLS_SQL + f""" SELECT ticker, round({_fee("entry", "contracts")}, 2) AS fee, round(fr, 6) AS fraction, floor(round(fr * 1000 / (entry / 100), 6))::INT AS size, round(conf - entry, 4) AS raw_edge, round(conf - entry - 2, 4) AS net_edge
            FROM (SELECT *, CASE WHEN conf - entry - 2 > 0 AND ((conf - 2) / 100 - entry / 100) / (1 - entry / 100) > 0 THEN least(((conf - 2) / 100 - entry / 100) / (1 - entry / 100) / 4, 0.05::DOUBLE) ELSE 0 END AS fr FROM (SELECT *, greatest(p, 1 - p) * 100 AS conf FROM calls))""",
        "call_record": obs + SETTLED_SQL + f", recorded AS ({both}) " + _record_sql("grp"),
        "live_stats": obs + SETTLED_SQL + f""", recorded AS (SELECT * FROM ({both}), (SELECT unnest(['all', 'd365', 'd30']) AS span)
            WHERE close_us <= {AS_OF_US} AND (span = 'all' OR span = 'd365' AND close_us > {AS_OF_US - 365 * DAY} OR span = 'd30' AND close_us > {AS_OF_US - 30 * DAY})) """ + _record_sql("grp, span"),
        "week_stats": obs + SETTLED_SQL + " SELECT floor((close_us / 86400000000 + 3) / 7)::BIGINT AS week, count(*) AS n, sum(win)::BIGINT AS w, round(sum(pnl), 1) AS pnl FROM done WHERE win IS NOT NULL GROUP BY ALL",
        "weekly_report": obs + SETTLED_SQL + f""", played AS (SELECT *, {weekday} AS day, (close_us // 3600000000) % 24 AS hour FROM done WHERE win IS NOT NULL)
            SELECT day::INT AS day, count(*) AS n, sum(win)::BIGINT AS w, round(sum(pnl), 1) AS pnl, (SELECT day FROM played GROUP BY day ORDER BY avg(win) DESC, day LIMIT 1)::INT AS best_day,
                   (SELECT hour FROM played GROUP BY hour HAVING count(*) >= 20 ORDER BY avg(win) DESC, hour LIMIT 1)::INT AS best_hour FROM played GROUP BY day""",
        "side_report": obs + SETTLED_SQL + " SELECT coin, side, exit_reason, count(*) AS n, sum(win)::BIGINT AS w, round(avg(per_contract), 3) AS mean_pc FROM done GROUP BY ALL",
        "candles": "WITH " + V.SQL["ticks"] + ", " + V.SQL["spots"] + " SELECT coin, us // 900000000 * 900 AS t, arg_min(spot, us) AS open, max(spot) AS high, min(spot) AS low, arg_max(spot, us) AS close FROM spots GROUP BY ALL",
        "indicators": market + f""" SELECT coin, t, close, round(CASE WHEN i > 14 THEN avg(tr) OVER (PARTITION BY coin ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END, 5) AS atr,
            round(CASE WHEN i >= 20 THEN mean END, 5) AS mean, round(CASE WHEN i >= 20 THEN sd END, 5) AS sd, CASE WHEN i < 20 THEN NULL WHEN close > mean + 2 * sd THEN 'ABOVE' WHEN close < mean - 2 * sd THEN 'BELOW' ELSE 'INSIDE' END AS band
            FROM (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM (SELECT *, lag(close) OVER w AS prev, row_number() OVER w AS i,
                  avg(close) OVER (PARTITION BY coin ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean, stddev_pop(close) OVER (PARTITION BY coin ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM hourly WINDOW w AS (PARTITION BY coin ORDER BY t)))""",
        "rsi": "WITH RECURSIVE " + market.removeprefix("WITH ").rstrip() + """, steps AS (SELECT coin, t, row_number() OVER w AS i, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down FROM hourly WINDOW w AS (PARTITION BY coin ORDER BY t)),
            smooth AS (SELECT coin, 15::BIGINT AS i, avg(up) AS g, avg(down) AS d FROM steps WHERE i BETWEEN 2 AND 15 GROUP BY coin HAVING count(*) = 14
                       UNION ALL SELECT s.coin, s.i, (m.g * 13 + s.up) / 14, (m.d * 13 + s.down) / 14 FROM smooth m JOIN steps s ON s.coin = m.coin AND s.i = m.i + 1),
            valued AS (SELECT coin, t, i, CASE WHEN g IS NOT NULL THEN CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + g / d) END END AS rsi FROM steps LEFT JOIN smooth USING (coin, i)),
            placed AS (SELECT *, CASE WHEN count(rsi) OVER w = 14 THEN CASE WHEN max(rsi) OVER w > min(rsi) OVER w THEN 100 * (rsi - min(rsi) OVER w) / (max(rsi) OVER w - min(rsi) OVER w) ELSE 50 END END AS stoch
                       FROM valued WINDOW w AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
            followed AS (SELECT *, lag(stoch) OVER (PARTITION BY coin ORDER BY t) AS before FROM placed)
            SELECT coin, t, round(rsi, 5) AS rsi, round(stoch, 4) AS stoch, CASE WHEN before IS NOT NULL THEN CASE WHEN round(stoch, 9) >= round(before, 9) THEN 'UP' ELSE 'DOWN' END END AS arrow FROM followed""",
        "market_eval": market.rstrip() + f""", {VOL_SQL}, opened AS (SELECT v.*, v.t // {size} * {size} AS open_t, s.close AS strike, 15 - (v.t % {size}) / {STEP} AS minutes_left FROM vols v JOIN hourly s ON s.coin = v.coin AND s.t = v.t // {size} * {size}),
            rated AS (SELECT *, {_cdf("close", "strike", "vol", "minutes_left")} AS cdf, coalesce(abs((close >= strike)::INT - lag((close >= strike)::INT) OVER (PARTITION BY coin, open_t ORDER BY t)), 0) AS crossed FROM opened),
            sided AS (SELECT *, round(greatest(cdf, 1 - cdf) * 100, 4) AS conf, CASE WHEN vol IS NOT NULL THEN CASE WHEN cdf >= 0.5 THEN 'UP' ELSE 'DOWN' END END AS side, sum(crossed) OVER (PARTITION BY coin, open_t ORDER BY t)::BIGINT AS crossings FROM rated),
            asked AS (SELECT *, CASE WHEN conf IS NOT NULL THEN least(99, round(conf - (t / {STEP}) % 7, 2)) ELSE 99 END AS ask FROM sided)
            SELECT coin, t, open_t, minutes_left, conf, side, crossings, round(conf - ask - 2, 4) AS net_edge,
                   CASE WHEN vol IS NULL OR NOT vol > 0 THEN 'BLOCK_STALE_DATA' WHEN minutes_left > 8 THEN 'WAIT_TOO_EARLY' WHEN minutes_left < 2 THEN 'WAIT_LATE' WHEN crossings > 3 THEN 'BLOCK_CHOP' WHEN conf < 80 THEN 'WAIT_LOW_CONFIDENCE'
                        WHEN ask < 85 THEN 'WAIT_BAD_PRICE' WHEN round(conf - ask - 2, 4) <= 0 THEN 'WAIT_NO_EDGE' ELSE 'ENTER' END AS reason FROM asked""",
        "backtest_trades": trades + "SELECT * FROM trades",
        "backtest_summary": trades + """SELECT CASE WHEN grouping(coin) = 0 THEN coin ELSE 'ALL' END AS grp, count(*) AS n, sum(win)::BIGINT AS w, round(100 * avg(win), 2) AS wr, round(avg(win) * 10 - (1 - avg(win)) * 90 - 2, 3) AS exp90, round(avg(pnl), 3) AS avg_pnl,
            round(sum(pnl), 2) AS net, count(stopped_at) AS stopped, count(*) FILTER (conf >= 80 AND conf < 85) AS band_80, count(*) FILTER (conf >= 85 AND conf < 90) AS band_85, count(*) FILTER (conf >= 90 AND conf < 95) AS band_90, count(*) FILTER (conf >= 95 AND conf < 101) AS band_95
            FROM trades GROUP BY GROUPING SETS ((), (coin))""",
    }
