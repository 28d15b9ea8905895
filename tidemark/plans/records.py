"""Queries about records: texts and times, books, bars, symbols, labels, their files, and which rows are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.functions import text as T
from tidemark.operators import cohorts
from tidemark.operators import integrity as I
from tidemark.plans.evaluation import HORIZON_SQL, SIGNAL_SQL, label_status, observed, with_market
from tidemark.plans.evaluation import oracle_sql as evaluation_sql
from tidemark.plans.trading import AS_OF_US, CALLS_SQL, calls
from tidemark.sources import files, formats
from tidemark.sources import views as V
from tidemark.storage import reserved

LABEL_SOURCE = "exchange result"
DURATIONS = {"48h": 2.0, "10d": 10.0, "2w": 14.0, "3m": 90.0, "7": 7.0, "soon": 30.0, "": 30.0, "1.5d": 1.5}
OVERRIDES = {"SOL": "SOL-CHOSEN"}


def _by_turn(key: F.Column, values: list) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _off_grid(x: F.Column) -> F.Column:
    """Three digits, cut where round values do not tie."""
    return (F.floor(x * 1000 + 0.1234) / 1000).cast("double")


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close times written in several ways and read again, with local hours, ages, durations, flags and seeds."""
    rows, k = V.markets(spark, sf_dir), F.col("ticker")
    iso = F.substring(T.iso_text(F.col("close_us")), 1, 19)
    tails = {0: ".25Z", 1: "+00:00", 2: "+02:00", 3: ""}
    written = F.when(k % 6 == 4, "no time").when(k % 6 == 5, F.substring(iso, 1, 10)).otherwise(F.concat(iso, F.coalesce(*(F.when(k % 6 == i, x) for i, x in tails.items()))))
    rows = rows.withColumn("parsed_us", T.iso_micros(written))
    return rows.select(
        "ticker", "parsed_us", T.iso_text(F.col("parsed_us")).alias("parsed_text"), T.local_hour(F.col("close_us")).alias("local_hour"), F.round(T.age_hours(F.col("parsed_us"), AS_OF_US), 6).alias("age_h"),
        T.duration_days(_by_turn(k, list(DURATIONS))).alias("days"), T.distinct_flags(_by_turn(k, ["STALE;NO_BOOK;STALE", "STALE", ""])).alias("flags"), T.derived_seed(F.lit(C.SEED), F.col("coin"), k).alias("seed"),
        F.sha2(T.canonical_row("ticker", "coin", "close_us", "up"), 256).alias("canonical_sha256"),
    )


def market_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided books of binary markets, the missing asks from the other side, strikes, resting prices and margins."""
    i, x = F.col("row_id"), F.col("f4")
    bid = (30 + i % 40).cast("double")
    rows = observed(spark, sf_dir).select(
        "ticker", "line", "fav", "row_id", (F.greatest("p", 1 - F.col("p")) * 100).alias("conf"), F.when(i % 5 != 0, bid).alias("yes_bid"), F.when(i % 6 != 0, 97 - bid - i % 3).alias("no_bid"),
        F.when(i % 7 != 0, bid + 1 + i % 4).alias("yes_given"), F.when(i % 3 != 0, 100 - bid + i % 2).alias("no_given"),
        F.coalesce(F.when(i % 3 == 0, x), F.when(i % 3 == 1, x + 1), F.when(i % 11 != 0, x + 2)).alias("strike"),
    )
    rows = rows.withColumn("yes_ask", M.other_ask(F.col("yes_given"), F.col("no_bid"))).withColumn("no_ask", M.other_ask(F.col("no_given"), F.col("yes_bid")))
    up = F.col("fav") == "UP"
    rows = rows.withColumn("side_bid", F.when(up, F.col("yes_bid")).otherwise(F.col("no_bid"))).withColumn("side_ask", F.when(up, F.col("yes_ask")).otherwise(F.col("no_ask")))
    stop = F.when(i % 2 == 0, F.round(F.col("side_ask") * 0.75, 1))
    return rows.select("ticker", "line", "strike", "yes_bid", "yes_ask", "no_bid", "no_ask", M.resting_price(F.col("side_bid"), F.col("side_ask")).alias("limit_price"), _off_grid(M.expected_margin(F.col("conf"), F.col("side_ask"), stop)).alias("margin"))


def next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market of each coin that closes next after a moment; of several the smallest ticker."""
    open_now = V.markets(spark, sf_dir).where(F.col("close_us") > AS_OF_US)
    return open_now.groupBy("coin").agg(F.min_by(F.struct("ticker", "close_us"), F.struct("close_us", "ticker")).alias("m"), F.count("*").alias("n_open")).select("coin", "m.*", "n_open")


def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 60 one-minute bars of each coin.  The rank is cut in each partition before the shuffle."""
    bars = V.candles(V.spots(V.ticks(spark, sf_dir)), 60)
    newest = Window.partitionBy("coin").orderBy(F.desc("t"))
    return bars.withColumn("place", F.row_number().over(newest)).where("place <= 60").drop("place")


def history_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes by minute from pages that overlap: a fourth of the ticks comes again in a later page with another price."""
    ticks = V.spots(V.ticks(spark, sf_dir)).select("coin", (F.floor(F.col("us") / (60 * V.SECOND)) * 60).alias("t"), F.col("event_id").alias("seq"), F.col("spot").alias("close"))
    again = ticks.where("seq % 4 = 0").select("coin", "t", (F.col("seq") + 10**12).alias("seq"), (F.col("close") + 1).alias("close"))
    newest = formats.last_written(ticks.unionByName(again), ["coin", "t"], "seq")
    return newest.select("coin", "t", F.floor(F.col("t") / 18000).alias("page"), F.round("close", 6).alias("close"), "versions")


def symbol_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perpetual symbol of each coin from a listing: an override wins, then the best score if no other name has it."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, coin = F.col("p_partkey"), V.coin_of(F.col("p_partkey"))
    name = F.when(k % 3 == 0, F.concat(coin, F.lit("perp"), k)).when(k % 3 == 1, F.concat(F.lit("X"), coin, k)).otherwise(F.concat(coin, F.lit("SPOT"), k))
    active = (F.col("p_size") == 50) & F.col("p_brand").startswith("Brand#1")
    return formats.resolve_symbols(parts.select(name.alias("symbol"), F.when(active, "active").otherwise("closed").alias("status")), [*C.COINS, "DOGE"], OVERRIDES)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by status, and how many of them may be used: final, with outcome 0 or 1."""
    usable = F.count_if((F.col("status") == "final") & F.col("outcome").isin(0, 1))
    return label_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), usable.alias("usable"), F.min("close_us").alias("first_us"))


def label_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label cache after two rewrites, the second of which reads what the first one wrote."""
    labels, path, order = label_status(spark, sf_dir), reserved(spark, "labels"), ["close_us", "ticker"]
    files.rewrite(labels.where("ticker % 2 = 0"), path, order)
    cached = spark.read.schema(labels.schema).parquet(path)
    files.rewrite(cached.unionByName(labels.where("ticker % 2 <> 0")), path, order)
    return spark.read.schema(labels.schema).parquet(path)


def promotion_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal keyed by promotion and ticker, written twice: the second run adds only keys that it did not hold."""
    rows = observed(spark, sf_dir).where("signal").select(F.when(F.col("line") % 2 == 0, "m1").otherwise("m2").alias("promotion"), "ticker", "us", "row_id")
    path, keys = reserved(spark, "journal"), ["promotion", "ticker"]
    rows = rows.groupBy(*keys, "us").agg(F.min("row_id").alias("row_id"))
    formats.append_new(rows.where("ticker % 4 <> 0"), path, keys, "us")
    formats.append_new(rows.withColumn("row_id", F.when(F.col("ticker") % 4 != 0, -1).otherwise(F.col("row_id"))), path, keys, "us")
    return spark.read.schema(rows.schema).parquet(path)


def rotated_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of an old layout, moved aside when the first of a new layout are appended."""
    rows, path = calls(spark, sf_dir), reserved(spark, "trades")
    files.append_rows(rows.where("ticker % 2 = 0").select("ticker", "side"), path)
    new = rows.where("ticker % 2 <> 0").select("ticker", "side", "entry")
    aside = files.append_rows(new.where("ticker % 3 = 0"), path)
    files.append_rows(new.where("ticker % 3 <> 0"), path)
    old = spark.read.schema("ticker long, side string").parquet(aside)
    current = spark.read.schema(new.schema).parquet(path)
    return current.withColumn("layout", F.lit("current")).unionByName(old.withColumn("layout", F.lit("rotated")), allowMissingColumns=True)


def label_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session ids and labels that were not made by the recorder and the labeller, by coin."""
    k, close = F.col("ticker"), F.col("close_us")
    stamp = F.regexp_replace(F.substring(T.iso_text(close), 1, 19), "[-:]", "")
    session = F.when(k % 29 == 0, F.concat(F.lit("manual-"), k)).otherwise(F.concat(stamp, F.lit("Z-"), F.lower(F.lpad(F.hex(k), 8, "0"))))
    source = F.when(k % 31 == 0, "typed in").when(k % 41 != 0, LABEL_SOURCE)
    labelled = F.when(k % 37 == 0, close).otherwise(close + 120 * V.SECOND)
    rows = V.markets(spark, sf_dir).select("coin", I.unsound_session(session).alias("s"), I.unsound_label(source, LABEL_SOURCE, labelled, close).alias("l"))
    bad = rows.groupBy("coin").agg(F.count("*").alias("n"), F.count_if("s").alias("bad_sessions"), F.count_if("l").alias("bad_labels"))
    return bad.withColumn("problems", F.concat_ws(";", F.when(F.col("bad_sessions") > 0, "SESSIONS"), F.when(F.col("bad_labels") > 0, "LABELS")))


def discovery_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-signal cohort of each group up to a cutoff; nothing that closes later may be used."""
    rows = cohorts.first_signals(observed(spark, sf_dir)).withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))
    kept = F.col("close_us") <= AS_OF_US
    return rows.groupBy("grp").agg(F.count_if(kept).alias("n"), F.count_if(~kept).alias("n_later"), F.max(F.when(kept, F.col("close_us"))).alias("last_us"))


def analysed_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers of the horizon cohorts, of the first signals and of either, by coin."""
    rows = observed(spark, sf_dir)
    by_horizon = cohorts.horizon_rows(rows).select("coin", "ticker").withColumn("kind", F.lit("horizon"))
    by_signal = cohorts.first_signals(rows).select("coin", "ticker").withColumn("kind", F.lit("signal"))
    each = by_horizon.union(by_signal).groupBy("coin", "ticker").agg(F.bool_or(F.col("kind") == "horizon").alias("h"), F.bool_or(F.col("kind") == "signal").alias("s"))
    return each.groupBy("coin").agg(F.count_if("h").alias("n_horizon"), F.count_if("s").alias("n_signal"), F.count("*").alias("n"))


def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows that some analysis needs: those near a horizon and the first signals, each once."""
    rows, columns = observed(spark, sf_dir), ["ticker", "line", "coin", "us", "row_id"]
    return cohorts.horizon_rows(rows).select(*columns).union(cohorts.first_signals(rows).select(*columns)).distinct()


def spot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot prices by session and coin, one for each time: of several the first that came."""
    spots = V.spots(V.ticks(spark, sf_dir))
    return spots.groupBy("session", "coin", "us").agg(F.min("event_id").alias("event_id"), F.min_by("spot", "event_id").alias("spot"), F.count("*").alias("n"))


def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles submitted, processed and dropped: counters only grow within a session, so each session's last ones add up."""
    i = F.col("event_id")
    rows = V.ticks(spark, sf_dir).select("session", i.alias("submitted"), F.when(i % 10 != 0, i - F.floor(i / 50)).alias("processed"), F.floor(i / 50).alias("dropped"))
    names = ("submitted", "processed", "dropped")
    last = rows.groupBy("session").agg(*[F.max(c).alias(c) for c in names])
    return last.agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in names])


def queries() -> dict:
    own = (text_scalars, market_books, next_open, chart_bars, history_minutes, symbol_listing, label_counts, label_cache, promotion_journal, rotated_trades, label_provenance, discovery_guard, analysed_tickers, retained_rows, spot_series, queue_counters)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    markets = "WITH " + V.SQL["markets"]
    spots = "WITH " + V.SQL["ticks"] + ", " + V.SQL["spots"]
    statuses = evaluation_sql()["label_status"]
    coin = "CASE p_partkey % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'XRP' END"
    days = ", ".join(f"{d}::DOUBLE" for d in DURATIONS.values())
    stop, up = "CASE WHEN row_id % 2 = 0 THEN round(side_ask * 0.75::DOUBLE, 1) END", "fav = 'UP'"
    return {
        "text_scalars": markets + f""", parsed AS (SELECT *, CASE ticker % 6 WHEN 0 THEN close_us + 250000 WHEN 2 THEN close_us - 7200000000 WHEN 4 THEN NULL WHEN 5 THEN close_us // 86400000000 * 86400000000 ELSE close_us END AS parsed_us FROM markets)
            SELECT ticker, parsed_us, strftime(make_timestamp(parsed_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ticker % 6 = 0 THEN '.250000' ELSE '' END || '+00:00' AS parsed_text,
                hour(timezone('America/New_York', timezone('UTC', make_timestamp(close_us))))::INT AS local_hour, round(coalesce(({AS_OF_US} - parsed_us) / 3600000000.0::DOUBLE, 1e9::DOUBLE), 6) AS age_h,
                ([{days}])[(ticker % 8 + 1)::INT] AS days, (['STALE;NO_BOOK', 'STALE', ''])[(ticker % 3 + 1)::INT] AS flags, ('0x' || substr(sha256('{C.SEED}|' || coin || '|' || ticker), 1, 12))::BIGINT AS seed,
                sha256('{{"close_us":' || close_us || ',"coin":"' || coin || '","ticker":' || ticker || ',"up":' || coalesce(up::VARCHAR, 'null') || '}}') AS canonical_sha256 FROM parsed""",
        "market_books": with_market(body=f"""SELECT ticker, line, strike, yes_bid, yes_ask, no_bid, no_ask, CASE WHEN side_bid IS NULL THEN side_ask WHEN side_ask - side_bid > 1 THEN side_bid + 1 WHEN side_ask IS NOT NULL THEN side_bid END AS limit_price,
                floor(1000 * CASE WHEN coalesce(side_ask, 0) <= 0 THEN 0 ELSE (conf / 100 * (100 - side_ask) - (1 - conf / 100) * (side_ask - coalesce(stop, side_ask * 0.7::DOUBLE))) / side_ask * 100 END + 0.1234::DOUBLE) / 1000 AS margin
            FROM (SELECT *, {stop} AS stop FROM (SELECT *, CASE WHEN {up} THEN yes_bid ELSE no_bid END AS side_bid, CASE WHEN {up} THEN yes_ask ELSE no_ask END AS side_ask FROM (
                SELECT *, coalesce(yes_given, 100 - no_bid) AS yes_ask, coalesce(no_given, 100 - yes_bid) AS no_ask FROM (
                    SELECT ticker, line, fav, row_id, greatest(p, 1 - p) * 100 AS conf, CASE WHEN row_id % 5 <> 0 THEN (30 + row_id % 40)::DOUBLE END AS yes_bid, CASE WHEN row_id % 6 <> 0 THEN (67 - row_id % 40 - row_id % 3)::DOUBLE END AS no_bid,
                        CASE WHEN row_id % 7 <> 0 THEN (31 + row_id % 40 + row_id % 4)::DOUBLE END AS yes_given, CASE WHEN row_id % 3 <> 0 THEN (70 - row_id % 40 + row_id % 2)::DOUBLE END AS no_given,
                        CASE row_id % 3 WHEN 0 THEN f4 WHEN 1 THEN f4 + 1 ELSE CASE WHEN row_id % 11 <> 0 THEN f4 + 2 END END AS strike FROM observations))))"""),
        "next_open": markets + f" SELECT coin, arg_min(ticker, (close_us, ticker)) AS ticker, min(close_us) AS close_us, count(*) AS n_open FROM markets WHERE close_us > {AS_OF_US} GROUP BY coin",
        "chart_bars": spots + """ SELECT coin, t, open, high, low, close FROM (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t DESC) AS place
            FROM (SELECT coin, us // 60000000 * 60 AS t, arg_min(spot, (us, event_id)) AS open, max(spot) AS high, min(spot) AS low, arg_max(spot, (us, event_id)) AS close FROM spots GROUP BY ALL)) WHERE place <= 60""",
        "history_minutes": spots + """, paged AS (SELECT coin, us // 60000000 * 60 AS t, event_id AS seq, spot AS close FROM spots UNION ALL SELECT coin, us // 60000000 * 60, event_id + 1000000000000, spot + 1 FROM spots WHERE event_id % 4 = 0)
            SELECT coin, t, t // 18000 AS page, round(arg_max(close, seq), 6) AS close, count(*) AS versions FROM paged GROUP BY coin, t""",
        "symbol_listing": f"""WITH listed AS (SELECT CASE p_partkey % 3 WHEN 0 THEN {coin} || 'PERP' || p_partkey WHEN 1 THEN 'X' || {coin} || p_partkey ELSE {coin} || 'SPOT' || p_partkey END AS name,
                CASE p_partkey % 3 WHEN 0 THEN {coin} || 'perp' || p_partkey WHEN 1 THEN 'X' || {coin} || p_partkey ELSE {coin} || 'SPOT' || p_partkey END AS symbol, p_size = 50 AND starts_with(p_brand, 'Brand#1') AS active FROM part),
            scored AS (SELECT c.coin, symbol, 4 * starts_with(name, c.coin)::INT + 2 * contains(name, 'PERP')::INT + active::INT AS score FROM (SELECT unnest(['BTC', 'ETH', 'SOL', 'XRP', 'DOGE']) AS coin) c JOIN listed ON contains(name, c.coin)),
            best AS (SELECT coin, count(*) AS candidates, min(symbol) AS symbol FROM scored s WHERE score = (SELECT max(score) FROM scored b WHERE b.coin = s.coin) GROUP BY coin)
            SELECT c.coin, CASE WHEN c.coin = 'SOL' THEN 'SOL-CHOSEN' WHEN candidates = 1 THEN symbol END AS symbol, CASE WHEN c.coin = 'SOL' THEN NULL WHEN candidates IS NULL THEN 'NO_MARKET' WHEN candidates > 1 THEN 'AMBIGUOUS' END AS reason, coalesce(candidates, 0) AS candidates
            FROM (SELECT unnest(['BTC', 'ETH', 'SOL', 'XRP', 'DOGE']) AS coin) c LEFT JOIN best USING (coin)""",
        "label_counts": f"SELECT status, count(*) AS n, count(*) FILTER (status = 'final' AND outcome IN (0, 1)) AS usable, min(close_us) AS first_us FROM ({statuses}) GROUP BY status",
        "label_cache": statuses,
        "promotion_journal": with_market(body="""SELECT CASE WHEN line % 2 = 0 THEN 'm1' ELSE 'm2' END AS promotion, ticker, min(us) AS us, arg_min(row_id, (us, row_id)) AS row_id FROM observations WHERE signal GROUP BY ALL"""),
        "rotated_trades": with_market(CALLS_SQL, body="SELECT ticker, side, CASE WHEN ticker % 2 <> 0 THEN entry END AS entry, CASE WHEN ticker % 2 <> 0 THEN 'current' ELSE 'rotated' END AS layout FROM calls"),
        "label_provenance": markets + """, c AS (SELECT coin, count(*) AS n, count(*) FILTER (ticker % 29 = 0) AS bad_sessions, count(*) FILTER (ticker % 31 = 0 OR ticker % 41 = 0 OR ticker % 37 = 0) AS bad_labels FROM markets GROUP BY coin)
            SELECT *, concat_ws(';', CASE WHEN bad_sessions > 0 THEN 'SESSIONS' END, CASE WHEN bad_labels > 0 THEN 'LABELS' END) AS problems FROM c""",
        "discovery_guard": with_market(SIGNAL_SQL, body=f"""SELECT grp, count(*) FILTER (close_us <= {AS_OF_US}) AS n, count(*) FILTER (close_us > {AS_OF_US}) AS n_later, max(close_us) FILTER (close_us <= {AS_OF_US}) AS last_us
            FROM (SELECT 'ALL' AS grp, close_us FROM signals UNION ALL SELECT coin, close_us FROM signals) GROUP BY grp"""),
        "analysed_tickers": with_market(HORIZON_SQL, SIGNAL_SQL, body="""SELECT coin, count(*) FILTER (h) AS n_horizon, count(*) FILTER (s) AS n_signal, count(*) AS n
            FROM (SELECT coin, ticker, bool_or(h) AS h, bool_or(NOT h) AS s FROM (SELECT coin, ticker, true AS h FROM horizon_rows UNION ALL SELECT coin, ticker, false FROM signals) GROUP BY ALL) GROUP BY coin"""),
        "retained_rows": with_market(HORIZON_SQL, SIGNAL_SQL, body="SELECT ticker, line, coin, us, row_id FROM horizon_rows UNION SELECT ticker, line, coin, us, row_id FROM signals"),
        "spot_series": spots + " SELECT session, coin, us, min(event_id) AS event_id, arg_min(spot, event_id) AS spot, count(*) AS n FROM spots GROUP BY session, coin, us",
        "queue_counters": "WITH " + V.SQL["ticks"] + """ SELECT count(*) AS sessions, sum(s)::BIGINT AS submitted, sum(p)::BIGINT AS processed, sum(d)::BIGINT AS dropped
            FROM (SELECT session, max(event_id) AS s, max(event_id - event_id // 50) FILTER (event_id % 10 <> 0) AS p, max(event_id // 50) AS d FROM ticks GROUP BY session)""",
    }
