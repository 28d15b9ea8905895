"""Queries about what became of signals: diagnostics, frozen policies in use, overlay preparation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.functions import text as T
from tidemark.operators import cohorts, scans
from tidemark.operators import metrics as X
from tidemark.operators import policy as P
from tidemark.operators import trading as Y
from tidemark.operators.ordered import with_before
from tidemark.plans import policies
from tidemark.plans.evaluation import BLOCKS_SQL, GROUPED_SQL, HORIZON_SQL, SIGNAL_SQL, blocked_cohort, observed, with_market
from tidemark.plans.policies import OVERLAID_SQL, SCORED_SQL, scored
from tidemark.plans.trading import AS_OF_US, HOURLY_SQL, SETTLED_SQL, STEP, hourly, settled
from tidemark.plans.trading import oracle_sql as trading_sql
from tidemark.sources import views as V
from tidemark.storage import written

BY = ["grp", "horizon"]
CUTOFF_US = 788918400 * V.SECOND
RECENT_FROM = 1_706_000_000
SPANS = (2, 6, 24)


def _cut(x: F.Column, digits: int = 6) -> F.Column:
    """Digits cut off the grid on which means of round values tie."""
    return (F.floor(x * 10**digits + 0.1234) / 10**digits).cast("double")


def _cut_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.1234::DOUBLE) / 1e{digits}::DOUBLE"


def _tests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    placed = blocked_cohort(spark, sf_dir, "f4", "p", "up", "fav")
    return placed, placed.where("block > 0").withColumnRenamed("block", "fold")


def residual_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base forecast missed, by fifth of a feature; the bounds of a fold come from the blocks before it."""
    placed, tests = _tests(spark, sf_dir)
    known = placed.where("block < 4").withColumn("fold", F.explode(F.sequence(F.col("block").cast("int") + 1, F.lit(4))))
    bounds = scans.percentiles(known, [*BY, "fold"], ["f4"], (0.2, 0.4, 0.6, 0.8)).select(*BY, "fold", F.col("q").alias("bounds"))
    place = (F.size(F.filter("bounds", lambda b: b <= F.col("f4"))) + 1).alias("quintile")
    return tests.join(bounds, [*BY, "fold"]).groupBy(*BY, place).agg(
        F.count("*").alias("n"), _cut(F.avg("f4"), 3).alias("mean_feature"), _cut(F.avg("p")).alias("mean_p"), _cut(F.avg("up")).alias("up_rate"), _cut(F.avg(F.col("up") - F.col("p"))).alias("mean_residual")
    )


def direction_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a feature with the residual for each favoured side, and whether the sides point apart."""
    _, tests = _tests(spark, sf_dir)
    x, residual = F.col("f4"), F.col("up") - F.col("p")

    def side(name: str) -> list[F.Column]:
        own = F.col("fav") == name
        a, b = F.when(own, x), F.when(own, residual)
        sound = (F.count(a) >= 3) & (F.var_pop(a) > C.ZERO_VARIANCE) & (F.var_pop(b) > C.ZERO_VARIANCE)
        return [F.count(a).alias(f"n_{name.lower()}"), F.when(sound, F.corr(a, b)).alias(f"r_{name.lower()}")]

    both = tests.groupBy(*BY).agg(*side("UP"), *side("DOWN"))
    c = F.col
    apart = (c("n_up") >= 30) & (c("n_down") >= 30) & (F.abs("r_up") > 0.1) & (F.abs("r_down") > 0.1) & (F.signum("r_up") != F.signum("r_down"))
    return both.select(*BY, "n_up", "n_down", F.round("r_up", 6).alias("r_up"), F.round("r_down", 6).alias("r_down"), F.when(apart, "DIRECTION_REVERSAL").alias("flag"))


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible threshold of each group that blocks least; none where no threshold is eligible."""
    rows = policies._by_group(scored(spark, sf_dir).where("conflict IS NOT NULL"))
    judged = P.eligibility(P.threshold_metrics(rows, P.threshold_grid(rows, ["grp"]), ["grp"]))
    eligible = judged.groupBy("grp").agg(F.count_if("eligible").alias("n_eligible"))
    return eligible.join(P.most_conservative(judged, ["grp"]), "grp", "left").select("grp", "n_eligible", "quantile", _cut(F.col("threshold"), 7).alias("threshold"), F.round("block_fraction", 5).alias("block_fraction"))


def conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(policies._by_group(scored(spark, sf_dir).where("conflict IS NOT NULL")))
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    found = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("conflict").alias("mean"), F.stddev_pop("conflict").alias("sd"), F.min("conflict").alias("min"), F.max("conflict").alias("max"))
    found = found.join(scans.percentiles(rows, ["grp"], ["conflict"], at).select("grp", "q"), "grp")
    return found.select("grp", "n", *[_cut(F.col(c)).alias(c) for c in ("mean", "sd", "min", "max")], *[_cut(F.col("q")[i]).alias(f"p{round(x * 100):02d}") for i, x in enumerate(at)])


def group_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay at half strength by coin, side and half, and whether large groups of a kind gain and lose."""
    rows = policies._overlaid(spark, sf_dir).where("alpha = 0.5")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("side", "fav"), ("coin", "coin"), ("half", "half"))])
    y, allow, filled = F.col("up"), F.col("overlay") == "ALLOW", F.col("filled")
    kept = F.sum(F.when(filled & allow, F.col("per_contract")).otherwise(0.0)) / F.nullif(F.count_if(filled), F.lit(0))
    m = rows.withColumn("g", F.explode(kinds)).select("*", "g.*").groupBy("kind", "value").agg(
        F.count("*").alias("n"), (X.brier(F.col("p"), y) - X.brier(F.col("p_i"), y)).alias("gain"), (X.logloss(F.col("p"), y) - X.logloss(F.col("p_i"), y)).alias("logloss_gain"), F.avg((~allow).cast("int")).alias("block_rate"),
        F.avg("win").alias("win_rate"), F.avg(F.when(allow, F.col("win"))).alias("allowed_win_rate"), (kept - F.avg(F.when(filled, F.col("per_contract")))).alias("pc_gain"),
    )
    w = Window.partitionBy("kind")  # a few groups of a kind
    sound = F.col("n") >= 50
    both = F.max(sound & (F.col("gain") >= 0.001)).over(w) & F.max(sound & (F.col("gain") <= -0.001)).over(w)
    shown = {"gain": "brier_gain", **{c: c for c in ("logloss_gain", "block_rate", "win_rate", "allowed_win_rate", "pc_gain")}}
    return m.select("kind", "value", "n", *[_cut(F.col(c)).alias(name) for c, name in shown.items()], F.coalesce(both, F.lit(False)).alias("inconsistent"))


def _shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First signals against the times at which the strategy says it signalled; some of these are off or unknown."""
    rows, k = scored(spark, sf_dir), F.col("ticker")
    expected = cohorts.first_signals(observed(spark, sf_dir)).select("ticker", F.when(k % 11 == 0, F.col("us") + 5000).when(k % 7 == 0, F.col("us") + 800).when(k % 13 != 0, F.col("us")).alias("expected_us"))
    return P.verify_first(rows, expected)


def shadow_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shadowed(spark, sf_dir).select("ticker", "coin", "verified", "decision", "reason", "conflict")


def shadow_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of decisions, the last one, and whether the policy is older than 30 days by then."""
    at = F.struct("us", "ticker")
    d = F.col("decision")
    return _shadowed(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count_if(d == "ALLOW").alias("allow"), F.count_if(d == "WOULD_BLOCK").alias("would_block"), F.count_if(d == "UNAVAILABLE").alias("unavailable"), F.max_by("ticker", at).alias("last_ticker"),
        F.max_by("decision", at).alias("last_decision"), P.is_stale(F.lit(CUTOFF_US), F.max("us"), 30).alias("stale"),
    )


def journal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journalled decisions with their labels and calls: both may be missing, and a call may never have been filled."""
    journal = scored(spark, sf_dir).select("ticker", "coin", "us", "decision")
    labels = V.markets(spark, sf_dir).where("up IS NOT NULL AND ticker % 29 <> 0").select("ticker", F.col("up").alias("label"))
    trades = settled(spark, sf_dir).where("ticker % 10 <> 0").select("ticker", "exit_reason", "win", "per_contract")
    rows = journal.join(labels, "ticker", "left").join(trades, "ticker", "left")
    split = F.when(F.col("exit_reason").isNull(), "UNMATCHED").when((F.col("exit_reason") == "unfilled") | F.col("win").isNull(), "UNFILLED").otherwise("FILLED")
    return rows.select("ticker", "coin", "decision", "label", split.alias("split"), F.when(split == "FILLED", F.col("per_contract")).alias("per_contract"))


def overlay_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which journalled rows an overlay may be judged on, by coin: why rows are left out, fills, and coverage.

    Some rows are repeated, and some have a conflict or a confidence that does not fit their probabilities.
    """
    k = F.col("ticker")
    rows = scored(spark, sf_dir).withColumn("conf", F.greatest("p", 1 - F.col("p")) * 100).withColumn("ask", (45 + F.col("row_id") % 50).cast("double"))
    rows = rows.withColumn("p_b_fav", M.favored(F.col("p_b"), F.col("fav"))).withColumn("p_c_fav", M.favored(F.col("p_c"), F.col("fav")))
    rows = rows.withColumn("conflict", F.when(k % 19 == 0, F.col("conflict") + 0.01).otherwise(F.col("conflict")))
    rows = rows.withColumns({"raw_edge": F.col("conf") - F.col("ask"), "net_edge": F.col("conf") - F.col("ask") - C.ENTRY_COST, "base_conf": F.when(k % 23 == 0, F.col("conf") + 1).otherwise(F.col("conf"))})
    journal = rows.unionByName(rows.where("ticker % 17 = 0").withColumn("us", F.col("us") + V.SECOND))
    labels = V.markets(spark, sf_dir).where("up IS NOT NULL AND ticker % 29 <> 0").select("ticker", F.col("up").alias("label"))
    calls = rows.where("ticker % 10 <> 0").select("ticker", F.when(F.col("filled"), "filled").otherwise("unfilled").alias("fill"))
    judged = P.prepare_overlay(journal.drop("filled", "up", "win"), labels, calls, CUTOFF_US, policies.POLICY.threshold)
    judged = judged.withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))
    why, reached = F.col("reason"), F.col("fill").isNotNull()
    return judged.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.count_if(why == r).alias(r.lower()) for r in P.PREPARED], *[F.count_if(F.col("fill") == f).alias(f) for f in ("filled", "unfilled", "unmatched")],
        F.round(100 * F.count_if(reached) / F.nullif(F.count_if(~why.isin("DUPLICATE", "BEFORE_CUTOFF")), F.lit(0)), 4).alias("coverage_pct"),
    )


def recent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, losses and money of the calls that closed in the last 2, 6 and 24 hours and ever, by coin and by side."""
    groups = ("ALL", *C.COINS, "UP", "DOWN")
    spans = ("all", *(f"h{h}" for h in SPANS))
    rows = settled(spark, sf_dir).where(F.col("win").isNotNull() & (F.col("close_us") <= AS_OF_US))
    age = (F.lit(AS_OF_US) - F.col("close_us")) / (3600.0 * V.SECOND)
    within = F.array_compact(F.array(F.lit("all"), *[F.when(age <= h, f"h{h}") for h in SPANS]))
    rows = rows.withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin", "side"))).withColumn("span", F.explode(within))
    found = rows.groupBy("grp", "span").agg(F.count("*").alias("n"), F.sum("win").alias("w"), F.round(F.sum("pnl"), 1).alias("net"))
    every = spark.createDataFrame([(g, s) for g in groups for s in spans], "grp string, span string")
    full = every.join(found, ["grp", "span"], "left").fillna(0, ["n", "w", "net"])
    return full.select("grp", "span", "n", "w", (F.col("n") - F.col("w")).alias("l"), F.when(F.col("n") > 0, F.bround(100 * F.col("w") / F.col("n"))).otherwise(0.0).alias("pct"), "net")


def backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtested trades by weekday, local hour, confidence band and in the recent past, with what a fixed price would earn."""
    trades = Y.backtest(hourly(spark, sf_dir), STEP).withColumn("at", F.col("open_t") + F.col("elapsed") * STEP)
    band = F.when(F.col("win").isNull() | (F.col("conf") >= 100.1), None).when(F.col("conf") >= 95, "95").when(F.col("conf") >= 90, "90").when(F.col("conf") >= 85, "85").when(F.col("conf") >= 80, "80")
    day = F.pmod(F.floor(F.col("at") / 86400) + 3, F.lit(7)).cast("string")
    hour = T.local_hour(F.col("at") * V.SECOND).cast("string")
    recent = F.when(F.col("at") >= RECENT_FROM, F.col("coin"))
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), x.alias("value")) for n, x in (("weekday", day), ("hour", hour), ("band", band), ("recent", recent))])
    rows = trades.withColumn("g", F.explode(F.filter(kinds, lambda g: g["value"].isNotNull()))).select("*", "g.*")
    rate = F.avg("win")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.count("win").alias("n_settled"), _cut(100 * rate, 3).alias("win_pct"), _cut(rate * 10 - (1 - rate) * 90 - C.ENTRY_COST, 3).alias("exp90"), _cut(F.avg("pnl"), 2).alias("mean_pnl"))


def backtest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, Brier score and log loss of settled trades, of all and of the newest 30 % (all, if there are 40 or fewer)."""
    trades = Y.backtest(hourly(spark, sf_dir), STEP).where("win IS NOT NULL").withColumn("at", F.col("open_t") + F.col("elapsed") * STEP).withColumn("one", F.lit(1))
    ordered = with_before(trades, ["one"], ["at", "coin", "open_t"])
    total = trades.groupBy("one").agg(F.count("*").alias("total"))
    newest = (F.col("total") <= 40) | (F.col("before") >= F.floor(F.col("total") * 0.7))
    rows = ordered.join(F.broadcast(total), "one").withColumn("part", F.explode(F.array_compact(F.array(F.lit("all"), F.when(newest, "newest")))))
    p, y = F.col("conf") / 100, F.col("win")
    return rows.groupBy("part").agg(F.count("*").alias("n"), _cut(100 * F.avg("win"), 3).alias("accuracy"), _cut(X.brier(p, y), 5).alias("brier"), _cut(X.logloss(p, y), 5).alias("logloss"))


def strike_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the last 16 closes crossed the strike of the market that is open."""
    size = 15 * STEP
    rows = hourly(spark, sf_dir).select("coin", "t", "close", (F.floor(F.col("t") / size) * size).alias("open_t"))
    strikes = rows.where("t = open_t").select("coin", "open_t", F.col("close").alias("strike"))
    counted = Y.recent_crossings(rows.join(strikes, ["coin", "open_t"], "left"), "coin", "t")
    return counted.where("strike IS NOT NULL").select("coin", "t", "open_t", "strike", "crossings")


def queries() -> dict:
    own = (residual_quintiles, direction_symmetry, threshold_choice, conflict_summary, group_diagnostics, shadow_signals, shadow_health, journal_outcomes, overlay_preparation, recent_report, backtest_report, backtest_validation, strike_crossings)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    h = (HORIZON_SQL, GROUPED_SQL, BLOCKS_SQL)
    base = "WITH " + ", ".join([V.SQL["markets"], V.SQL["observations"], SIGNAL_SQL, SCORED_SQL])
    grouped = ", conflicts AS (SELECT 'ALL' AS grp, * FROM scored WHERE conflict IS NOT NULL UNION ALL SELECT coin, * FROM scored WHERE conflict IS NOT NULL)"
    r = lambda f: f"CASE WHEN count(*) FILTER (fav = '{f}') >= 3 AND var_pop(f4) FILTER (fav = '{f}') > 1e-12 AND var_pop(up - p) FILTER (fav = '{f}') > 1e-12 THEN corr(f4, up - p) FILTER (fav = '{f}') END"
    shadowed = """, shadowed AS (SELECT * REPLACE (CASE WHEN verified = false THEN 'UNAVAILABLE' ELSE decision END AS decision, CASE WHEN verified = false THEN 'FIRST_SIGNAL_MISSED' ELSE reason END AS reason, CASE WHEN coalesce(verified, true) THEN conflict END AS conflict)
        FROM (SELECT *, CASE WHEN ticker % 11 = 0 THEN false WHEN ticker % 7 = 0 THEN true WHEN ticker % 13 <> 0 THEN true END AS verified FROM scored))"""
    prepared = f""", judged AS (SELECT s.*, CASE WHEN again THEN 'DUPLICATE' WHEN us <= {CUTOFF_US} THEN 'BEFORE_CUTOFF' WHEN decision = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN ticker % 19 = 0 THEN 'PROBABILITY_MISMATCH' WHEN ticker % 23 = 0 THEN 'EDGE_MISMATCH'
            WHEN decision = 'WOULD_BLOCK' THEN 'WOULD_BLOCK' WHEN ticker % 29 = 0 THEN 'UNSETTLED' ELSE 'READY' END AS why
            FROM (SELECT *, false AS again FROM scored UNION ALL SELECT *, true FROM scored WHERE ticker % 17 = 0) s),
        fills AS (SELECT *, CASE WHEN why IN ('WOULD_BLOCK', 'UNSETTLED', 'READY') THEN CASE WHEN ticker % 10 = 0 THEN 'unmatched' WHEN filled THEN 'filled' ELSE 'unfilled' END END AS fill FROM judged)"""
    trades = trading_sql()["backtest_trades"]
    expected = _cut_sql("avg(win) * 10 - (1 - avg(win)) * 90 - 2", 3)
    p = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, conf / 100))"
    market = "WITH " + ", ".join([V.SQL["ticks"], V.SQL["spots"], HOURLY_SQL])
    return {
        "residual_quintiles": with_market(*h, body=f"""SELECT grp, horizon, quintile, count(*) AS n, {_cut_sql('avg(f4)', 3)} AS mean_feature, {_cut_sql('avg(p)')} AS mean_p, {_cut_sql('avg(up)')} AS up_rate, {_cut_sql('avg(up - p)')} AS mean_residual
            FROM (SELECT g.*, 1 + len(list_filter(bounds, lambda b: b <= f4))::INT AS quintile FROM (SELECT * FROM grouped JOIN blocks USING (grp, horizon, close_us)) g
                JOIN (SELECT grp, horizon, fold, quantile_cont(f4, [0.2, 0.4, 0.6, 0.8]) AS bounds FROM grouped JOIN blocks USING (grp, horizon, close_us), (SELECT unnest([1, 2, 3, 4]) AS fold) WHERE block < fold GROUP BY ALL) b
                ON g.grp = b.grp AND g.horizon = b.horizon AND g.block = b.fold) GROUP BY ALL"""),
        "direction_symmetry": with_market(*h, body=f"""SELECT grp, horizon, n_up, n_down, round(a, 6) AS r_up, round(b, 6) AS r_down, CASE WHEN n_up >= 30 AND n_down >= 30 AND abs(a) > 0.1 AND abs(b) > 0.1 AND sign(a) <> sign(b) THEN 'DIRECTION_REVERSAL' END AS flag
            FROM (SELECT grp, horizon, count(*) FILTER (fav = 'UP') AS n_up, count(*) FILTER (fav = 'DOWN') AS n_down, {r('UP')} AS a, {r('DOWN')} AS b FROM grouped JOIN blocks USING (grp, horizon, close_us) WHERE block > 0 GROUP BY ALL)"""),
        "threshold_choice": f"""WITH m AS ({policies.oracle_sql()['threshold_metrics']})
            SELECT grp, count(*) FILTER (eligible) AS n_eligible, arg_min(quantile, (block_fraction, quantile)) FILTER (eligible) AS quantile, arg_min(threshold, (block_fraction, quantile)) FILTER (eligible) AS threshold, min(block_fraction) FILTER (eligible) AS block_fraction FROM m GROUP BY grp""",
        "conflict_summary": base + grouped + f""" SELECT grp, count(*) AS n, {_cut_sql('avg(conflict)')} AS mean, {_cut_sql('stddev_pop(conflict)')} AS sd, {_cut_sql('min(conflict)')} AS min, {_cut_sql('max(conflict)')} AS max,
            {", ".join(f"{_cut_sql(f'quantile_cont(conflict, {q})')} AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM conflicts GROUP BY grp""",
        "group_diagnostics": base + f""", {OVERLAID_SQL}, kinds AS (SELECT o.*, k.kind, CASE k.kind WHEN 'side' THEN fav WHEN 'coin' THEN coin ELSE half END AS value FROM overlaid o, (SELECT unnest(['side', 'coin', 'half']) AS kind) k WHERE alpha = 0.5),
            m AS (SELECT kind, value, count(*) AS n, avg((p - up) ** 2) - avg((p_i - up) ** 2) AS g, avg(-(up * ln(p) + (1 - up) * ln(1 - p))) - avg(-(up * ln(p_i) + (1 - up) * ln(1 - p_i))) AS ll, avg((overlay <> 'ALLOW')::INT) AS blocked, avg(win) AS wr,
                avg(win) FILTER (overlay = 'ALLOW') AS awr, sum(CASE WHEN filled AND overlay = 'ALLOW' THEN per_contract ELSE 0 END) / count(*) FILTER (filled) - avg(per_contract) FILTER (filled) AS pc FROM kinds GROUP BY ALL)
            SELECT kind, value, n, {_cut_sql('g')} AS brier_gain, {_cut_sql('ll')} AS logloss_gain, {_cut_sql('blocked')} AS block_rate, {_cut_sql('wr')} AS win_rate, {_cut_sql('awr')} AS allowed_win_rate, {_cut_sql('pc')} AS pc_gain,
                bool_or(n >= 50 AND g >= 0.001) OVER (PARTITION BY kind) AND bool_or(n >= 50 AND g <= -0.001) OVER (PARTITION BY kind) AS inconsistent FROM m""",
        "shadow_signals": base + shadowed + " SELECT ticker, coin, verified, decision, reason, conflict FROM shadowed",
        "shadow_health": base + shadowed + f""" SELECT count(*) AS rows, count(*) FILTER (decision = 'ALLOW') AS allow, count(*) FILTER (decision = 'WOULD_BLOCK') AS would_block, count(*) FILTER (decision = 'UNAVAILABLE') AS unavailable,
            arg_max(ticker, (us, ticker)) AS last_ticker, arg_max(decision, (us, ticker)) AS last_decision, max(us) - {CUTOFF_US} > 30 * 86400000000 AS stale FROM shadowed""",
        "journal_outcomes": base + ", " + SETTLED_SQL + """ SELECT s.ticker, s.coin, s.decision, CASE WHEN s.ticker % 29 <> 0 THEN s.up END AS label, CASE WHEN d.ticker IS NULL THEN 'UNMATCHED' WHEN d.win IS NULL THEN 'UNFILLED' ELSE 'FILLED' END AS split,
            CASE WHEN d.win IS NOT NULL THEN d.per_contract END AS per_contract FROM scored s LEFT JOIN done d ON d.ticker = s.ticker AND s.ticker % 10 <> 0""",
        "overlay_preparation": base + prepared + f""" SELECT grp, count(*) AS n, {", ".join(f"count(*) FILTER (why = '{x}') AS {x.lower()}" for x in P.PREPARED)}, {", ".join(f"count(*) FILTER (fill = '{x}') AS {x}" for x in ("filled", "unfilled", "unmatched"))},
            round(100 * count(fill) / nullif(count(*) FILTER (why NOT IN ('DUPLICATE', 'BEFORE_CUTOFF')), 0), 4) AS coverage_pct FROM (SELECT 'ALL' AS grp, why, fill FROM fills UNION ALL SELECT coin, why, fill FROM fills) GROUP BY grp""",
        "recent_report": "WITH " + V.SQL["markets"] + ", " + V.SQL["observations"] + ", " + SETTLED_SQL + f""", played AS (SELECT *, ({AS_OF_US} - close_us) / 3600000000.0::DOUBLE AS age FROM done WHERE win IS NOT NULL AND close_us <= {AS_OF_US}),
            found AS (SELECT grp, span, count(*) AS n, sum(win)::BIGINT AS w, round(sum(pnl), 1) AS net FROM (SELECT unnest(['ALL', coin, side]) AS grp, win, pnl, age FROM played), (SELECT unnest(['all', 'h2', 'h6', 'h24']) AS span, unnest([1e9::DOUBLE, 2, 6, 24]) AS hours) WHERE age <= hours GROUP BY ALL)
            SELECT g.grp, s.span, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(n - w, 0) AS l, coalesce(round_even(100 * w / n, 0), 0) AS pct, coalesce(net, 0) AS net
            FROM (SELECT unnest(['ALL', 'BTC', 'ETH', 'SOL', 'XRP', 'UP', 'DOWN']) AS grp) g CROSS JOIN (SELECT unnest(['all', 'h2', 'h6', 'h24']) AS span) s LEFT JOIN found USING (grp, span)""",
        "backtest_report": f"""WITH placed_at AS (SELECT *, open_t + elapsed * {STEP} AS at_s FROM ({trades})), kinds AS (
              SELECT *, 'weekday' AS kind, ((at_s // 86400 + 3) % 7)::VARCHAR AS value FROM placed_at
              UNION ALL SELECT *, 'hour', hour(timezone('America/New_York', timezone('UTC', make_timestamp(at_s * 1000000))))::VARCHAR FROM placed_at
              UNION ALL SELECT *, 'band', CASE WHEN conf >= 95 THEN '95' WHEN conf >= 90 THEN '90' WHEN conf >= 85 THEN '85' ELSE '80' END FROM placed_at WHERE win IS NOT NULL AND conf < 100.1
              UNION ALL SELECT *, 'recent', coin FROM placed_at WHERE at_s >= {RECENT_FROM})
            SELECT kind, value, count(*) AS n, count(win) AS n_settled, {_cut_sql('100 * avg(win)', 3)} AS win_pct, {expected} AS exp90, {_cut_sql('avg(pnl)', 2)} AS mean_pnl FROM kinds GROUP BY ALL""",
        "backtest_validation": f"""WITH ranked AS (SELECT *, row_number() OVER (ORDER BY open_t + elapsed * {STEP}, coin, open_t) - 1 AS before, count(*) OVER () AS total FROM ({trades}) WHERE win IS NOT NULL),
            parts AS (SELECT *, 'all' AS part FROM ranked UNION ALL SELECT *, 'newest' FROM ranked WHERE total <= 40 OR before >= floor(total * 0.7::DOUBLE))
            SELECT part, count(*) AS n, {_cut_sql('100 * avg(win)', 3)} AS accuracy, {_cut_sql('avg((conf / 100 - win) ** 2)', 5)} AS brier, {_cut_sql(f'avg(-(win * ln({p}) + (1 - win) * ln(1 - {p})))', 5)} AS logloss FROM parts GROUP BY part""",
        "strike_crossings": market + f""", lists AS (SELECT coin, t, t // {15 * STEP} * {15 * STEP} AS open_t, list(close) OVER (PARTITION BY coin ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS a FROM hourly)
            SELECT l.coin, l.t, l.open_t, s.close AS strike, len(list_filter(range(2, len(a) + 1), lambda i: (a[i] > s.close AND a[i - 1] <= s.close) OR (a[i] < s.close AND a[i - 1] >= s.close)))::INT AS crossings FROM lists l JOIN hourly s ON s.coin = l.coin AND s.t = l.open_t""",
    }
