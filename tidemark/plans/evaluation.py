"""Queries that judge forecasts: cohorts, metrics, ranks, multiple testing, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.market import favored_win
from tidemark.operators import cohorts
from tidemark.operators import metrics as X
from tidemark.operators import scans
from tidemark.sources import views as V
from tidemark.storage import written

AS_OF = "1998-01-01"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir)


def horizon_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts.horizon_rows(observed(spark, sf_dir))
    return rows.select("ticker", "coin", "horizon", "us", "early_us", "row_id", "up", "p", "fav", "base_logit", favored_win(F.col("up"), F.col("fav")).alias("favored_correct"), F.round(F.col("up") - F.col("p"), 6).alias("base_error"))


def first_signal_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.first_signals(observed(spark, sf_dir)).select("ticker", "coin", "us", "row_id", "up", "p", "fav", "f1", "f2", "f3", "f4")


def ticker_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with a tenth of the lines moved to another close or coin, to show what is excluded."""
    rows = observed(spark, sf_dir).withColumn("coin", F.when((F.col("row_id") % 997 == 0), "BTC").otherwise(F.col("coin")))
    rows = rows.withColumn("close_us", F.col("close_us") + F.when(F.col("row_id") % 991 == 0, V.SECOND).otherwise(0))
    return cohorts.inconsistent_tickers(rows)


def causal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the causal rule that they break; a row here may claim a snapshot from after its spot time."""
    rows = observed(spark, sf_dir).withColumn("snapshot_us", F.col("us") - (F.col("row_id") % 12 - 2) * V.SECOND)
    lag = F.col("us") - F.col("snapshot_us")
    reason = (
        F.when(F.col("us") > F.col("close_us"), "AFTER_CLOSE").when(lag < -1000, "FUTURE_SNAPSHOT").when(lag > C.MAX_LAG * V.SECOND, "PAIR_TOO_OLD")
        .when(F.col("p").isNull(), "NO_PROBABILITY").otherwise("OK")
    )
    return rows.groupBy("coin", reason.alias("reason")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


def label_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label state machine stepped once: cached labels of some markets meet fresh results."""
    m = V.markets(spark, sf_dir)
    k = F.col("ticker")
    cache = m.where(k % 3 == 0).select("ticker", F.when(k % 39 == 0, "ETH").otherwise(F.col("coin")).alias("coin"), "close_us", F.when(k % 2 == 0, 1).otherwise(0).alias("outcome"),
                                       F.when(k % 7 == 0, "conflict").when(k % 5 == 0, "pending").otherwise("final").alias("status"))
    cache = cache.withColumn("outcome", F.when(F.col("status") == "final", F.col("outcome")))
    result = F.when(F.col("up") == 1, " YES ").when(F.col("up") == 0, "no").when(k % 2 == 0, "void")
    results = m.where(k % 2 == 0).select("ticker", "coin", "close_us", result.alias("result"), F.when(k % 22 == 0, "timeout").alias("error"))
    as_of = spark.range(1).select(V.micros(F.lit(AS_OF).cast("timestamp_ntz")).alias("t")).first()[0]
    return cohorts.merge_labels(cache, results, as_of)


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers by coin that are in telemetry, labelled, both, or only in one."""
    seen = observed(spark, sf_dir).select("coin", "ticker").distinct()
    labels = V.markets(spark, sf_dir).where("up IS NOT NULL").select("coin", "ticker")
    both, only, unseen = seen.intersect(labels), seen.subtract(labels), labels.subtract(seen)
    parts = [d.withColumn("kind", F.lit(k)) for d, k in ((both, "labelled"), (only, "unlabelled"), (unseen, "unobserved"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("coin", "kind").agg(F.count("*").alias("n"))


def horizon_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon observations by group: each coin and ALL."""
    rows = cohorts.horizon_rows(observed(spark, sf_dir))
    return rows.withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))


def written_cohort(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of the cohort for queries that go through it several times: a row is written once for all its groups."""
    rows = written(cohorts.horizon_rows(observed(spark, sf_dir)).select("horizon", *dict.fromkeys(["coin", *columns])))
    return rows.withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))


BY = ["grp", "horizon"]


def blocked_cohort(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of the cohort with each row's block of the walk-forward folds."""
    rows = written_cohort(spark, sf_dir, "close_us", *columns)
    return X.blocked(rows, X.fold_cuts(rows.groupBy(*BY, "close_us").agg(F.count("*").alias("n")), "close_us", BY), BY, "close_us")


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p, y = horizon_cohort(spark, sf_dir), F.col("p"), F.col("up")
    base = rows.groupBy(*BY).agg(
        F.count("*").alias("n"), F.sum("up").alias("yes"), F.round(F.avg("up"), 6).alias("yes_rate"), F.round(X.brier(p, y), 6).alias("brier"), F.round(X.logloss(p, y), 6).alias("logloss"),
        F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(favored_win(y, F.col("fav"))), 6).alias("favored_win_rate"), F.round(F.avg("early_us") / 1000, 3).alias("mean_early_ms"),
    )
    more = X.auc(rows, BY).join(X.ece(rows, BY), BY)
    return base.join(more, BY).withColumn("auc", F.round("auc", 6)).withColumn("ece", F.round("ece", 6))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda x: (F.floor(F.col(x) * 1e6 + 0.1234) / 1e6).cast("double").alias(x)  # noqa: E731  off the grid: means of round values tie
    return X.calibration(horizon_cohort(spark, sf_dir), BY).select(*BY, "bin", "n", cut("mean_p"), F.round("rate", 6).alias("rate"))


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = horizon_cohort(spark, sf_dir)
    five = X.ece(rows, BY, bins=5).withColumnRenamed("ece", "ece5")
    return X.ece(rows, BY).join(five, BY).select(*BY, F.round("ece", 6).alias("ece"), F.round("ece5", 6).alias("ece5"))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.auc(horizon_cohort(spark, sf_dir), BY).withColumn("auc", F.round("auc", 6))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each feature with the outcome, and the plain one."""
    rows = horizon_cohort(spark, sf_dir)
    flat = rows.unpivot([*BY, "up"], ["f1", "f2", "f3", "f4"], "feature", "x")
    ranked = X.spearman(flat, [*BY, "feature"], "x", "up")
    plain = flat.groupBy(*BY, "feature").agg(F.round(F.corr("x", "up"), 6).alias("pearson"))
    return ranked.join(plain, [*BY, "feature"]).withColumn("rho", F.round("rho", 6))


def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p-values of the features' correlation with the outcome, corrected within each group and horizon."""
    rows = horizon_cohort(spark, sf_dir).unpivot([*BY, "up"], ["f1", "f2", "f3", "f4"], "feature", "x")
    r, n = F.corr("x", "up"), F.count("*")
    z = F.abs(r) * F.sqrt(n - 3.0)
    tests = rows.groupBy(*BY, "feature").agg(F.when((n > 3) & (F.col("feature") != "f4"), F.round(F.exp(-0.717 * z - 0.416 * z * z), 8)).alias("p_value"))
    return X.bh_qvalues(tests, BY).withColumn("q_value", F.round("q_value", 8))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test sizes of each fold."""
    rows = horizon_cohort(spark, sf_dir)
    blocks = X.walk_forward(rows, "close_us", BY)
    sizes = blocks.groupBy(*BY, "block").agg(F.sum("n").alias("n"), F.min("close_us").alias("from_us"), F.max("close_us").alias("to_us"))
    tests = sizes.where("block > 0").alias("t")
    trains = sizes.alias("r")
    same = (F.col("t.grp") == F.col("r.grp")) & (F.col("t.horizon") == F.col("r.horizon")) & (F.col("r.block") < F.col("t.block"))
    return tests.join(trains, same).groupBy(F.col("t.grp").alias("grp"), F.col("t.horizon").alias("horizon"), F.col("t.block").alias("fold")).agg(
        F.sum("r.n").alias("n_train"), F.first("t.n").alias("n_test"), F.max("r.to_us").alias("train_to_us"), F.first("t.from_us").alias("test_from_us")
    )


def tuning_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts.first_signals(observed(spark, sf_dir)).withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))
    split = X.halves(rows, "close_us", ["grp"])
    return split.groupBy("grp", "half").agg(F.sum("n").alias("n"), F.count("*").alias("closes"), F.min("close_us").alias("from_us"), F.max("close_us").alias("to_us"))


def regime_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by tercile of a feature; the cuts come from the first training block, the metrics from what follows."""
    placed = blocked_cohort(spark, sf_dir, "f4", "p", "up")
    cuts = scans.percentiles(placed.where("block = 0"), BY, ["f4"], (1 / 3, 2 / 3)).select(*BY, F.col("q")[0].alias("c1"), F.col("q")[1].alias("c2"))
    later = placed.where("block > 0").join(cuts, BY)
    name = F.when(F.col("f4") < F.col("c1"), "low").when(F.col("f4") < F.col("c2"), "medium").otherwise("high")
    p, y = F.col("p"), F.col("up")
    return later.groupBy(*BY, name.alias("tercile")).agg(F.count("*").alias("n"), F.round(X.brier(p, y), 6).alias("brier"), F.round(X.logloss(p, y), 6).alias("logloss"))


def regime_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by category; an unknown category counts as UNKNOWN, and every category is listed."""
    rows = horizon_cohort(spark, sf_dir)
    n = F.col("row_id") % 6
    category = F.when(n == 0, "LOW").when(n == 1, "NORMAL").when(n == 2, "HIGH").when(n == 3, "EXTREME").when(n == 4, "odd")
    rows = rows.withColumn("category", F.when(category.isin(*C.REGIMES), category).otherwise("UNKNOWN"))
    p, y = F.col("p"), F.col("up")
    found = rows.groupBy("grp", "category").agg(F.count("*").alias("n"), F.round(F.avg("up"), 6).alias("yes_rate"), F.round(X.brier(p, y), 6).alias("brier"), F.round(X.logloss(p, y), 6).alias("logloss"))
    every = spark.createDataFrame([(g, c) for g in ("ALL", *C.COINS) for c in C.REGIMES], "grp string, category string")
    return every.join(found, ["grp", "category"], "left").fillna(0, ["n"])


def queries() -> dict:
    own = (horizon_observations, first_signal_cohort, ticker_metadata, causal_violations, label_status, label_coverage, baseline_metrics, calibration, ece, auc, spearman, bh_qvalues, walk_forward, tuning_holdout, regime_terciles, regime_categories)
    return {f.__name__: f for f in own}


HORIZON_SQL = """horizon_rows AS (
        SELECT * FROM (SELECT o.*, h AS horizon, close_us - h * 60000000 - us AS early_us, row_number() OVER (PARTITION BY ticker, h ORDER BY us DESC, row_id DESC) AS place
                       FROM observations o, (SELECT unnest([8, 6, 4, 2]) AS h) WHERE up IS NOT NULL AND close_us - h * 60000000 - us BETWEEN 0 AND 10000000) WHERE place = 1)"""
SIGNAL_SQL = """signals AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY us, row_id) AS place FROM observations
                       WHERE up IS NOT NULL AND signal AND (close_us - us) / 60000000 BETWEEN 2 AND 8) WHERE place = 1)"""
GROUPED_SQL = "grouped AS (SELECT 'ALL' AS grp, * FROM horizon_rows UNION ALL SELECT coin, * FROM horizon_rows)"
_P = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))"
BRIER = "round(avg((p - up) * (p - up)), 6)"
LOGLOSS = f"round(avg(-(up * ln({_P}) + (1 - up) * ln(1 - {_P}))), 6)"
_BIN = "least(floor(p * {n}), {m})::INT"


def with_market(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join([V.SQL["markets"], V.SQL["observations"], *ctes]) + " " + body


def _auc(by: str) -> str:
    return f"""auc_values AS (
        SELECT {by}, round(CASE WHEN sum(up) > 0 AND sum(up) < count(*) THEN (sum(rk) FILTER (up = 1) - sum(up) * (sum(up) + 1) / 2) / (sum(up)::DOUBLE * (count(*) - sum(up))) END, 6) AS auc
        FROM (SELECT {by}, up, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS rk FROM grouped) GROUP BY {by})"""


def _ece(name: str, bins: int) -> str:
    slot = _BIN.format(n=bins, m=bins - 1)
    return f"{name} AS (SELECT grp, horizon, round(sum(abs(a - b) * n) / sum(n), 6) AS {name} FROM (SELECT grp, horizon, {slot} AS bin, avg(p) AS a, avg(up) AS b, count(*) AS n FROM grouped GROUP BY ALL) GROUP BY grp, horizon)"


BLOCKS_SQL = """blocks AS (
        SELECT grp, horizon, close_us, n, (before >= round_even(total * 0.40::DOUBLE, 0))::INT + (before >= round_even(total * 0.55::DOUBLE, 0))::INT + (before >= round_even(total * 0.70::DOUBLE, 0))::INT + (before >= round_even(total * 0.85::DOUBLE, 0))::INT AS block
        FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp, horizon ORDER BY close_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY grp, horizon) AS total
              FROM (SELECT grp, horizon, close_us, count(*) AS n FROM grouped GROUP BY ALL)))"""


def oracle_sql() -> dict[str, str]:
    h = (HORIZON_SQL, GROUPED_SQL)
    unpivoted = "flat AS (UNPIVOT (SELECT grp, horizon, up, f1, f2, f3, f4 FROM grouped) ON f1, f2, f3, f4 INTO NAME feature VALUE x)"
    ranks = "rank() OVER (PARTITION BY grp, horizon, feature ORDER BY {v}) + (count(*) OVER (PARTITION BY grp, horizon, feature, {v}) - 1) / 2.0::DOUBLE"
    return {
        "horizon_observations": with_market(HORIZON_SQL, body="SELECT ticker, coin, horizon, us, early_us, row_id, up, p, fav, base_logit, CASE fav WHEN 'UP' THEN up ELSE 1 - up END AS favored_correct, round(up - p, 6) AS base_error FROM horizon_rows"),
        "first_signal_cohort": with_market(SIGNAL_SQL, body="SELECT ticker, coin, us, row_id, up, p, fav, f1, f2, f3, f4 FROM signals"),
        "ticker_metadata": with_market(body="""SELECT ticker, count(DISTINCT c) AS coins, count(DISTINCT k) AS closes, count(*) AS n_rows, min(us) AS first_us, CASE WHEN count(DISTINCT c) > 1 OR count(DISTINCT k) <> 1 THEN 'INCONSISTENT_METADATA' END AS reason
            FROM (SELECT *, CASE WHEN row_id % 997 = 0 THEN 'BTC' ELSE coin END AS c, close_us + CASE WHEN row_id % 991 = 0 THEN 1000000 ELSE 0 END AS k FROM observations) GROUP BY ticker"""),
        "causal_violations": with_market(body="""SELECT coin, CASE WHEN us > close_us THEN 'AFTER_CLOSE' WHEN row_id % 12 - 2 < 0 THEN 'FUTURE_SNAPSHOT' WHEN row_id % 12 - 2 > 8 THEN 'PAIR_TOO_OLD' WHEN p IS NULL THEN 'NO_PROBABILITY' ELSE 'OK' END AS reason,
            count(*) AS n, min(us) AS first_us FROM observations GROUP BY ALL"""),
        "label_status": "WITH " + V.SQL["markets"] + f""", cache AS (SELECT ticker, CASE WHEN ticker % 39 = 0 THEN 'ETH' ELSE coin END AS coin, close_us, status, CASE WHEN status = 'final' THEN CASE WHEN ticker % 2 = 0 THEN 1 ELSE 0 END END AS outcome
                FROM (SELECT *, CASE WHEN ticker % 7 = 0 THEN 'conflict' WHEN ticker % 5 = 0 THEN 'pending' ELSE 'final' END AS status FROM markets WHERE ticker % 3 = 0)),
            results AS (SELECT ticker, coin, close_us, CASE WHEN up = 1 THEN 'yes' WHEN up = 0 THEN 'no' ELSE 'void' END AS result, CASE WHEN up IS NOT NULL THEN up END AS outcome, CASE WHEN ticker % 22 = 0 THEN 'timeout' END AS error FROM markets WHERE ticker % 2 = 0),
            merged AS (SELECT coalesce(c.ticker, r.ticker) AS ticker, coalesce(c.coin, r.coin) AS coin, coalesce(c.close_us, r.close_us) AS close_us, c.outcome AS was, r.outcome AS now,
                CASE WHEN c.coin <> r.coin OR c.close_us <> r.close_us THEN 'metadata_conflict' WHEN c.status = 'conflict' THEN 'conflict'
                     WHEN c.status = 'final' AND r.outcome <> c.outcome THEN 'conflict' WHEN c.status = 'final' THEN 'final'
                     WHEN coalesce(c.close_us, r.close_us) + 90000000 > epoch_us(TIMESTAMP '{AS_OF}') THEN 'pending' WHEN r.error IS NOT NULL THEN 'error'
                     WHEN r.outcome IS NOT NULL THEN 'final' WHEN r.result IS NOT NULL THEN 'unexpected_result' ELSE 'pending' END AS status, c.status AS old
                FROM cache c FULL JOIN results r ON c.ticker = r.ticker)
            SELECT ticker, coin, close_us, CASE WHEN old = 'final' THEN was WHEN status = 'final' THEN now END AS outcome, status FROM merged""",
        "label_coverage": with_market(body="""SELECT coin, kind, count(*) AS n FROM (
            SELECT coin, ticker, CASE WHEN s AND l THEN 'labelled' WHEN s THEN 'unlabelled' ELSE 'unobserved' END AS kind FROM (
              SELECT coin, ticker, bool_or(s) AS s, bool_or(NOT s) AS l FROM (SELECT DISTINCT coin, ticker, true AS s FROM observations UNION ALL SELECT coin, ticker, false FROM markets WHERE up IS NOT NULL) GROUP BY ALL)) GROUP BY ALL"""),
        "baseline_metrics": with_market(*h, _auc("grp, horizon"), _ece("ece", 10), body=f"""SELECT * FROM (SELECT grp, horizon, count(*) AS n, sum(up)::BIGINT AS yes, round(avg(up), 6) AS yes_rate, {BRIER} AS brier, {LOGLOSS} AS logloss,
            round(avg(p), 6) AS mean_p, round(avg(CASE fav WHEN 'UP' THEN up ELSE 1 - up END), 6) AS favored_win_rate, round(avg(early_us) / 1000, 3) AS mean_early_ms FROM grouped GROUP BY ALL) JOIN auc_values USING (grp, horizon) JOIN ece USING (grp, horizon)"""),
        "calibration": with_market(*h, body=f"""SELECT grp, horizon, bin::INT AS bin, count(p) AS n, floor(avg(p) * 1e6::DOUBLE + 0.1234::DOUBLE) / 1e6::DOUBLE AS mean_p, round(avg(up), 6) AS rate
            FROM (SELECT DISTINCT grp, horizon FROM grouped) CROSS JOIN range(10) b(bin) LEFT JOIN (SELECT grp, horizon, p, up, {_BIN.format(n=10, m=9)} AS bin FROM grouped) USING (grp, horizon, bin) GROUP BY ALL"""),
        "ece": with_market(*h, _ece("ece", 10), _ece("ece5", 5), body="SELECT * FROM ece JOIN ece5 USING (grp, horizon)"),
        "auc": with_market(*h, _auc("grp, horizon"), body="SELECT * FROM auc_values"),
        "spearman": with_market(*h, unpivoted, body=f"""SELECT grp, horizon, feature, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN corr(a, b) END, 6) AS rho, round(corr(x, up), 6) AS pearson
            FROM (SELECT *, {ranks.format(v='x')} AS a, {ranks.format(v='up')} AS b FROM flat) GROUP BY ALL"""),
        "bh_qvalues": with_market(*h, unpivoted, body="""SELECT grp, horizon, feature, p_value, round(CASE WHEN p_value IS NOT NULL THEN least(1, min(p_value * m / rk) OVER (PARTITION BY grp, horizon, p_value IS NULL ORDER BY rk DESC)) END, 8) AS q_value
            FROM (SELECT *, row_number() OVER (PARTITION BY grp, horizon, p_value IS NULL ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY grp, horizon, p_value IS NULL) AS m
                  FROM (SELECT grp, horizon, feature, CASE WHEN n > 3 AND feature <> 'f4' THEN round(exp(-0.717::DOUBLE * z - 0.416::DOUBLE * z * z), 8) END AS p_value
                        FROM (SELECT grp, horizon, feature, count(*) AS n, abs(corr(x, up)) * sqrt(count(*) - 3.0) AS z FROM flat GROUP BY ALL)))"""),
        "walk_forward": with_market(*h, BLOCKS_SQL, body="""SELECT t.grp, t.horizon, t.block AS fold, sum(r.n)::BIGINT AS n_train, any_value(t.n)::BIGINT AS n_test, max(r.to_us) AS train_to_us, any_value(t.from_us) AS test_from_us
            FROM (SELECT grp, horizon, block, sum(n) AS n, min(close_us) AS from_us FROM blocks WHERE block > 0 GROUP BY ALL) t
            JOIN (SELECT grp, horizon, block, sum(n) AS n, max(close_us) AS to_us FROM blocks GROUP BY ALL) r ON t.grp = r.grp AND t.horizon = r.horizon AND r.block < t.block GROUP BY ALL"""),
        "tuning_holdout": with_market(SIGNAL_SQL, body="""SELECT grp, CASE WHEN 2 * before < total THEN 'tuning' ELSE 'holdout' END AS half, sum(n)::BIGINT AS n, count(*) AS closes, min(close_us) AS from_us, max(close_us) AS to_us
            FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY close_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY grp) AS total
                  FROM (SELECT grp, close_us, count(*) AS n FROM (SELECT 'ALL' AS grp, close_us FROM signals UNION ALL SELECT coin, close_us FROM signals) GROUP BY ALL)) GROUP BY ALL"""),
        "regime_terciles": with_market(*h, BLOCKS_SQL, body=f"""SELECT grp, horizon, CASE WHEN f4 < c1 THEN 'low' WHEN f4 < c2 THEN 'medium' ELSE 'high' END AS tercile, count(*) AS n, {BRIER} AS brier, {LOGLOSS} AS logloss
            FROM grouped JOIN blocks USING (grp, horizon, close_us) JOIN (SELECT grp, horizon, quantile_cont(f4, 1 / 3.0::DOUBLE) AS c1, quantile_cont(f4, 2 / 3.0::DOUBLE) AS c2 FROM grouped JOIN blocks USING (grp, horizon, close_us) WHERE block = 0 GROUP BY ALL) USING (grp, horizon)
            WHERE block > 0 GROUP BY ALL"""),
        "regime_categories": with_market(*h, body=f"""SELECT grp, category, count(p) AS n, round(avg(up), 6) AS yes_rate, {BRIER} AS brier, {LOGLOSS} AS logloss
            FROM (SELECT unnest(['ALL', 'BTC', 'ETH', 'SOL', 'XRP']) AS grp) CROSS JOIN (SELECT unnest(['LOW', 'NORMAL', 'HIGH', 'EXTREME', 'UNKNOWN']) AS category)
            LEFT JOIN (SELECT *, CASE row_id % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'EXTREME' ELSE 'UNKNOWN' END AS category FROM grouped) USING (grp, category) GROUP BY ALL"""),
    }
