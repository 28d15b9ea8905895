"""Queries that fit models: feature and interaction screens, lead/lag, bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import cohorts
from tidemark.operators import metrics as X
from tidemark.operators import models as Z
from tidemark.operators.features import lead_features, ready_rows
from tidemark.plans.evaluation import GROUPED_SQL, HORIZON_SQL, SIGNAL_SQL, horizon_cohort, with_market, written_cohort
from tidemark.plans import sql_features as S
from tidemark.plans.policies import SCORED_SQL, scored
from tidemark.plans.telemetry import inputs
from tidemark.sources import views as V
from tidemark.storage import written

BY = ["grp", "horizon"]
FEATURES = ("f1", "f2", "f4")
RELIABILITY = ("f2",)


def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the base forecast and a control, by group and horizon, with statuses."""
    rows = written_cohort(spark, sf_dir, "ticker", "coin", "close_us", "up", "base_logit", "f3", *FEATURES)
    rows = rows.unpivot([*BY, "ticker", "coin", "close_us", "up", "base_logit", "f3"], list(FEATURES), "feature", "x")
    return Z.classify(Z.screen(rows, [*BY, "feature"], "f3", "x", F.col("feature").isin(*RELIABILITY)), BY)


def interaction_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the product of a feature and a modifier adds to both and to control x modifier, for the pairs laid down beforehand."""
    rows = written_cohort(spark, sf_dir, "ticker", "coin", "close_us", "up", "base_logit", "f1", "f2", "f3", "f4").withColumnRenamed("f4", "modifier")
    rows = rows.unpivot([*BY, "ticker", "coin", "close_us", "up", "base_logit", "f3", "modifier"], ["f1", "f2"], "feature", "x")
    return Z.classify(Z.screen_interaction(rows, [*BY, "feature"], "f3", "x", "modifier"), BY)


def leadlag_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinned anchors of all horizons; of a feature row they need the spot and whether it is ready."""
    spots, snapshots, scale = inputs(spark, sf_dir)
    out = cohorts.leadlag_anchors(written(ready_rows(spots, snapshots, scale)), C.LEADLAG_HORIZONS, scale)
    return out.select("horizon", "session", "coin", "us", "event_id", "label_us", F.round("y", 4).alias("y"))


def leadlag_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the past spot return in forecasting the future one, by group, horizon and feature.

    Features are worked out for the anchors only.  Each result stands in the output, with null figures where there is too little data.
    """
    spots, snapshots, scale = inputs(spark, sf_dir)
    anchors = written(cohorts.leadlag_anchors(written(ready_rows(spots, snapshots, scale)), C.LEADLAG_HORIZONS, scale))
    known = lead_features(anchors.select("event_id", "snapshot_id").distinct(), spots, snapshots, scale)
    return leadlag_screen(written(anchors.drop("snapshot_id").join(known, "event_id")), scale)


def leadlag_screen(anchors: DataFrame, scale: int, least: int = 300, least_folds: int = 3, q_max: float = 0.05, sign_pct: float = 75) -> DataFrame:
    """Out-of-fold errors and R2 of both models, the gain's interval, p- and q-value, sign consistency and status.

    Training rows whose label reaches into the test period are left out.  Clusters are the coins' market periods.
    """
    by = ["grp", "horizon", "feature"]
    keys = [*by, "fold"]
    control = F.coalesce(*[F.when(F.col("horizon") == h, F.col(c)) for h, c in C.LEADLAG_CONTROL.items()])
    coin = sum((F.when(F.col("coin") == c, i).otherwise(0) for i, c in enumerate(C.COINS)), F.lit(0))
    period = F.floor(F.col("us") / (C.MARKET_SECONDS * scale * V.SECOND)).cast("long") * len(C.COINS) + coin
    rows = anchors.withColumns({"grp": F.explode(F.array(F.lit("ALL"), "coin")), "control": control, "ticker": period})
    rows = rows.unpivot(["grp", "horizon", "ticker", "coin", "us", "label_us", "y", "control"], list(C.LEADLAG_FEATURES), "feature", "x")
    rows = written(rows.where("control IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n_anchors"))
    enough = counts.where(F.col("n_anchors") >= max(least, C.MIN_TRAIN + C.MIN_TEST)).select(*by)
    folds = written(Z.fold_rows(rows.join(F.broadcast(enough), by, "left_semi"), by, "us"))
    begins = folds.where("is_test").groupBy(*keys).agg(F.min("us").alias("begins"))
    folds = folds.join(begins, keys).where("is_test OR label_us < begins")
    scalers = Z.fit_scalers(folds.where(~F.col("is_test")), [*keys, "coin"], ["control", "x"])
    design = written(folds.join(scalers, [*keys, "coin"]).select(*keys, "is_test", "ticker", "y", Z.standardized("control").alias("zc"), Z.standardized("x").alias("zf")))
    sizes = design.groupBy(*keys).agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"), F.avg(F.when(~F.col("is_test"), F.col("y"))).alias("ybar"))
    sizes = sizes.where((F.col("train") >= C.MIN_TRAIN) & (F.col("test") >= C.MIN_TEST)).drop("train", "test")
    design = design.join(F.broadcast(sizes), keys)
    models = {"b": ["zc"], "c": ["zc", "zf"]}
    betas = Z.coefficients(design, Z.linear_fits(design.where(~F.col("is_test")), keys, models), keys, list(models))
    e = {m: F.col("y") - Z.linear_of(f"beta_{m}", x) for m, x in models.items()}
    test = design.where("is_test").join(F.broadcast(betas), keys)
    oof = written(test.select(*by, "ticker", e["b"].alias("eb"), e["c"].alias("ec"), (F.col("y") - F.col("ybar")).alias("e0")))
    square = lambda c: F.col(c) * F.col(c)
    r2 = lambda c: (1 - F.try_divide(F.sum(square(c)), F.sum(square("e0"))))
    errors = oof.groupBy(*by).agg(
        F.count("*").alias("oof_n"), F.avg(square("eb")).alias("mse_base"), F.avg(square("ec")).alias("mse_with_feature"), F.avg(F.abs("eb")).alias("mae_base"),
        F.avg(F.abs("ec")).alias("mae_with_feature"), r2("eb").alias("r2_base"), r2("ec").alias("r2_with_feature"),
    )
    boot = Z.cluster_bootstrap(oof.withColumn("gain", square("eb") - square("ec")), by, "ticker", "gain", C.SEED, C.LEADLAG_REPS)
    gamma = F.col("beta_c")[2]
    signs = betas.groupBy(*by).agg(F.count("*").alias("valid_folds"), F.count_if(gamma > C.ZERO_VARIANCE).alias("positive"), F.count_if(gamma < -C.ZERO_VARIANCE).alias("negative"))
    signs = signs.select(*by, "valid_folds", (100 * F.greatest("positive", "negative") / F.col("valid_folds")).alias("sign_pct"))
    spark = anchors.sparkSession
    grid = spark.createDataFrame([(g, h, f) for g in ("ALL", *C.COINS) for h in C.LEADLAG_HORIZONS for f in C.LEADLAG_FEATURES], "grp string, horizon int, feature string")
    out = grid
    for part in (counts, errors, boot.drop("mean"), signs):
        out = out.join(part, by, "left")
    out = X.bh_qvalues(out.fillna(0, ["n_anchors", "valid_folds"]), ["grp", "horizon"])
    gain = F.col("mse_base") - F.col("mse_with_feature")
    found = (gain > 0) & (F.col("ci_low") > 0) & (F.col("q_value") <= q_max) & (F.col("sign_pct") >= sign_pct)
    status = F.when((F.col("n_anchors") < least) | (F.col("valid_folds") < least_folds), "INSUFFICIENT").when(found, "SIGNAL").otherwise("NO_SIGNAL")
    return out.withColumns({"mse_gain": gain, "status": status})


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of the forecast over always saying a half at each horizon, resampled by market."""
    rows = horizon_cohort(spark, sf_dir).withColumn("gain", F.round(0.25 - (F.col("p") - F.col("up")) ** 2, 9))
    out = Z.cluster_bootstrap(rows, BY, "ticker", "gain", C.SEED)
    return out.select(*BY, "clusters", F.round("mean", 6).alias("mean"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), F.round("p_value", 6).alias("p_value"))


def threshold_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss enrichment of what the policy would block, resampled by market; an empty side counts as no enrichment."""
    rows = scored(spark, sf_dir).where("conflict IS NOT NULL").withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))
    blocked, lost = F.col("decision") == "WOULD_BLOCK", F.col("win") == 0
    per = Z.by_cluster(rows, "ticker").groupBy("grp", "ticker").agg(F.count_if(blocked).alias("nb"), F.count_if(blocked & lost).alias("lb"), F.count_if(~blocked).alias("nk"), F.count_if(~blocked & lost).alias("lk"))
    sums = Z.resampled(per, ["grp"], "ticker", ["nb", "lb", "nk", "lk"], C.SEED + 1, Z.REPS)
    e = F.when((F.col("nb") > 0) & (F.col("nk") > 0), 100 * (F.col("lb") / F.col("nb") - F.col("lk") / F.col("nk"))).otherwise(0.0)
    stats = sums.withColumn("e", e)
    return stats.groupBy("grp").agg(F.round(F.percentile("e", 0.025), 5).alias("ci_low"), F.round(F.percentile("e", 0.975), 5).alias("ci_high"), F.round((F.count_if(F.col("e") <= 0) + 1) / (F.count("*") + 1.0), 6).alias("p_value"))


def queries() -> dict:
    return {f.__name__: f for f in (feature_screen, interaction_screen, leadlag_anchors, leadlag_ols, cluster_bootstrap, threshold_bootstrap)}


def poisson_sql(seed: int, cluster: str, rep: str) -> str:
    p, f = Z.PRIME, Z.FACTOR
    h = f"((((({cluster} % 1000003) * 7919 + {rep} * 104729 + {seed}) % {p}) * {f} + {rep} * 16807) % {p})"
    u = f"((({h} * {h} + {cluster} % 65537) % {p}) * {f} % {p} / {p}.0::DOUBLE)"
    cuts, below, term = [], 0.0, 0.36787944117144233
    for k in range(1, 12):
        below += term
        cuts.append(f"({u} >= {below!r}::DOUBLE)::INT")
        term /= k
    return " + ".join(cuts)


def oracle_sql() -> dict[str, str]:
    return {
        "cluster_bootstrap": with_market(HORIZON_SQL, GROUPED_SQL, body=f""", sums AS (SELECT grp, horizon, ticker, sum(round(0.25 - (p - up) ** 2, 9)) AS s, count(*) AS n FROM grouped GROUP BY ALL),
            drawn AS (SELECT *, {poisson_sql(C.SEED, 'ticker', 'rep')} AS w FROM sums, range(1, {Z.REPS + 1}) r(rep)),
            stats AS (SELECT grp, horizon, rep, sum(w * s) / sum(w * n) AS v FROM drawn WHERE w > 0 GROUP BY ALL)
            SELECT grp, horizon, clusters, round(mean, 6) AS mean, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(pv, 6) AS p_value
            FROM (SELECT grp, horizon, count(*) AS clusters, sum(s) / sum(n) AS mean FROM sums GROUP BY ALL)
            JOIN (SELECT grp, horizon, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, (count(*) FILTER (v <= 0) + 1) / (count(*) + 1.0::DOUBLE) AS pv FROM stats GROUP BY ALL) USING (grp, horizon)""").replace(") , sums", "), sums"),
        "leadlag_anchors": S.features(f""", runs AS (
                SELECT *, sum(broken) OVER (PARTITION BY session, coin ORDER BY us, event_id) AS run
                FROM (SELECT event_id, coin, session, us, spot, ready, coalesce(us - lag(us) OVER (PARTITION BY session, coin ORDER BY us, event_id) > {C.LEADLAG_GAP * S.S}, false)::INT AS broken FROM features)),
            met AS (
                SELECT a.*, h, b.us AS label_us, b.spot AS later, row_number() OVER (PARTITION BY h, a.event_id ORDER BY abs(b.us - a.us - h * {S.S}), b.us, b.spot) AS place
                FROM (SELECT *, unnest({list(C.LEADLAG_HORIZONS)})::BIGINT AS h FROM runs WHERE ready) a
                JOIN runs b ON b.session = a.session AND b.coin = a.coin AND b.run = a.run AND b.us BETWEEN a.us + greatest(1, (h - {C.LEADLAG_TOLERANCE}) * {S.S}) AND a.us + (h + {C.LEADLAG_TOLERANCE}) * {S.S}),
            usable AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h, session, coin, us ORDER BY event_id) AS k FROM met WHERE place = 1) WHERE k = 1),
            linked AS MATERIALIZED (SELECT a.h, a.session, a.coin, a.us, b.us AS after FROM usable a ASOF LEFT JOIN usable b ON a.h = b.h AND a.session = b.session AND a.coin = b.coin AND a.us + a.h * {S.S} <= b.us),
            kept AS (SELECT h, session, coin, min(us) AS us FROM usable GROUP BY ALL
                     UNION ALL SELECT l.h, l.session, l.coin, l.after FROM kept k JOIN linked l ON l.h = k.h AND l.session = k.session AND l.coin = k.coin AND l.us = k.us WHERE l.after IS NOT NULL)
            SELECT h::INT AS horizon, session, coin, us, event_id, label_us, round((later / spot - 1) * 10000, 4) AS y FROM usable JOIN kept USING (h, session, coin, us)""").replace("WITH ", "WITH RECURSIVE ", 1).replace(" , runs", ", runs"),
        "threshold_bootstrap": "WITH " + ", ".join([V.SQL["markets"], V.SQL["observations"], SIGNAL_SQL, SCORED_SQL]) + f""", grouped AS (SELECT 'ALL' AS grp, * FROM scored WHERE conflict IS NOT NULL UNION ALL SELECT coin, * FROM scored WHERE conflict IS NOT NULL),
            per AS (SELECT grp, ticker, count(*) FILTER (decision = 'WOULD_BLOCK') AS nb, count(*) FILTER (decision = 'WOULD_BLOCK' AND win = 0) AS lb, count(*) FILTER (decision <> 'WOULD_BLOCK') AS nk, count(*) FILTER (decision <> 'WOULD_BLOCK' AND win = 0) AS lk FROM grouped GROUP BY ALL),
            drawn AS (SELECT *, {poisson_sql(C.SEED + 1, 'ticker', 'rep')} AS w FROM per, range(1, {Z.REPS + 1}) r(rep)),
            stats AS (SELECT grp, rep, CASE WHEN sum(w * nb) > 0 AND sum(w * nk) > 0 THEN 100 * (sum(w * lb) / sum(w * nb) - sum(w * lk) / sum(w * nk)) ELSE 0 END AS e FROM drawn WHERE w > 0 GROUP BY ALL)
            SELECT grp, round(quantile_cont(e, 0.025), 5) AS ci_low, round(quantile_cont(e, 0.975), 5) AS ci_high, round((count(*) FILTER (e <= 0) + 1) / (count(*) + 1.0::DOUBLE), 6) AS p_value FROM stats GROUP BY grp""",
    }
