"""Queries on the way from a screened feature to a frozen policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import cohorts, freezing
from tidemark.operators import policy as P
from tidemark.plans import policies
from tidemark.plans.evaluation import SIGNAL_SQL, observed
from tidemark.plans.modeling import RELIABILITY, poisson_sql
from tidemark.sources import views as V
from tidemark.storage import written

FEATURES = ("f1", "f2", "f4")
CONTROL = "f3"
#: Policies are fitted to markets that close by then: the first of January 1999.
DISCOVERY_US = 915_148_800 * V.SECOND


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.first_signals(observed(spark, sf_dir)).where("up IS NOT NULL")


def oof_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold conflicts of the first signals that close by the cutoff, by group and feature."""
    rows = _signals(spark, sf_dir).where(F.col("close_us") <= DISCOVERY_US).withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))
    rows = written(rows.unpivot(["grp", "ticker", "coin", "fav", "close_us", "up", "base_logit", CONTROL], list(FEATURES), "feature", "x"))
    return freezing.oof_conflicts(rows, ["grp", "feature"], CONTROL, "x", F.col("feature").isin(*RELIABILITY))


def threshold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold of the grid, with intervals and corrected p-values, and what is against it."""
    rows = written(policies.scored(spark, sf_dir).where("conflict IS NOT NULL").withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin"))))
    found = freezing.evaluate_thresholds(rows, ["grp"])
    rounded = {"block_fraction": 5, "enrichment_pp": 5, "ci_low": 5, "ci_high": 5, "kept_low": 6, "kept_high": 6, "p_value": 6, "q_value": 6}
    return found.select("grp", "quantile", "n", "n_blocked", "n_kept", *(F.round(c, d).alias(c) for c, d in rounded.items()), "ineligible", "eligible")


def prospective_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy fitted to the first signals that close by the cutoff, applied to those after it."""
    rows = written(_signals(spark, sf_dir))
    policy = freezing.final_fit(rows, "frozen", "f1", ["f2", CONTROL], policies.POLICY.threshold, True, DISCOVERY_US)
    later = rows.where(F.col("close_us") > DISCOVERY_US).withColumn("ready", F.lit(True))
    return P.score(later, policy).select("ticker", "coin", "fav", "decision", "reason", *(F.round(c, 6).alias(c) for c in ("p_b", "p_c", "conflict")))


def queries() -> dict:
    return {f.__name__: f for f in (oof_conflicts, threshold_evaluation, prospective_scores)}


def oracle_sql() -> dict[str, str]:
    base = "WITH " + ", ".join([V.SQL["markets"], V.SQL["observations"], SIGNAL_SQL, policies.SCORED_SQL, policies._GROUPED, policies._GRID])
    counts = {"nb": "conflict <= threshold", "lb": "conflict <= threshold AND win = 0", "nk": "conflict > threshold", "lk": "conflict > threshold AND win = 0", "wk": "conflict > threshold AND win = 1", "w": "win = 1", "n": "true"}
    return {
        "threshold_evaluation": base + f""", per AS (SELECT grp, quantile, ticker, {", ".join(f"count(*) FILTER ({x}) AS c_{k}" for k, x in counts.items())} FROM grouped JOIN grid USING (grp) GROUP BY ALL),
            weights AS (SELECT grp, ticker, rep, {poisson_sql(C.SEED + 2, 'ticker', 'rep')} AS weight FROM (SELECT DISTINCT grp, ticker FROM per), range(1, {C.THRESHOLD_REPS + 1}) r(rep)),
            drawn AS (SELECT grp, quantile, rep, {", ".join(f"sum(weight * c_{k})::DOUBLE AS {k}" for k in counts)} FROM per JOIN weights USING (grp, ticker) GROUP BY ALL),
            stats AS (SELECT *, CASE WHEN nb > 0 AND nk > 0 THEN 100 * (lb / nb - lk / nk) ELSE 0 END AS e, CASE WHEN nk > 0 THEN wk / nk - w / n ELSE 0 END AS k FROM drawn),
            ends AS (SELECT grp, quantile, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, quantile_cont(k, 0.025) AS klo, quantile_cont(k, 0.975) AS khi, (count(*) FILTER (e <= 0) + 1) / (count(*) + 1.0::DOUBLE) AS pv FROM stats GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pv) AS rk, count(*) OVER (PARTITION BY grp) AS m FROM ends),
            judged AS (SELECT *, least(1.0::DOUBLE, min(pv * m / rk) OVER (PARTITION BY grp ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS qv FROM ranked),
            both_ AS (SELECT t.* EXCLUDE (ineligible), j.*  EXCLUDE (grp, quantile), concat_ws(';', nullif(regexp_replace(t.ineligible, ';?KEPT_WORSE$', ''), ''), CASE WHEN lo <= 0 THEN 'INTERVAL_INCLUDES_0' END, CASE WHEN qv > 0.05 THEN 'Q_VALUE' END,
                CASE WHEN t.ineligible LIKE '%KEPT_WORSE' THEN 'KEPT_WORSE' END) AS why FROM ({policies.oracle_sql()['threshold_metrics']}) t JOIN judged j USING (grp, quantile))
            SELECT grp, quantile, n, n_blocked, n_kept, block_fraction, enrichment_pp, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, round(klo, 6) AS kept_low, round(khi, 6) AS kept_high, round(pv, 6) AS p_value, round(qv, 6) AS q_value, why AS ineligible, why = '' AS eligible FROM both_""",
    }
