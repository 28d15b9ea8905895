"""From screened features to frozen policies: out-of-fold conflicts, judged thresholds, the final fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.operators import metrics as X
from tidemark.operators import models as Z
from tidemark.operators import policy as P
from tidemark.storage import written


def oof_conflicts(rows: DataFrame, by: list[str], control: str, feature: str, reliability: Column) -> DataFrame:
    """Test rows of the walk-forward folds with the favoured side's probability by models B and C, and their difference.

    A row stands at most once for each group.  Rows without a favoured side, and folds without enough training rows, are
    left out.
    """
    predicted, _ = Z.out_of_fold(Z.placed(rows, by, [control, feature], reliability))
    known = rows.where(F.col("fav").isin("UP", "DOWN")).select(*by, "ticker", "coin", "fav", "up", F.col(feature).alias("feature_value"))
    p_b, p_c = M.favored(F.col("pb"), F.col("fav")), M.favored(F.col("pc"), F.col("fav"))
    return predicted.select(*by, "fold", "ticker", "pb", "pc").join(known, [*by, "ticker"]).select(
        *by, "fold", "ticker", "coin", "fav", "up", M.favored_win(F.col("up"), F.col("fav")).alias("win"), "feature_value", p_b.alias("p_b_fav"), p_c.alias("p_c_fav"), (p_c - p_b).alias("conflict")
    )


def evaluate_thresholds(rows: DataFrame, by: list[str], cluster: str = "ticker", reps: int = C.THRESHOLD_REPS, seed: int = C.SEED + 2) -> DataFrame:
    """Each threshold of the grid with its metrics, intervals over resampled clusters, p- and q-value, and what is against it.

    ``ci_low`` and ``ci_high`` bound the loss enrichment, ``kept_low`` and ``kept_high`` the kept win rate less the overall
    one; a replicate in which a side is empty counts as 0.  q-values are corrected over the thresholds of a group.
    """
    grid, at, c = written(P.threshold_grid(rows, by)), [*by, "quantile"], F.col
    blocked, lost, won = c("conflict") <= c("threshold"), c("win") == 0, c("win") == 1
    counts = {"nb": blocked, "lb": blocked & lost, "nk": ~blocked, "lk": ~blocked & lost, "wk": ~blocked & won, "w": won, "n": F.lit(True)}
    # a few thresholds for each group
    per = Z.by_cluster(rows, cluster).join(F.broadcast(grid), by).groupBy(*at, cluster).agg(*(F.count_if(x).alias(k) for k, x in counts.items()))
    sums = Z.resampled(per, at, cluster, list(counts), seed, reps)
    enrichment = F.when((c("nb") > 0) & (c("nk") > 0), 100 * (c("lb") / c("nb") - c("lk") / c("nk"))).otherwise(0.0)
    kept = F.when(c("nk") > 0, c("wk") / c("nk") - c("w") / c("n")).otherwise(0.0)
    stats = sums.withColumns({"e": enrichment, "k": kept}).groupBy(*at)
    ends = stats.agg(
        F.percentile("e", 0.025).alias("ci_low"), F.percentile("e", 0.975).alias("ci_high"), F.percentile("k", 0.025).alias("kept_low"), F.percentile("k", 0.975).alias("kept_high"),
        ((F.count_if(c("e") <= 0) + 1) / (F.count("*") + 1.0)).alias("p_value"),
    )
    return P.eligibility(X.bh_qvalues(P.threshold_metrics(rows, grid, by).join(ends, at), by), resampled=True)


def final_fit(rows: DataFrame, name: str, feature: str, controls: Sequence[str], threshold: float, reliability: bool, cutoff_us: int, group: str = "ALL") -> P.Policy:
    """The policy fitted to all complete rows that close by the cutoff; raises ``Singular`` where a model has no fit.

    The group ALL is scaled within each coin; coins with too few rows or a column without variance are left out, and the
    policy cannot score them.  To the driver come one row of scalers for each coin and the fit's sums.
    """
    need = [*controls, feature]
    rows = rows.where(F.col("close_us") <= cutoff_us).where(" AND ".join(f"{c} IS NOT NULL" for c in [*need, "base_logit", "up"]))
    by_coin = group == "ALL"
    rows = rows.withColumn("scope", F.col("coin") if by_coin else F.lit("*"))
    if not by_coin:
        rows = rows.where(F.col("coin") == group)
    scalers = Z.fit_scalers(rows, ["scope"], need, C.MIN_COIN_ROWS if by_coin else 1)
    found = {r["scope"]: {c: tuple(float(r[f"s_{c}"][k]) for k in ("low", "high", "mean", "sd")) for c in need} for r in scalers.collect()}
    if not found:
        raise Z.Singular("no scalers")
    z = {f"z{i}": Z.standardized(c) for i, c in enumerate(need)}
    design = rows.join(F.broadcast(scalers), "scope").select(F.lit(name).alias("policy"), F.col("up").cast("double").alias("y"), "base_logit", *(x.alias(k) for k, x in z.items()))
    design = design.withColumn("product", F.col(f"z{len(controls)}") * F.col("base_logit"))
    b = ["base_logit", *list(z)[:-1]]
    fits = Z.logistic_fits(written(design), ["policy"], {"b": b, "c": [*b, list(z)[-1], *(["product"] if reliability else [])]})
    if not fits:
        raise Z.Singular("no fit")
    beta = fits[name,]
    shared = {} if by_coin else found["*"]
    return P.Policy(name, feature, list(controls), shared, beta["b"].tolist(), beta["c"].tolist(), threshold, group, reliability, coin_scalers=found if by_coin else {})
