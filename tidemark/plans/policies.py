"""Queries about frozen policies, overlays, journals and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.operators import cohorts, metrics as X
from tidemark.operators import documents as D
from tidemark.operators import policy as P
from tidemark.operators.groups import each_and_all, overall_and_by, share, with_percentiles
from tidemark.plans.evaluation import BRIER, LOGLOSS, SIGNAL_SQL, observed
from tidemark.sources import views as V
from tidemark.storage import written

#: The policy that the queries score; scalers lie within the features' ranges.
POLICY = P.Policy(
    name="p1", feature="f1", controls=["f2", "f3"],
    scalers={"f1": (0.0, 0.1, 0.05, 0.0316), "f2": (0.0, 0.08, 0.04, 0.0258), "f3": (1.0, 50.0, 25.5, 14.43)},
    beta_b=(0.05, 0.9, 0.1, -0.05), beta_c=(0.04, 0.9, 0.1, -0.05, 0.25, -0.1), threshold=-0.03, reliability=True,
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-signal cohort, scored; some rows are not ready or lack a value."""
    rows = cohorts.first_signals(observed(spark, sf_dir))
    i = F.col("row_id")
    rows = rows.withColumn("ready", i % 37 != 0).withColumn("f1", F.when(i % 41 != 0, F.col("f1"))).withColumn("f2", F.when(i % 43 != 0, F.col("f2")))
    out = P.score(rows, POLICY).withColumn("win", M.favored_win(F.col("up"), F.col("fav")))
    for c in ("p_b", "p_c", "conflict"):
        out = out.withColumn(c, F.round(c, 8))
    pc = F.when(F.col("win") == 1, 10.0).otherwise(-12.0) + F.col("f3") / 10
    return out.withColumn("filled", i % 9 != 0).withColumn("per_contract", F.round(pc, 2)).withColumn("pnl", F.round(pc * F.col("f3"), 2))


def frozen_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("ticker", "coin", "fav", "decision", "reason", "p_b", "p_c", "conflict")


def _cut(x: str) -> F.Column:
    """Seven digits, cut off the grid of values between which a percentile may fall."""
    return (F.floor(F.col(x) * 1e7 + 0.1234) / 1e7).cast("double")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grp", F.explode(F.array(F.lit("ALL"), "coin")))


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_group(scored(spark, sf_dir).where("conflict IS NOT NULL"))
    m = P.eligibility(P.threshold_metrics(rows, P.threshold_grid(rows, ["grp"]), ["grp"]))
    values = ("block_fraction", "baseline_win_rate", "kept_win_rate", "blocked_loss_rate", "kept_loss_rate", "enrichment_pp", "odds_ratio")
    return m.select("grp", "quantile", _cut("threshold").alias("threshold"), "n", "n_blocked", "n_kept", *[F.round(v, 5).alias(v) for v in values], "ineligible", "eligible")


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_group(scored(spark, sf_dir).where("conflict IS NOT NULL"))
    return P.threshold_grid(rows, ["grp"]).withColumn("threshold", _cut("threshold"))


def settlement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk, alw, loss = F.col("decision") == "WOULD_BLOCK", F.col("decision") == "ALLOW", 1 - F.col("win")
    rate = lambda x, when: F.round(F.avg(F.when(when, x)), 6)
    return overall_and_by(scored(spark, sf_dir), "coin", [
        F.count("*").alias("n"), F.count_if(blk).alias("n_blocked"), F.count_if(alw).alias("n_allowed"), F.round(F.avg("win"), 6).alias("baseline_win_rate"), rate(F.col("win"), alw).alias("allowed_win_rate"),
        rate(F.col("win"), blk).alias("blocked_win_rate"), F.round(100 * (F.avg(F.when(blk, loss)) - F.avg(F.when(alw, loss))), 4).alias("enrichment_pp"),
    ])


def pnl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(scored(spark, sf_dir).where("filled"))
    blk, alw, pc = F.col("decision") == "WOULD_BLOCK", F.col("decision") == "ALLOW", F.col("per_contract")
    kept = F.sum(F.when(alw, pc).otherwise(0.0)) / F.count("*")
    found = overall_and_by(rows, "coin", [
        F.count("*").alias("n"), F.count_if(alw).alias("n_allowed"), F.count_if(blk).alias("n_blocked"), F.round(F.sum("pnl"), 2).alias("total"), F.round(F.sum(F.when(alw, F.col("pnl"))), 2).alias("allowed_total"),
        F.round(F.avg(pc), 5).alias("mean_pc"),
        F.round(kept, 5).alias("filtered_mean_pc"), F.round(kept - F.avg(pc), 5).alias("improvement"),
    ])
    wanted = {"median_pc": ("per_contract", 0.5), "allowed_median_pc": ("allowed_pc", 0.5)}
    found = with_percentiles(found, each_and_all(rows.withColumn("allowed_pc", F.when(alw, pc)), "coin"), ["grp"], wanted)
    return found.withColumns({c: F.round(c, 4) for c in wanted})


def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment by side, coin and half of the period, and whether sound groups of one kind point both ways."""
    rows = scored(spark, sf_dir).withColumn("one", F.lit("x"))
    rows = rows.join(X.halves(rows, "close_us", ["one"]).select("close_us", "half"), "close_us")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("side", "fav"), ("coin", "coin"), ("half", "half"))])
    rows = rows.withColumn("g", F.explode(kinds)).select("*", "g.*")
    blk, alw, loss = F.col("decision") == "WOULD_BLOCK", F.col("decision") == "ALLOW", 1 - F.col("win")
    m = rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.count_if(blk).alias("n_blocked"), F.count_if(alw).alias("n_allowed"), (100 * (F.avg(F.when(blk, loss)) - F.avg(F.when(alw, loss)))).alias("e"))
    sound = (F.col("n") >= 30) & (F.col("n_blocked") >= 10) & (F.col("n_allowed") >= 10)
    w = Window.partitionBy("kind")  # a few groups of a kind
    both = F.max(sound & (F.col("e") >= 5)).over(w) & F.max(sound & (F.col("e") <= -5)).over(w)
    return m.select("kind", "value", "n", "n_blocked", "n_allowed", F.round("e", 4).alias("enrichment_pp"), F.coalesce(both, F.lit(False)).alias("inconsistent"))


def block_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict distribution by half against the other, and flags where it has moved."""
    rows = scored(spark, sf_dir).where("conflict IS NOT NULL").withColumn("one", F.lit("x"))
    rows = written(rows.join(X.halves(rows, "close_us", ["one"]).select("close_us", "half"), "close_us"))
    m = rows.groupBy("half").agg(F.count("*").alias("n"), F.avg("conflict").alias("mean"), F.stddev_pop("conflict").alias("sd"), F.avg((F.col("decision") == "WOULD_BLOCK").cast("int")).alias("block_rate"))
    m = written(with_percentiles(m, rows, ["half"], {"p05": ("conflict", 0.05), "p95": ("conflict", 0.95)}))
    t, h = m.where("half = 'tuning'").alias("t"), m.where("half = 'holdout'").alias("h")
    both = t.crossJoin(h)  # one row each
    ratio = F.col("h.block_rate") / F.nullif(F.col("t.block_rate"), F.lit(0.0))
    smd = (F.col("h.mean") - F.col("t.mean")) / F.sqrt((F.col("h.sd") ** 2 + F.col("t.sd") ** 2) / 2)
    return both.select(
        F.col("t.n").alias("n_tuning"), F.col("h.n").alias("n_holdout"), F.round("t.p05", 6).alias("p05_tuning"), F.round("h.p05", 6).alias("p05_holdout"), F.round(ratio, 4).alias("block_ratio"), F.round(smd, 4).alias("smd"),
        ((ratio < 0.5) | (ratio > 2) | (F.abs(smd) > 1)).alias("shifted"),
    )


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored cohort under each alpha of the grid, by half."""
    rows = scored(spark, sf_dir).where("p_c IS NOT NULL").withColumn("one", F.lit("x"))
    rows = rows.join(X.halves(rows, "close_us", ["one"]).select("close_us", "half"), "close_us")
    rows = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, C.ALPHAS)))).withColumn("delta", M.overlay_delta(F.col("p_c"), F.col("p_b")))
    rows = rows.withColumn("p_i", F.round(M.blend(F.col("p"), F.col("delta"), F.col("alpha")), 10)).withColumn("ask", (45 + F.col("row_id") % 50).cast("double"))
    return rows.withColumn("overlay", M.overlay_decision(F.col("p_i"), F.col("fav"), F.col("ask"), F.col("row_id") % 17 != 0))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaid(spark, sf_dir).select("ticker", "alpha", "half", F.round("delta", 9).alias("delta"), "p_i", "ask", "overlay")


def _overlay_metrics(rows: DataFrame) -> DataFrame:
    y, allow = F.col("up"), F.col("overlay") == "ALLOW"
    filled = F.col("filled")
    legacy = F.avg(F.when(filled, F.col("per_contract")))
    kept = F.sum(F.when(filled & allow, F.col("per_contract")).otherwise(0.0)) / F.nullif(F.count_if(filled), F.lit(0))
    return rows.groupBy("half", "alpha").agg(
        F.count("*").alias("n"), F.count_if(allow).alias("n_allowed"), *[F.count_if(F.col("overlay") == d).alias(d.lower()) for d in ("NO_NEW_CALL", "DIRECTION_FLIP", "LOW_CONFIDENCE", "NO_EDGE")],
        (X.brier(F.col("p"), y) - X.brier(F.col("p_i"), y)).alias("brier_gain"), (X.logloss(F.col("p"), y) - X.logloss(F.col("p_i"), y)).alias("logloss_gain"), (kept - legacy).alias("pc_gain"),
        F.round(100 * F.count_if(allow) / F.count("*"), 3).alias("retention_pct"),
    )


def overlay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _overlay_metrics(_overlaid(spark, sf_dir))
    return m.withColumns({c: F.round(c, 6) for c in ("brier_gain", "logloss_gain", "pc_gain")})


def alpha_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning half only: why each alpha does not qualify, and the smallest that does."""
    m = _overlay_metrics(_overlaid(spark, sf_dir).where("half = 'tuning'"))
    why = F.concat_ws(";", F.when(~(F.col("brier_gain") > 0), "BRIER"), F.when(~(F.col("logloss_gain") > 0), "LOGLOSS"), F.when(~(F.col("pc_gain") >= 0), "PNL"), F.when(F.col("retention_pct") < 90, "RETENTION"), F.when(100 - F.col("retention_pct") > 10, "EXTRA_BLOCKS"))
    judged = m.withColumn("reasons", why)
    chosen = F.min(F.when(F.col("reasons") == "", F.col("alpha"))).over(Window.partitionBy("half"))  # four rows
    return judged.select("alpha", "n", "n_allowed", F.round("brier_gain", 6).alias("brier_gain"), "retention_pct", "reasons", chosen.alias("selected"))


def gate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.gate_replay(scored(spark, sf_dir), "coin", ["us", "ticker"])
    return rows.select("coin", "ticker", "decision", F.round("block_share", 5).alias("block_share"), F.round("open_share", 5).alias("open_share"), "latched", "action")


def gate_latches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with its error breaker, kill switch and replays; every fourth market signals twice, one coin's gate is often broken."""
    rows = scored(spark, sf_dir).select("coin", "ticker", "us", "row_id", "decision")
    rows = rows.withColumn("nth", F.explode(F.when(F.col("row_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mark = F.col("row_id") * 2 + F.col("nth")
    failed = F.when(F.col("coin") == "SOL", mark % 4 == 1).otherwise(mark % 34 == 1)
    rows = rows.withColumns({"us": F.col("us") + F.col("nth") * 60_000_000, "failed": failed, "late": mark % 13 == 0, "killed": (F.col("coin") == "XRP") & (mark % 50 == 7)})
    return P.gate_run(rows, "coin", ["us", "ticker", "nth"]).select("coin", "ticker", "nth", "decision", "failed", "late", "errors", "action", "reason")


#: The reports of the stand-in policies look at signals between these times.
REPORT_US = (757382400 * V.SECOND, 851990400 * V.SECOND)


def journal_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each coin: do the journal's first signals bear the hash and threshold of the policy, and are they as many as reported?"""
    signals = observed(spark, sf_dir).where("signal")
    i = F.col("row_id")
    own = F.when(i % 29 == 0, "other").otherwise(F.concat(F.lit("hash-"), "coin"))
    journal = signals.select(F.col("coin").alias("policy"), "ticker", F.when(i % 37 != 0, F.col("us")).alias("us"), own.alias("hash"), F.when(i % 31 != 0, F.lit(POLICY.threshold)).alias("threshold"))
    journal = journal.distinct()
    low, high = REPORT_US
    policies = journal.groupBy("policy").agg(F.count_distinct("ticker").alias("reported"))
    policies = policies.select("policy", F.concat(F.lit("hash-"), "policy").alias("hash"), F.lit(POLICY.threshold).alias("threshold"), F.lit(low).alias("cutoff_us"), F.lit(high).alias("last_us"), "reported")
    return D.journal_binding(journal, policies)


def journal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends today's decisions to a journal that already has some: one row per (policy, ticker), the first one stays."""
    rows = scored(spark, sf_dir).select(F.lit(POLICY.name).alias("policy"), "ticker", "us", "decision")
    journal = rows.where("ticker % 5 = 0").withColumn("decision", F.lit("JOURNALLED"))
    again = rows.unionByName(rows.withColumn("us", F.col("us") + 1).where("ticker % 3 = 0"))
    first = again.groupBy("policy", "ticker").agg(F.min_by(F.struct("us", "decision"), "us").alias("f")).select("policy", "ticker", "f.*")
    return journal.unionByName(first.join(journal, ["policy", "ticker"], "left_anti"))


def policy_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which policies look at which rows: a policy has one coin or ALL.  Policies are a handful, rows are not."""
    policies = spark.createDataFrame([("p1", "ALL"), ("p2", "BTC"), ("p3", "XRP"), ("p4", "DOGE")], "policy string, scope string")
    rows = scored(spark, sf_dir).select("coin", F.explode(F.array(F.lit("ALL"), "coin")).alias("scope"), "decision")
    found = rows.join(F.broadcast(policies), "scope")
    counts = found.groupBy("policy").agg(F.count("*").alias("n"), F.count_distinct("coin").alias("coins"), F.count_if(F.col("decision") == "WOULD_BLOCK").alias("blocks"))
    return policies.join(counts, "policy", "left").drop("scope").fillna(0)


def call_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest call of each ticker; calls without a ticker are from before it was logged and only counted."""
    calls = observed(spark, sf_dir).select(F.when(F.col("row_id") % 23 != 0, F.col("ticker")).alias("ticker"), F.when(F.col("signal"), F.col("us")).alias("signal_us"), "us", "row_id", "coin")
    first = F.min_by(F.struct("signal_us", "us", "row_id", "coin"), F.struct(F.coalesce("signal_us", F.lit(1 << 62)), "us", "row_id"))
    exact = calls.where("ticker IS NOT NULL").groupBy("ticker").agg(first.alias("f"), F.count("*").alias("n")).select("ticker", "f.*", "n")
    legacy = calls.where("ticker IS NULL").groupBy().agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("ticker"), F.lit(None).cast("long").alias("signal_us"), F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("row_id"), F.lit("LEGACY").alias("coin"), "n")
    return exact.unionByName(legacy)


def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each coin's candidate names by score; a tie of different names is not resolved."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size", V.coin_of(F.col("p_partkey")).alias("coin"))
    points = F.when(F.col("p_brand").endswith("3"), 4).otherwise(0) + F.when(F.col("p_type").contains("STEEL"), 2).otherwise(0) + (F.col("p_size") > 25).cast("int")
    scores = parts.withColumn("score", points)
    best = scores.groupBy("coin").agg(F.max("score").alias("score"))
    tied = scores.join(best, ["coin", "score"]).groupBy("coin", "score").agg(F.count("*").alias("candidates"), F.min("p_partkey").alias("first"), F.count_distinct("p_size").alias("sizes"))
    one = F.col("candidates") == 1
    return tied.select("coin", "score", "candidates", F.when(one, F.col("first")).alias("symbol"), F.when(~one, "AMBIGUOUS").alias("reason"))


def queries() -> dict:
    own = (frozen_score, threshold_grid, threshold_metrics, settlement_metrics, pnl_metrics, subgroups, block_shift, overlay, overlay_metrics, alpha_screen, gate_replay, gate_latches, journal_binding, journal_dedup, policy_applicability, call_dedup, symbol_resolution)
    return {f.__name__: f for f in own}


def _sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-abs({z}))) ELSE exp(-abs({z})) / (1 + exp(-abs({z}))) END)"


def _scaled(c: str) -> str:
    low, high, mean, sd = POLICY.scalers[c]
    return f"((greatest({low}::DOUBLE, least({high}::DOUBLE, {c})) - {mean}::DOUBLE) / {sd}::DOUBLE)"


def _linear(beta: tuple, parts: list[str]) -> str:
    return "(" + " + ".join([f"{beta[0]}::DOUBLE", *(f"{b}::DOUBLE * {x}" for b, x in zip(beta[1:], parts))]) + ")"


_B = ["base_logit", _scaled("f2"), _scaled("f3")]
_C = [*_B, _scaled("f1"), f"({_scaled('f1')} * base_logit)"]
SCORED_SQL = f"""raw AS (SELECT * EXCLUDE (f1, f2), row_id % 37 <> 0 AS ready, CASE WHEN row_id % 41 <> 0 THEN f1 END AS f1, CASE WHEN row_id % 43 <> 0 THEN f2 END AS f2, CASE fav WHEN 'UP' THEN up ELSE 1 - up END AS win FROM signals),
    missed AS (SELECT *, CASE WHEN NOT ready THEN 'NOT_READY' WHEN f1 IS NULL THEN 'FEATURE_MISSING' WHEN f2 IS NULL OR f3 IS NULL THEN 'CONTROL_MISSING' WHEN base_logit IS NULL THEN 'BASE_MISSING' END AS missing FROM raw),
    modelled AS (SELECT *, CASE WHEN missing IS NULL THEN {_sigmoid(_linear(POLICY.beta_b, _B))} END AS b, CASE WHEN missing IS NULL THEN {_sigmoid(_linear(POLICY.beta_c, _C))} END AS c FROM missed),
    decided AS (SELECT *, CASE fav WHEN 'UP' THEN c ELSE 1 - c END - CASE fav WHEN 'UP' THEN b ELSE 1 - b END AS raw_conflict FROM modelled),
    scored AS (SELECT * EXCLUDE (b, c, raw_conflict, missing), round(b, 8) AS p_b, round(c, 8) AS p_c, round(raw_conflict, 8) AS conflict,
               CASE WHEN missing IS NOT NULL THEN 'UNAVAILABLE' WHEN raw_conflict <= -0.03::DOUBLE THEN 'WOULD_BLOCK' ELSE 'ALLOW' END AS decision,
               coalesce(missing, CASE WHEN raw_conflict <= -0.03::DOUBLE THEN 'WOULD_BLOCK' ELSE 'ALLOW' END) AS reason, row_id % 9 <> 0 AS filled,
               round(CASE win WHEN 1 THEN 10.0::DOUBLE ELSE -12.0::DOUBLE END + f3 / 10, 2) AS per_contract, round((CASE win WHEN 1 THEN 10.0::DOUBLE ELSE -12.0::DOUBLE END + f3 / 10) * f3, 2) AS pnl FROM decided)"""
HALVES_SQL = """halved AS (SELECT close_us, CASE WHEN 2 * before < total THEN 'tuning' ELSE 'holdout' END AS half FROM (
        SELECT close_us, coalesce(sum(n) OVER (ORDER BY close_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT close_us, count(*) AS n FROM {rows} GROUP BY close_us)))"""
_GROUPED = "grouped AS (SELECT 'ALL' AS grp, * FROM scored WHERE conflict IS NOT NULL UNION ALL SELECT coin, * FROM scored WHERE conflict IS NOT NULL)"
_GRID = "grid AS (SELECT grp, unnest([5, 10, 15, 20, 25])::INT AS quantile, unnest(quantile_cont(conflict, [0.05, 0.1, 0.15, 0.2, 0.25])) AS threshold FROM grouped GROUP BY grp)"
_BLEND = "round(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) + alpha * delta)), 10)"
OVERLAID_SQL = f"""usable AS (SELECT * FROM scored WHERE p_c IS NOT NULL), {HALVES_SQL.format(rows="usable")},
    graded AS (SELECT u.*, half, alpha, greatest(-0.05::DOUBLE, least(0.05::DOUBLE, p_c - p_b)) AS delta, (45 + row_id % 50)::DOUBLE AS ask FROM usable u JOIN halved USING (close_us), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]) AS alpha)),
    blended AS (SELECT *, {_BLEND} AS p_i FROM graded),
    overlaid AS (SELECT *, CASE WHEN row_id % 17 = 0 THEN 'NO_NEW_CALL' WHEN conf < 50 THEN 'DIRECTION_FLIP' WHEN conf < 80 THEN 'LOW_CONFIDENCE' WHEN conf - ask - 2 <= 0 THEN 'NO_EDGE' ELSE 'ALLOW' END AS overlay
                 FROM (SELECT *, CASE fav WHEN 'UP' THEN p_i ELSE 1 - p_i END * 100 AS conf FROM blended)),
    overlay_stats AS (SELECT half, alpha, count(*) AS n, count(*) FILTER (overlay = 'ALLOW') AS n_allowed, count(*) FILTER (overlay = 'NO_NEW_CALL') AS no_new_call, count(*) FILTER (overlay = 'DIRECTION_FLIP') AS direction_flip,
               count(*) FILTER (overlay = 'LOW_CONFIDENCE') AS low_confidence, count(*) FILTER (overlay = 'NO_EDGE') AS no_edge, avg((p - up) ** 2) - avg((p_i - up) ** 2) AS brier_gain,
               avg(-(up * ln(p) + (1 - up) * ln(1 - p))) - avg(-(up * ln(p_i) + (1 - up) * ln(1 - p_i))) AS logloss_gain,
               sum(CASE WHEN filled AND overlay = 'ALLOW' THEN per_contract ELSE 0 END) / count(*) FILTER (filled) - avg(per_contract) FILTER (filled) AS pc_gain, round(100 * count(*) FILTER (overlay = 'ALLOW') / count(*), 3) AS retention_pct FROM overlaid GROUP BY half, alpha)"""


def oracle_sql() -> dict[str, str]:
    base = "WITH " + ", ".join([V.SQL["markets"], V.SQL["observations"], SIGNAL_SQL, SCORED_SQL])
    grp, sets = "CASE WHEN grouping(coin) = 0 THEN coin ELSE 'ALL' END AS grp", "GROUP BY GROUPING SETS ((), (coin))"
    enrich = "100 * (avg(1 - win) FILTER (decision = 'WOULD_BLOCK') - avg(1 - win) FILTER (decision = 'ALLOW'))"
    return {
        "frozen_score": base + " SELECT ticker, coin, fav, decision, reason, p_b, p_c, conflict FROM scored",
        "threshold_grid": base + f", {_GROUPED}, {_GRID} SELECT grp, quantile, floor(threshold * 1e7::DOUBLE + 0.1234::DOUBLE) / 1e7::DOUBLE AS threshold FROM grid",
        "threshold_metrics": base + f""", {_GROUPED}, {_GRID}, m AS (SELECT grp, quantile, threshold, count(*) AS n, count(*) FILTER (conflict <= threshold) AS n_blocked, count(*) FILTER (conflict > threshold) AS n_kept, count(*) FILTER (conflict <= threshold) / count(*) AS block_fraction, avg(win) AS baseline_win_rate,
              avg(win) FILTER (conflict > threshold) AS kept_win_rate, avg(1 - win) FILTER (conflict <= threshold) AS blocked_loss_rate, avg(1 - win) FILTER (conflict > threshold) AS kept_loss_rate FROM grouped JOIN grid USING (grp) GROUP BY ALL),
            r AS (SELECT *, (blocked_loss_rate - kept_loss_rate) * 100 AS e, concat_ws(';', CASE WHEN NOT threshold < 0 THEN 'THRESHOLD_NOT_NEGATIVE' END, CASE WHEN n < 500 THEN 'FEW_ROWS' END, CASE WHEN n_blocked < 50 THEN 'FEW_BLOCKED' END, CASE WHEN n_kept < 300 THEN 'FEW_KEPT' END,
              CASE WHEN block_fraction NOT BETWEEN 0.05::DOUBLE AND 0.25::DOUBLE THEN 'BLOCK_FRACTION' END, CASE WHEN blocked_loss_rate IS NULL OR kept_loss_rate IS NULL OR (blocked_loss_rate - kept_loss_rate) * 100 < 5 THEN 'LOW_ENRICHMENT' END, CASE WHEN kept_win_rate IS NULL OR kept_win_rate < baseline_win_rate THEN 'KEPT_WORSE' END) AS ineligible FROM m)
            SELECT grp, quantile, floor(threshold * 1e7::DOUBLE + 0.1234::DOUBLE) / 1e7::DOUBLE AS threshold, n, n_blocked, n_kept, round(block_fraction, 5) AS block_fraction, round(baseline_win_rate, 5) AS baseline_win_rate, round(kept_win_rate, 5) AS kept_win_rate, round(blocked_loss_rate, 5) AS blocked_loss_rate, round(kept_loss_rate, 5) AS kept_loss_rate,
              round(e, 5) AS enrichment_pp, round(CASE WHEN blocked_loss_rate > 0 AND blocked_loss_rate < 1 AND kept_loss_rate > 0 AND kept_loss_rate < 1 THEN (blocked_loss_rate / (1 - blocked_loss_rate)) / (kept_loss_rate / (1 - kept_loss_rate)) END, 5) AS odds_ratio, ineligible, ineligible = '' AS eligible FROM r""",
        "settlement_metrics": base + f" SELECT {grp}, count(*) AS n, count(*) FILTER (decision = 'WOULD_BLOCK') AS n_blocked, count(*) FILTER (decision = 'ALLOW') AS n_allowed, round(avg(win), 6) AS baseline_win_rate, round(avg(win) FILTER (decision = 'ALLOW'), 6) AS allowed_win_rate, round(avg(win) FILTER (decision = 'WOULD_BLOCK'), 6) AS blocked_win_rate, round({enrich}, 4) AS enrichment_pp FROM scored {sets}",
        "pnl_metrics": base + f""" SELECT {grp}, count(*) AS n, count(*) FILTER (decision = 'ALLOW') AS n_allowed, count(*) FILTER (decision = 'WOULD_BLOCK') AS n_blocked, round(sum(pnl), 2) AS total, round(sum(pnl) FILTER (decision = 'ALLOW'), 2) AS allowed_total, round(avg(per_contract), 5) AS mean_pc,
            round(quantile_cont(per_contract, 0.5), 4) AS median_pc, round(quantile_cont(per_contract, 0.5) FILTER (decision = 'ALLOW'), 4) AS allowed_median_pc, round(sum(CASE WHEN decision = 'ALLOW' THEN per_contract ELSE 0 END) / count(*), 5) AS filtered_mean_pc,
            round(sum(CASE WHEN decision = 'ALLOW' THEN per_contract ELSE 0 END) / count(*) - avg(per_contract), 5) AS improvement FROM scored WHERE filled {sets}""",
        "subgroups": base + f""", {HALVES_SQL.format(rows="scored")}, kinds AS (SELECT s.*, k.kind, CASE k.kind WHEN 'side' THEN fav WHEN 'coin' THEN coin ELSE half END AS value FROM scored s JOIN halved USING (close_us), (SELECT unnest(['side', 'coin', 'half']) AS kind) k),
            m AS (SELECT kind, value, count(*) AS n, count(*) FILTER (decision = 'WOULD_BLOCK') AS n_blocked, count(*) FILTER (decision = 'ALLOW') AS n_allowed, {enrich} AS e FROM kinds GROUP BY ALL)
            SELECT kind, value, n, n_blocked, n_allowed, round(e, 4) AS enrichment_pp, coalesce(bool_or(n >= 30 AND n_blocked >= 10 AND n_allowed >= 10 AND e >= 5) OVER (PARTITION BY kind) AND bool_or(n >= 30 AND n_blocked >= 10 AND n_allowed >= 10 AND e <= -5) OVER (PARTITION BY kind), false) AS inconsistent FROM m""",
        "block_shift": base + f""", usable AS (SELECT * FROM scored WHERE conflict IS NOT NULL), {HALVES_SQL.format(rows="usable")},
            m AS (SELECT half, count(*) AS n, avg(conflict) AS mean, stddev_pop(conflict) AS sd, quantile_cont(conflict, 0.05) AS p05, avg((decision = 'WOULD_BLOCK')::INT) AS br FROM usable JOIN halved USING (close_us) GROUP BY half),
            j AS (SELECT t.n AS n_tuning, h.n AS n_holdout, t.p05 AS a, h.p05 AS b, h.br / nullif(t.br, 0) AS ratio, (h.mean - t.mean) / sqrt((h.sd ** 2 + t.sd ** 2) / 2) AS smd FROM m t, m h WHERE t.half = 'tuning' AND h.half = 'holdout')
            SELECT n_tuning, n_holdout, round(a, 6) AS p05_tuning, round(b, 6) AS p05_holdout, round(ratio, 4) AS block_ratio, round(smd, 4) AS smd, ratio < 0.5 OR ratio > 2 OR abs(smd) > 1 AS shifted FROM j""",
        "overlay": base + f", {OVERLAID_SQL} SELECT ticker, alpha, half, round(delta, 9) AS delta, p_i, ask, overlay FROM overlaid",
        "overlay_metrics": base + f", {OVERLAID_SQL} SELECT * REPLACE (round(brier_gain, 6) AS brier_gain, round(logloss_gain, 6) AS logloss_gain, round(pc_gain, 6) AS pc_gain) FROM overlay_stats",
        "alpha_screen": base + f""", {OVERLAID_SQL}, judged AS (SELECT *, concat_ws(';', CASE WHEN NOT brier_gain > 0 THEN 'BRIER' END, CASE WHEN NOT logloss_gain > 0 THEN 'LOGLOSS' END, CASE WHEN NOT pc_gain >= 0 THEN 'PNL' END, CASE WHEN retention_pct < 90 THEN 'RETENTION' END, CASE WHEN 100 - retention_pct > 10 THEN 'EXTRA_BLOCKS' END) AS reasons
            FROM overlay_stats WHERE half = 'tuning') SELECT alpha, n, n_allowed, round(brier_gain, 6) AS brier_gain, retention_pct, reasons, min(CASE WHEN reasons = '' THEN alpha END) OVER () AS selected FROM judged""",
        "gate_replay": base + f""", counted AS (SELECT *, count(*) OVER w AS k, count(*) FILTER (decision = 'WOULD_BLOCK') OVER w AS b, count(*) FILTER (decision = 'UNAVAILABLE') OVER w AS o FROM scored WINDOW w AS (PARTITION BY coin ORDER BY us, ticker ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
            latch AS (SELECT *, coalesce(bool_or(k >= 30 AND (b > 0.35::DOUBLE * k OR o > 0.50::DOUBLE * k)) OVER (PARTITION BY coin ORDER BY us, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS latched FROM counted)
            SELECT coin, ticker, decision, round(b / k, 5) AS block_share, round(o / k, 5) AS open_share, latched, CASE WHEN latched THEN 'PASS_LATCHED' WHEN decision = 'WOULD_BLOCK' THEN 'SUPPRESS' WHEN decision = 'UNAVAILABLE' THEN 'PASS_OPEN' ELSE 'PASS' END AS action FROM latch""",
        "gate_latches": base + """, twice AS (SELECT coin, ticker, us + nth * 60000000 AS us, row_id * 2 + nth AS mark, nth, decision FROM scored, (SELECT unnest([0, 1])::INT AS nth) WHERE nth = 0 OR row_id % 4 = 0),
            flagged AS (SELECT *, CASE coin WHEN 'SOL' THEN mark % 4 = 1 ELSE mark % 34 = 1 END AS failed, mark % 13 = 0 AS late, coin = 'XRP' AND mark % 50 = 7 AS killed FROM twice),
            placed AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY us, ticker, nth) AS i FROM flagged),
            firsts AS (SELECT coin, ticker, min(i) FILTER (NOT failed) AS first_i FROM placed GROUP BY ALL),
            judged AS (SELECT *, CASE WHEN coalesce(i > first_i, false) THEN 'REPLAY' WHEN failed THEN 'ERROR' WHEN late AND decision IN ('ALLOW', 'WOULD_BLOCK') OR decision = 'UNAVAILABLE' THEN 'OPEN' WHEN decision = 'WOULD_BLOCK' THEN 'BLOCK' ELSE 'ALLOW' END AS outcome FROM placed JOIN firsts USING (coin, ticker)),
            spans AS (SELECT *, outcome <> 'REPLAY' AND NOT failed AND decision IN ('ALLOW', 'WOULD_BLOCK') AS settles FROM judged),
            numbered AS (SELECT *, sum(settles::INT) OVER (PARTITION BY coin ORDER BY i) AS span FROM spans),
            counted AS (SELECT *, (sum((outcome = 'ERROR')::INT) OVER w + max((settles AND late)::INT) OVER w)::BIGINT AS errors FROM numbered WINDOW w AS (PARTITION BY coin, span ORDER BY i)),
            rated AS (SELECT coin, i, count(*) OVER w AS n, count(*) FILTER (outcome = 'BLOCK') OVER w AS b, count(*) FILTER (outcome = 'OPEN') OVER w AS o FROM counted WHERE outcome IN ('ALLOW', 'BLOCK', 'OPEN') WINDOW w AS (PARTITION BY coin ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
            trips AS (SELECT coin, i, CASE WHEN b > 0.35::DOUBLE * n THEN 'BLOCK_RATE' ELSE 'OPEN_RATE' END AS why FROM rated WHERE n >= 30 AND (b > 0.35::DOUBLE * n OR o > 0.50::DOUBLE * n) UNION ALL SELECT coin, i, 'ERRORS' FROM counted WHERE outcome = 'ERROR' AND errors >= 3),
            latches AS (SELECT coin, min(i) AS tripped, arg_min(why, i) AS breaker FROM trips GROUP BY coin), kills AS (SELECT coin, min(i) AS kill_i FROM counted WHERE killed GROUP BY coin),
            done AS (SELECT c.*, CASE WHEN outcome = 'REPLAY' THEN (SELECT p.outcome FROM judged p WHERE p.coin = c.coin AND p.i = c.first_i) ELSE outcome END AS seen, coalesce(i >= kill_i, false) AS dead, coalesce(i > tripped, false) AS latched, breaker
                     FROM counted c LEFT JOIN latches USING (coin) LEFT JOIN kills USING (coin))
            SELECT coin, ticker, nth, decision, failed, late, errors, CASE WHEN dead OR latched THEN 'INACTIVE' WHEN seen = 'BLOCK' THEN 'SUPPRESS' WHEN seen IN ('OPEN', 'ERROR') THEN 'PASS_OPEN' ELSE 'PASS' END AS action,
                   CASE WHEN dead THEN 'KILLED' WHEN latched THEN 'BREAKER_' || breaker WHEN outcome = 'REPLAY' THEN 'REPLAY_' || seen WHEN outcome = 'ERROR' THEN 'INTERNAL' WHEN outcome = 'OPEN' AND late AND decision <> 'UNAVAILABLE' THEN 'TIMEOUT' WHEN outcome = 'OPEN' THEN 'UNAVAILABLE' ELSE outcome END AS reason
            FROM done""",
        "journal_binding": "WITH " + ", ".join([V.SQL["markets"], V.SQL["observations"]]) + f""", journal AS (
                SELECT DISTINCT coin AS policy, ticker, CASE WHEN row_id % 37 <> 0 THEN us END AS us, CASE WHEN row_id % 29 = 0 THEN 'other' ELSE 'hash-' || coin END AS hash, CASE WHEN row_id % 31 <> 0 THEN {POLICY.threshold}::DOUBLE END AS threshold FROM observations WHERE signal),
            first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy, ticker ORDER BY coalesce(us, 0), us NULLS FIRST, hash, threshold NULLS FIRST) AS k FROM journal) WHERE k = 1),
            used AS (SELECT *, hash <> 'hash-' || policy AS bad, threshold IS NULL OR abs(threshold - ({POLICY.threshold}::DOUBLE)) > 1e-12 AS off FROM first WHERE us > {REPORT_US[0]} AND us <= {REPORT_US[1]}),
            sums AS (SELECT policy, count(*) AS used, count(*) FILTER (bad) AS bad_hash, count(*) FILTER (off) AS bad_threshold, sum(('0x' || substr(sha256(ticker || '|' || us || '|' || hash), 1, 12))::BIGINT) AS digest FROM used GROUP BY policy)
            SELECT policy, coalesce(used, 0) AS used, coalesce(bad_hash, 0) AS bad_hash, coalesce(bad_threshold, 0) AS bad_threshold, coalesce(used, 0) || ':' || coalesce(digest, 0)::HUGEINT AS digest,
                   concat_ws(';', CASE WHEN coalesce(used, 0) <> reported THEN 'ROWS' END, CASE WHEN bad_hash > 0 THEN 'HASH' END, CASE WHEN bad_threshold > 0 THEN 'THRESHOLD' END) AS problems
            FROM (SELECT policy, count(DISTINCT ticker) AS reported FROM journal GROUP BY policy) LEFT JOIN sums USING (policy)""",
        "journal_dedup": base + " SELECT 'p1' AS policy, ticker, us, CASE WHEN ticker % 5 = 0 THEN 'JOURNALLED' ELSE decision END AS decision FROM scored",
        "policy_applicability": base + """ SELECT policy, count(coin) AS n, count(DISTINCT coin) AS coins, count(coin) FILTER (decision = 'WOULD_BLOCK') AS blocks
            FROM (VALUES ('p1', 'ALL'), ('p2', 'BTC'), ('p3', 'XRP'), ('p4', 'DOGE')) p(policy, scope) LEFT JOIN scored ON scope = 'ALL' OR scope = coin GROUP BY policy""",
        "call_dedup": base + """, c AS (SELECT CASE WHEN row_id % 23 <> 0 THEN ticker END AS ticker, CASE WHEN signal THEN us END AS signal_us, us, row_id, coin FROM observations),
            f AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY coalesce(signal_us, 4611686018427387904), us, row_id) AS place FROM c WHERE ticker IS NOT NULL)
            SELECT ticker, signal_us, us, row_id, coin, n FROM f WHERE place = 1 UNION ALL SELECT NULL, NULL, NULL, NULL, 'LEGACY', count(*) FROM c WHERE ticker IS NULL""",
        "symbol_resolution": """WITH s AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'XRP' END AS coin,
              CASE WHEN ends_with(p_brand, '3') THEN 4 ELSE 0 END + CASE WHEN contains(p_type, 'STEEL') THEN 2 ELSE 0 END + (p_size > 25)::INT AS score FROM part)
            SELECT coin, score, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS symbol, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' END AS reason
            FROM s JOIN (SELECT coin, max(score) AS score FROM s GROUP BY coin) USING (coin, score) GROUP BY coin, score""",
    }
