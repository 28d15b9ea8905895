"""Frozen policies: scoring rows, choosing thresholds, overlays, and the suppress-only gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.operators import scans
from tidemark.operators.ordered import row_buckets
from tidemark.storage import written


@dataclass(frozen=True)
class Policy:
    """A frozen pair of logistic models: B on base logit and controls, C with the feature added."""

    name: str
    feature: str
    controls: Sequence[str]
    #: column: (low, high, mean, deviation) of the training rows, after clipping to low and high.
    scalers: Mapping[str, tuple[float, float, float, float]]
    beta_b: Sequence[float]
    beta_c: Sequence[float]
    threshold: float
    group: str = "ALL"
    reliability: bool = False
    extra: Mapping[str, str] = field(default_factory=dict)
    #: coin: scalers as above, used in place of ``scalers`` where given; other coins cannot be scored.
    coin_scalers: Mapping[str, Mapping[str, tuple[float, float, float, float]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.threshold >= 0:
            raise ValueError("a threshold must be negative: others would block calls that the feature confirms")
        if len(self.beta_b) != 2 + len(self.controls) or len(self.beta_c) != 3 + len(self.controls) + self.reliability:
            raise ValueError("coefficients do not match the design")
        for scalers in self.coin_scalers.values() or [self.scalers]:
            if missing := [c for c in [*self.controls, self.feature] if c not in scalers]:
                raise ValueError(f"no scaler for {missing}")

    def standardized(self, column: str) -> Column:
        """The column by the scaler of the policy or of the row's coin; null for coins without one."""
        if not self.coin_scalers:
            return scaled(column, self.scalers[column])
        return F.coalesce(*(F.when(F.col("coin") == k, scaled(column, s[column])) for k, s in self.coin_scalers.items()))


def scaled(column: str, scaler: tuple[float, float, float, float]) -> Column:
    low, high, mean, sd = scaler
    return (F.greatest(F.lit(low), F.least(F.lit(high), F.col(column))) - mean) / sd


def score(rows: DataFrame, policy: Policy, ready: str = "ready", fav: str = "fav") -> DataFrame:
    """Adds decision, reason, p_b, p_c and conflict (favoured side's change of probability) to rows.

    Reasons are tried in order: other coin, not ready, feature, control or base missing, no side, no scaler for the coin.
    All in columns, so that scoring stays within one stage.
    """
    controls = [policy.standardized(c) for c in policy.controls]
    feature = policy.standardized(policy.feature)
    base = F.col("base_logit")
    parts_b = [base, *controls]
    parts_c = [*parts_b, feature, *([feature * base] if policy.reliability else [])]
    linear = lambda beta, parts: sum((b * x for b, x in zip(beta[1:], parts)), F.lit(float(beta[0])))
    p_b, p_c = M.sigmoid(linear(policy.beta_b, parts_b)), M.sigmoid(linear(policy.beta_c, parts_c))
    missing = (
        F.when(~F.col(ready), "NOT_READY").when(F.col(policy.feature).isNull(), "FEATURE_MISSING")
        .when(F.greatest(F.lit(0), *[F.col(c).isNull().cast("int") for c in policy.controls]) > 0, "CONTROL_MISSING")
        .when(base.isNull(), "BASE_MISSING").when(~F.col(fav).isin("UP", "DOWN") | F.col(fav).isNull(), "SIDE_MISSING")
    )
    if policy.coin_scalers:
        missing = F.coalesce(missing, F.when(~F.col("coin").isin(*policy.coin_scalers) | F.col("coin").isNull(), "SCALER_MISSING"))
    other = F.lit(False) if policy.group == "ALL" else F.col("coin") != policy.group
    rows = rows.withColumn("missing", F.when(other, "OTHER_COIN").otherwise(missing))
    usable = F.col("missing").isNull()
    rows = rows.withColumn("p_b", F.when(usable, p_b)).withColumn("p_c", F.when(usable, p_c))
    rows = rows.withColumn("conflict", M.favored(F.col("p_c"), F.col(fav)) - M.favored(F.col("p_b"), F.col(fav)))
    decision = (
        F.when(F.col("missing") == "OTHER_COIN", "NOT_APPLICABLE").when(~usable, "UNAVAILABLE").when(F.col("conflict") <= policy.threshold, "WOULD_BLOCK").otherwise("ALLOW")
    )
    return rows.withColumn("decision", decision).withColumn("reason", F.coalesce("missing", "decision")).drop("missing")


def threshold_grid(rows: DataFrame, by: list[str], conflict: str = "conflict", quantiles: Sequence[int] = C.QUANTILES) -> DataFrame:
    """(by, quantile, threshold): low percentiles of the conflict."""
    at = [q / 100 for q in quantiles]
    found = scans.percentiles(rows, by, [conflict], at).withColumnRenamed("q", "t")
    return found.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("quantile"), F.col("t").alias("threshold"))).alias("z")).select(*by, "z.quantile", "z.threshold")


def threshold_metrics(rows: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """What each threshold would block, and how losses gather there.  The grid has a few rows for each group."""
    m = rows.join(F.broadcast(grid), by)
    blocked = F.col("conflict") <= F.col("threshold")
    n, k = F.count("*"), F.count_if(blocked)
    loss = 1 - F.col("win")
    bl, kl = F.avg(F.when(blocked, loss)), F.avg(F.when(~blocked, loss))
    odds = (bl / (1 - bl)) / (kl / (1 - kl))
    return m.groupBy(*by, "quantile", "threshold").agg(
        n.alias("n"), k.alias("n_blocked"), (n - k).alias("n_kept"), (k / n).alias("block_fraction"), F.avg("win").alias("baseline_win_rate"), F.avg(F.when(~blocked, F.col("win"))).alias("kept_win_rate"),
        bl.alias("blocked_loss_rate"), kl.alias("kept_loss_rate"), ((bl - kl) * 100).alias("enrichment_pp"), F.when((bl > 0) & (bl < 1) & (kl > 0) & (kl < 1), odds).alias("odds_ratio"),
    )


#: Gates of a threshold: rows, blocked, kept, least and most block fraction, least enrichment (fixed values).
GATES = (500, 50, 300, 0.05, 0.25, 5.0)


def eligibility(m: DataFrame, gates: tuple = GATES, resampled: bool = False, q_max: float = 0.05) -> DataFrame:
    """Adds the reasons against a threshold; none means eligible.

    If ``resampled``, the interval of the enrichment (``ci_low``) and the q-value count as well.
    """
    total, blocked, kept, low, high, pp = gates
    c = F.col
    why = [
        F.when(~(c("threshold") < 0), "THRESHOLD_NOT_NEGATIVE"), F.when(c("n") < total, "FEW_ROWS"), F.when(c("n_blocked") < blocked, "FEW_BLOCKED"), F.when(c("n_kept") < kept, "FEW_KEPT"),
        F.when(~c("block_fraction").between(low, high), "BLOCK_FRACTION"), F.when(c("enrichment_pp").isNull() | (c("enrichment_pp") < pp), "LOW_ENRICHMENT"),
        *([F.when(c("ci_low").isNull() | (c("ci_low") <= 0), "INTERVAL_INCLUDES_0"), F.when(c("q_value").isNull() | (c("q_value") > q_max), "Q_VALUE")] if resampled else []),
        F.when(c("kept_win_rate").isNull() | (c("kept_win_rate") < c("baseline_win_rate")), "KEPT_WORSE"),
    ]
    return m.withColumn("ineligible", F.concat_ws(";", *why)).withColumn("eligible", F.col("ineligible") == "")


def most_conservative(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """The eligible threshold that blocks least."""
    return evaluated.where("eligible").groupBy(*by).agg(F.min_by(F.struct("quantile", "threshold", "block_fraction"), F.struct("block_fraction", "quantile")).alias("m")).select(*by, "m.*")


def verify_first(scored: DataFrame, expected: DataFrame, tolerance_us: int = 1000) -> DataFrame:
    """Compares scored first signals with when they were expected (ticker, expected_us), to a millisecond.

    Adds ``verified``: null where no time is expected.  A row at another time is not the first signal; it becomes
    UNAVAILABLE, without values, and is never replaced by a later one.
    """
    rows = scored.join(expected, "ticker", "left").withColumn("verified", F.abs(F.col("us") - F.col("expected_us")) <= tolerance_us)
    missed = F.coalesce(~F.col("verified"), F.lit(False))
    values = {c: F.when(~missed, F.col(c)) for c in ("p_b", "p_c", "conflict")}
    return rows.withColumns({**values, "decision": F.when(missed, "UNAVAILABLE").otherwise(F.col("decision")), "reason": F.when(missed, "FIRST_SIGNAL_MISSED").otherwise(F.col("reason"))})


def is_stale(created_us: Column, now_us: Column, max_age_days: int) -> Column:
    return now_us - created_us > max_age_days * 86_400_000_000


#: What may become of a journalled row, in the order of the tests.
PREPARED = ("DUPLICATE", "BEFORE_CUTOFF", "UNAVAILABLE", "PROBABILITY_MISMATCH", "EDGE_MISMATCH", "WOULD_BLOCK", "UNSETTLED", "READY")


def prepare_overlay(journal: DataFrame, labels: DataFrame, calls: DataFrame, cutoff_us: int, threshold: float, tolerance: float = 1e-6) -> DataFrame:
    """Says of each journalled row whether an overlay may be judged on it (``reason`` READY), and how its call was filled.

    Of the rows of a ticker the earliest counts.  Stored conflicts and edges must follow from the stored probabilities,
    within ``tolerance`` and the rounding of the stored edges; rows whose numbers do not are left out.  ``fill`` is null for
    rows left out before calls are looked at.
    """
    c = F.col
    near = lambda a, b, by: F.coalesce(F.abs(a - b) <= by, F.lit(False))
    again = F.row_number().over(Window.partitionBy("ticker").orderBy(F.coalesce("us", F.lit(0)), "row_id")) > 1
    sided = F.coalesce(c("fav").isin("UP", "DOWN") & c("p_b").between(0, 1) & c("p_c").between(0, 1), F.lit(False))
    b, k = M.favored(c("p_b"), c("fav")), M.favored(c("p_c"), c("fav"))
    # the decision was taken before the values were rounded
    decided = F.coalesce(((c("conflict") <= threshold) == (c("decision") == "WOULD_BLOCK")) | (F.abs(c("conflict") - threshold) <= tolerance), F.lit(False))
    fits = sided & near(c("p_b_fav"), b, tolerance) & near(c("p_c_fav"), k, tolerance) & near(c("conflict"), k - b, tolerance) & decided
    conf = F.greatest(c("p"), 1 - c("p")) * 100
    edges = F.coalesce((c("p") >= 0.5) == (c("fav") == "UP"), F.lit(False)) & near(conf, c("base_conf"), 0.06) & near(conf - c("ask"), c("raw_edge"), 0.06) & near(c("raw_edge") - C.ENTRY_COST, c("net_edge"), 0.11)
    reason = (
        F.when(c("again"), "DUPLICATE").when(c("us").isNull() | (c("us") <= cutoff_us), "BEFORE_CUTOFF").when(c("decision") == "UNAVAILABLE", "UNAVAILABLE").when(~fits, "PROBABILITY_MISMATCH")
        .when(~edges, "EDGE_MISMATCH").when(c("decision") == "WOULD_BLOCK", "WOULD_BLOCK").when(c("label").isNull(), "UNSETTLED").otherwise("READY")
    )
    rows = journal.withColumn("again", again).join(labels, "ticker", "left").join(calls, "ticker", "left").withColumn("reason", reason)
    return rows.drop("again").withColumn("fill", F.when(c("reason").isin(*PREPARED[5:]), F.coalesce("fill", F.lit("unmatched"))))


def gate_replay(rows: DataFrame, key: str, order: list[str], window: int = C.GATE_WINDOW) -> DataFrame:
    """Replays the suppress-only gate over the decisions of each key in order.

    The breaker looks at the last ``window`` decisions: too many blocks, or too many that could not be scored, trip it
    once there are enough of them; from then on it stays latched and everything passes.
    """
    w = Window.partitionBy(key, "bucket").orderBy("i")
    recent = w.rowsBetween(-(window - 1), 0)
    n = F.count("*").over(recent)
    blocks = F.count_if(F.col("decision") == "WOULD_BLOCK").over(recent)
    opened = F.count_if(F.col("decision") == "UNAVAILABLE").over(recent)
    trips = (n >= C.GATE_MIN) & ((blocks > C.GATE_MAX_BLOCK * n) | (opened > C.GATE_MAX_OPEN * n))
    staged = row_buckets(rows, [key], order, window - 1)
    staged = staged.withColumn("block_share", blocks / n).withColumn("open_share", opened / n).withColumn("trips", trips)
    staged = written(staged.where(~F.col("in_halo")).drop("bucket", "in_halo"))
    # one row for each key
    first = staged.where("trips").groupBy(key).agg(F.min("i").alias("tripped"))
    staged = staged.join(first, key, "left")
    latched = F.coalesce(F.col("i") > F.col("tripped"), F.lit(False))
    action = F.when(latched, "PASS_LATCHED").when(F.col("decision") == "WOULD_BLOCK", "SUPPRESS").when(F.col("decision") == "UNAVAILABLE", "PASS_OPEN").otherwise("PASS")
    return staged.withColumn("latched", latched).withColumn("action", action).drop("i", "tripped")


def gate_run(rows: DataFrame, key: str, order: list[str], window: int = C.GATE_WINDOW) -> DataFrame:
    """The suppress-only gate with its latches, over the signals of each key in order: adds errors, action, reason.

    Needs ``ticker``, ``decision`` and three booleans: ``failed`` (the gate raised), ``late`` (over its time budget: a block
    or pass counts as not scored) and ``killed`` (the kill switch was seen).  Of a ticker the first decision that was
    recorded stands for its later signals (REPLAY).  Three errors with no block or pass between them, too many blocks or
    too many unscored in the last ``window`` recorded decisions trip the breaker; from the next signal on, and from the
    kill switch on, the gate is INACTIVE.  Counters are linear recurrences over buckets, so no key is one task.
    """
    c = F.col
    placed = written(scans.numbered(rows, [key], order))
    scored = ~c("failed") & (c("decision") != "NOT_APPLICABLE")
    first = placed.where(scored).groupBy(key, "ticker").agg(F.min("i").alias("first_i"))
    placed = placed.join(first, [key, "ticker"], "left").withColumn("again", F.coalesce(c("i") > c("first_i"), F.lit(False)))
    passed = c("decision").isin("ALLOW", "WOULD_BLOCK")
    open_ = c("late") & passed | (c("decision") == "UNAVAILABLE")
    outcome = F.when(c("again"), "REPLAY").when(c("failed"), "ERROR").when(~scored, "NOT_APPLICABLE").when(open_, "OPEN").when(c("decision") == "WOULD_BLOCK", "BLOCK").otherwise("ALLOW")
    rows_in = written(placed.withColumn("outcome", outcome))
    # errors in a row: x -> x + 1 for an error, 0 for a block or pass (1 if it was late), else unchanged
    settles = ~c("again") & ~c("failed") & passed
    steps = rows_in.withColumn("__a", F.when(settles, 0.0).otherwise(1.0)).withColumn("errors", F.when(settles & c("late") | (c("outcome") == "ERROR"), 1.0).otherwise(0.0))
    counted = written(scans.linear_scan(steps, [key], "__a", ["errors"]).drop("__a", "bucket"))
    # shares among the last recorded decisions
    kept = counted.where(c("outcome").isin("ALLOW", "BLOCK", "OPEN")).select(key, "i", "outcome")
    near = scans.with_halo(scans.numbered(kept.withColumnRenamed("i", "at"), [key], ["at"]), window - 1)
    recent = Window.partitionBy(key, "bucket").orderBy("i").rowsBetween(-(window - 1), 0)
    n, blocks, opened = F.count("*").over(recent), F.count_if(c("outcome") == "BLOCK").over(recent), F.count_if(c("outcome") == "OPEN").over(recent)
    why = F.when(n >= C.GATE_MIN, F.when(blocks > C.GATE_MAX_BLOCK * n, "BLOCK_RATE").when(opened > C.GATE_MAX_OPEN * n, "OPEN_RATE"))
    rates = near.withColumn("why", why).where(~c("in_halo")).where("why IS NOT NULL").select(key, F.struct(c("at").alias("i"), "why").alias("trip"))
    errors = counted.where((c("outcome") == "ERROR") & (c("errors") >= C.GATE_ERRORS)).select(key, F.struct("i", F.lit("ERRORS").alias("why")).alias("trip"))
    # one row for each key
    trips = rates.unionByName(errors).groupBy(key).agg(F.min("trip").alias("trip")).select(key, c("trip.i").alias("tripped"), c("trip.why").alias("breaker"))
    kills = counted.where("killed").groupBy(key).agg(F.min("i").alias("kill_i"))
    prior = counted.where("i = first_i").select(key, "ticker", c("outcome").alias("stood"))
    found = counted.join(trips, key, "left").join(kills, key, "left").join(prior, [key, "ticker"], "left")
    killed, latched = F.coalesce(c("i") >= c("kill_i"), F.lit(False)), F.coalesce(c("i") > c("tripped"), F.lit(False))
    seen = F.when(c("outcome") == "REPLAY", c("stood")).otherwise(c("outcome"))
    action = F.when(killed | latched, "INACTIVE").when(seen == "BLOCK", "SUPPRESS").when(seen.isin("OPEN", "ERROR"), "PASS_OPEN").otherwise("PASS")
    late = c("late") & passed & (c("outcome") == "OPEN")
    reason = (
        F.when(killed, "KILLED").when(latched, F.concat(F.lit("BREAKER_"), "breaker")).when(c("outcome") == "REPLAY", F.concat(F.lit("REPLAY_"), "stood"))
        .when(c("outcome") == "ERROR", "INTERNAL").when(late, "TIMEOUT").when(c("outcome") == "OPEN", "UNAVAILABLE").otherwise(c("outcome"))
    )
    out = found.withColumns({"errors": c("errors").cast("long"), "action": action, "reason": reason})
    return out.select(*[x for x in rows.columns if x != "reason"], "errors", "action", "reason")
