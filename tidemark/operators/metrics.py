"""Forecast metrics, ranks, multiple testing and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.ordered import with_before
from tidemark.functions.market import clamp_p
from tidemark.storage import written


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def logloss(p: Column, y: Column) -> Column:
    q = clamp_p(p)
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def calibration(df: DataFrame, by: list[str], p: str = "p", y: str = "up", bins: int = C.CALIBRATION_BINS) -> DataFrame:
    """Every bin of every group, empty ones too."""
    slot = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    every = found.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*by, "bin"], "left").fillna(0, ["n"])


def ece(df: DataFrame, by: list[str], p: str = "p", y: str = "up", bins: int = C.CALIBRATION_BINS) -> DataFrame:
    found = calibration(df, by, p, y, bins)
    gap = F.coalesce(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n"), F.lit(0.0))
    return found.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def value_counts(df: DataFrame, by: list[str], value: str, *sums: Column) -> DataFrame:
    """Distinct values of a group with counts: what ranks need, and far fewer rows than the input where values repeat."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"), *sums)


def average_ranks(counted: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``, the mean rank of each value's ties, to counted values."""
    return with_before(counted, by, ["v"], "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("before")


def auc(df: DataFrame, by: list[str], p: str = "p", y: str = "up") -> DataFrame:
    """Mann-Whitney; null for one class."""
    ranked = average_ranks(value_counts(df, by, p, F.sum(y).alias("ones")), by)
    pos, total = F.sum("ones"), F.sum("n")
    neg = total - pos
    value = (F.sum(F.col("rank") * F.col("ones")) - pos * (pos + 1) / 2) / (pos * neg)
    return ranked.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), value).alias("auc"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; null for fewer than three rows or no variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(value_counts(both, by, x), by).select(*by, F.col("v").alias(x), F.col("rank").alias("rx"))
    ry = average_ranks(value_counts(both, by, y), by).select(*by, F.col("v").alias(y), F.col("rank").alias("ry"))
    rows = both.join(rx, [*by, x]).join(ry, [*by, y])
    usable = (F.count("*") >= 3) & (F.var_pop("rx") > C.ZERO_VARIANCE) & (F.var_pop("ry") > C.ZERO_VARIANCE)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(usable, F.corr("rx", "ry")).alias("rho"))


def bh_qvalues(df: DataFrame, by: list[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg; null p-values are passed over."""
    known = F.col(p).isNotNull()
    up = Window.partitionBy(*by, known).orderBy(F.col(p))
    whole = Window.partitionBy(*by, known)
    ranked = df.withColumn("__rank", F.row_number().over(up)).withColumn("__raw", F.col(p) * F.count("*").over(whole) / F.col("__rank"))
    down = Window.partitionBy(*by, known).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.when(known, F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__rank", "__raw")


def walk_forward(df: DataFrame, key: str, by: list[str], bounds: tuple[float, ...] = C.FOLD_BOUNDS) -> DataFrame:
    """Per (group, time key): its block, 0 for the first training block, then the fold that it tests; whole keys only.

    A key lies beyond a bound if the rows before it already reach that share of all rows.
    """
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    counts = _placed(counts, key, by)
    beyond = sum((F.when(F.col("before") >= F.bround(F.col("total") * b), 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    return counts.withColumn("block", beyond.cast("int")).drop("before", "total")


def fold_cuts(counts: DataFrame, key: str, by: list[str], bounds: tuple[float, ...] = C.FOLD_BOUNDS) -> DataFrame:
    """(by, cuts): the keys at which a group's blocks after the first begin, from its counted keys (n); see ``walk_forward``.

    A row's block is the number of cuts up to its key, as the rows before a key only grow; one row for each group.
    """
    beyond = [F.min(F.when(F.col("before") >= F.bround(F.col("total") * b), F.col(key))) for b in bounds[:-1]]
    return _placed(counts, key, by).groupBy(*by).agg(F.array_compact(F.array(*beyond)).alias("cuts"))


def blocked(rows: DataFrame, cuts: DataFrame, by: list[str], key: str) -> DataFrame:
    """``rows`` with their block of the walk-forward folds, by the ``cuts`` of their group (``fold_cuts``)."""
    return rows.join(F.broadcast(cuts), by).withColumn("block", F.size(F.filter("cuts", lambda c: c <= F.col(key)))).drop("cuts")


def _placed(counts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Adds the rows before each key of a group and the group's total; groups are few."""
    counts = written(counts)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return with_before(counts, by, [key], "n").join(totals, by)


def halves(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Per (group, time key): tuning for keys before which less than half of the rows lie, holdout for the rest."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    return _placed(counts, key, by).withColumn("half", F.when(2 * F.col("before") < F.col("total"), "tuning").otherwise("holdout")).drop("before", "total")
