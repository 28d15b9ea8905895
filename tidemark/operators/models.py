"""Nested logistic and linear screens with walk-forward folds, and bootstraps.

Fits are distributed.  Every pass of Newton's method sums gradients and Hessians for all models at once, first within each
task; what reaches the driver is one short row per model, however many rows there are.  Bootstraps weight clusters
by Poisson draws from a seeded hash, which needs no cluster list in one place and gives the same draws anywhere; that is
statistically equivalent to drawing clusters with replacement, not draw for draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark import config as C
from tidemark.functions.market import clamp_p
from tidemark.operators import metrics as X
from tidemark.operators import scans
from tidemark.shipping import ship
from tidemark.storage import written

#: Replicates of a bootstrap, clusters whose draws are held at once, and groups whose sums are.
REPS, DRAWN, GROUPS = 1000, 1000, 200


class Singular(ValueError):
    """A design whose normal equations have no unique solution."""


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; raises where a pivot vanishes against the scale of the matrix."""
    scale = float(np.abs(a).max()) if a.size else 0.0
    if not np.isfinite(a).all() or scale == 0 or np.linalg.svd(a, compute_uv=False)[-1] <= 1e-12 * scale:
        raise Singular("singular normal equations")
    return np.linalg.solve(a, b)


def fit_scalers(train: DataFrame, by: list[str], columns: list[str], least: int = C.MIN_COIN_ROWS) -> DataFrame:
    """Per group and column: 1st and 99th percentile, then mean and population deviation of the clipped values."""
    train = written(train)
    sizes = train.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    cuts = scans.percentiles(train.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)), by, columns, (0.01, 0.99))
    bounds = cuts.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"b_{c}") for c in columns]).join(sizes, by)
    rows = train.join(bounds, by)
    clipped = {c: F.greatest(F.col(f"b_{c}")[0], F.least(F.col(f"b_{c}")[1], F.col(c))) for c in columns}
    out = rows.groupBy(*by).agg(*[F.struct(F.min(F.col(f"b_{c}")[0]).alias("low"), F.max(F.col(f"b_{c}")[1]).alias("high"), F.avg(clipped[c]).alias("mean"), F.stddev_pop(clipped[c]).alias("sd")).alias(f"s_{c}") for c in columns])
    return out.where(F.least(*[F.col(f"s_{c}.sd") for c in columns], F.lit(1.0)) > C.ZERO_VARIANCE)


def standardized(column: str) -> Column:
    s = f"s_{column}"
    return (F.greatest(F.col(f"{s}.low"), F.least(F.col(f"{s}.high"), F.col(column))) - F.col(f"{s}.mean")) / F.col(f"{s}.sd")


def linear_of(beta: str, names: list[str]) -> Column:
    return sum((F.col(beta)[i + 1] * F.col(c) for i, c in enumerate(names)), F.col(beta)[0])


def _sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def _newton(keys: list[tuple], models: dict[str, int], sums: Callable[[dict], dict], ridge: float, steps: int, tolerance: float) -> dict[tuple, dict[str, np.ndarray]]:
    """Newton fits of several models (name: number of coefficients, the intercept first) for each key.

    ``sums`` gives for the live keys' coefficients the loss, gradient and Hessian of each model without the ridge; keys that
    it leaves out have no fit.  Slopes carry a ridge.  A step that does not lower the loss is halved, which counts as no step
    of its own.  Keys with a fit that is singular or has not converged after ``steps`` steps are left out.
    """
    state = {(k, m): {"beta": np.zeros(n), "loss": np.inf, "step": None, "done": False, "failed": False, "taken": 0} for k in keys for m, n in models.items()}
    while live := {k for (k, _), s in state.items() if not s["done"]}:
        found = sums({k: {m: state[k, m]["beta"] for m in models} for k in live})
        for k in live:
            for m, n in models.items():
                s = state[k, m]
                if k not in found:
                    s["done"] = s["failed"] = True
                if s["done"]:
                    continue
                loss, g, h = found[k][m]
                penalty = np.full(n, ridge)
                penalty[0] = 0
                loss = loss + 0.5 * float((penalty * s["beta"] ** 2).sum())
                if loss > s["loss"] + 1e-12 and np.abs(s["step"]).max() > 1e-8:
                    s["step"] = s["step"] / 2
                    s["beta"] = s["beta"] - s["step"]
                    continue
                try:
                    s["step"] = solve(h + np.diag(penalty), g - penalty * s["beta"])
                    s["taken"] += 1
                    if s["taken"] > steps:
                        raise Singular("no convergence")
                except Singular:
                    s["done"] = s["failed"] = True
                    continue
                s["loss"], s["beta"] = loss, s["beta"] + s["step"]
                s["done"] = bool(np.abs(s["step"]).max() < tolerance)
    failed = {k for (k, _), s in state.items() if s["failed"]}
    return {k: {m: state[k, m]["beta"] for m in models} for k in keys if k not in failed}


def logistic_fits(rows: DataFrame, by: list[str], models: dict[str, list[str]], y: str = "y", ridge: float = C.RIDGE, steps: int = C.MAX_STEPS, tolerance: float = C.STEP_TOLERANCE) -> dict[tuple, dict[str, np.ndarray]]:
    """Newton fits of several models (name: columns besides the intercept) over the rows of each group; see ``_newton``."""
    keys = [tuple(r) for r in rows.select(*by).distinct().collect()]

    def sums(live: dict) -> dict:
        betas = coefficients(rows, live, by, list(models))
        joined = rows.join(F.broadcast(betas), by)  # one row for each group
        joined = joined.withColumns({f"z_{m}": linear_of(f"beta_{m}", x) for m, x in models.items()})
        joined = joined.withColumns({f"p_{m}": _sigmoid(F.col(f"z_{m}")) for m in models})
        joined = joined.withColumns({f"w_{m}": F.greatest(F.col(f"p_{m}") * (1 - F.col(f"p_{m}")), F.lit(1e-12)) for m in models})
        aggregates = []
        for m, x in models.items():
            z, columns = F.col(f"z_{m}"), [F.lit(1.0), *map(F.col, x)]
            aggregates.append(F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col(y) * z).alias(f"l_{m}"))
            aggregates += [F.sum((F.col(y) - F.col(f"p_{m}")) * c).alias(f"g_{m}_{i}") for i, c in enumerate(columns)]
            aggregates += [F.sum(F.col(f"w_{m}") * columns[i] * columns[j]).alias(f"h_{m}_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
        found = {}
        for r in joined.groupBy(*by).agg(*aggregates).collect():
            of = found[tuple(r[c] for c in by)] = {}
            for m, x in models.items():
                n = len(x) + 1
                h = np.array([[r[f"h_{m}_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                of[m] = r[f"l_{m}"], np.array([r[f"g_{m}_{i}"] for i in range(n)]), h
        return found

    return _newton(keys, {m: len(x) + 1 for m, x in models.items()}, sums, ridge, steps, tolerance)


def linear_fits(rows: DataFrame, by: list[str], models: dict[str, list[str]], y: str = "y") -> dict[tuple, dict[str, np.ndarray]]:
    """Ordinary least squares of nested models (each a beginning of the longest) by sums of products, in one pass."""
    longest = max(models.values(), key=len)
    x, n = [F.lit(1.0), *map(F.col, longest)], len(longest) + 1
    sums = [F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(x[i] * F.col(y)).alias(f"b_{i}") for i in range(n)]
    out = {}
    for r in rows.groupBy(*by).agg(*sums).collect():
        a = np.array([[r[f"a_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
        b = np.array([r[f"b_{i}"] for i in range(n)], float)
        try:
            out[tuple(r[c] for c in by)] = {m: solve(a[: len(k) + 1, : len(k) + 1], b[: len(k) + 1]) for m, k in models.items()}
        except Singular:
            continue
    return out


def coefficients(rows: DataFrame, fits: dict[tuple, dict[str, np.ndarray]], by: list[str], models: list[str]) -> DataFrame:
    """Fits as rows (by, beta_m ...)."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.sparkSession.createDataFrame([(*k, *[v[m].tolist() for m in models]) for k, v in fits.items()], kinds + "".join(f", beta_{m} array<double>" for m in models))


def fold_rows(rows: DataFrame, by: list[str], key: str = "close_us") -> DataFrame:
    """Each row once as test of its own fold and once as training row of every later fold."""
    placed = X.blocked(rows, X.fold_cuts(rows.groupBy(*by, key).agg(F.count("*").alias("n")), key, by), by, key)
    last = len(C.FOLD_BOUNDS) - 1
    as_test = F.when(F.col("block") > 0, F.array(F.struct(F.col("block").alias("fold"), F.lit(True).alias("is_test"))))
    as_train = F.when(F.col("block") < last, F.transform(F.sequence(F.col("block") + 1, F.lit(last)), lambda f: F.struct(f.alias("fold"), F.lit(False).alias("is_test"))))
    both = F.concat(F.coalesce(as_test, F.array().cast("array<struct<fold: int, is_test: boolean>>")), F.coalesce(as_train, F.array().cast("array<struct<fold: int, is_test: boolean>>")))
    return placed.withColumn("__fold", F.explode(both)).select("*", "__fold.*").drop("__fold", "block")


#: Model A holds the base forecast, B adds the control, C the feature and, for reliability features, its product with the base.
NESTED = {"a": ["base_logit"], "b": ["base_logit", "zc"], "c": ["base_logit", "zc", "zf", "zp"]}
#: Of an interaction: B holds base, control, feature, modifier and control x modifier, C the product of feature and modifier too.
CROSSED = {"b": ["base_logit", "zc", "zf", "zm", "zcm"], "c": ["base_logit", "zc", "zf", "zm", "zcm", "zfm"]}
#: Rows that a task fits or predicts at once.
CHUNK = 200_000


class Placed(NamedTuple):
    """Rows in the blocks of the walk-forward folds, once each, with what standardises them.

    ``rows``: cell, block, ticker, y, base_logit, reliability and v0, v1, ... (control, feature, modifier).  A cell is a coin
    of a group; ``cells`` has the group's key (by, reliability) of each, ``scalers`` per cell, fold and column the clipping
    bounds, mean and deviation by the training rows of the fold.  Groups and coins are few.
    """

    rows: DataFrame
    by: list[str]
    key_types: dict[str, str]
    cells: dict[int, tuple]
    reliable: dict[tuple, bool]
    scalers: dict[tuple[int, int], np.ndarray]


def placed(rows: DataFrame, by: list[str], columns: list[str], reliability: Column | None = None) -> Placed:
    """Rows that have all ``columns`` and a base, laid out for the folds.

    A row is written once, not once for each fold that it trains.  Scalers come from counted values: a fold's counts are
    those of the blocks before it.
    """
    kind = F.lit(False) if reliability is None else reliability
    values = [f"v{i}" for i in range(len(columns))]
    ready = rows.dropna(subset=[*columns, "base_logit"]).select(*by, "coin", "close_us", "ticker", F.col("up").cast("double").alias("y"), "base_logit", F.coalesce(kind, F.lit(False)).alias("reliability"), *(F.col(c).cast("double").alias(v) for c, v in zip(columns, values)))
    counts = written(ready.groupBy(*by, "coin", "close_us").agg(F.count("*").alias("n"), F.max("reliability").alias("reliability")))
    cuts = X.fold_cuts(counts.groupBy(*by, "close_us").agg(F.sum("n").alias("n")), "close_us", by)
    found = counts.groupBy(*by, "coin").agg(F.max("reliability").alias("reliability")).dropna(subset=[*by, "coin"]).join(cuts, by).collect()
    found.sort(key=lambda r: [str(r[c]) for c in (*by, "coin")])
    cells = {i: tuple(r[c] for c in by) for i, r in enumerate(found)}
    reliable: dict[tuple, bool] = {}
    for i, r in enumerate(found):
        reliable[cells[i]] = reliable.get(cells[i], False) or r["reliability"]
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in (*by, "coin"))
    table = rows.sparkSession.createDataFrame([(*cells[i], r["coin"], i, r["cuts"]) for i, r in enumerate(found)], f"{kinds}cell int, cuts array<long>")
    base = written(X.blocked(ready, table, [*by, "coin"], "close_us").select("cell", "block", "ticker", "y", "base_logit", "reliability", *values))
    return Placed(base, by, {c: rows.schema[c].dataType.simpleString() for c in by}, cells, reliable, _scalers(base, values))


def _scalers(base: DataFrame, values: list[str], least: int = C.MIN_COIN_ROWS) -> dict[tuple[int, int], np.ndarray]:
    """{(cell, fold): low, high, mean and deviation of each column}, as ``fit_scalers`` of the training rows gives them."""
    last, key = len(C.FOLD_BOUNDS) - 1, ["cell", "fold", "column"]
    one = base.where(F.col("block") < last).unpivot(["cell", "block"], values, "column", "value").groupBy("cell", "block", "column", "value").agg(F.count("*").alias("__n"))
    folds = written(one).withColumn("fold", F.explode(F.sequence(F.col("block") + 1, F.lit(last))))
    counts = written(folds.groupBy(*key, "value").agg(F.sum("__n").alias("__n")))
    bounds = scans.counted_percentiles(counts, key, (0.01, 0.99)).where(F.col("n") >= least)
    low, high, n = F.col("q")[0], F.col("q")[1], F.col("__n")
    # from the lower bound on, so that a constant has no deviation at all
    above = F.greatest(low, F.least(high, F.col("value"))) - low
    rows = counts.join(F.broadcast(bounds), key).groupBy(*key).agg(F.min(low).alias("low"), F.max(high).alias("high"), (F.sum(above * n) / F.sum(n)).alias("mean"), (F.sum(above * above * n) / F.sum(n)).alias("square")).collect()
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        sd = float(np.sqrt(max(r["square"] - r["mean"] ** 2, 0.0)))
        out.setdefault((r["cell"], r["fold"]), np.full((len(values), 4), np.nan))[values.index(r["column"])] = r["low"], r["high"], r["low"] + r["mean"], sd
    return {k: s for k, s in out.items() if (s[:, 3] > C.ZERO_VARIANCE).all()}


def crossed_design(rows: DataFrame, by: list[str], control: str, feature: str, modifier: str) -> DataFrame:
    """Rows of the models of an interaction, as the fits see them: once for each fold that a row trains or tests."""
    design = placed(rows, by, [control, feature, modifier])
    spark, names = rows.sparkSession, ("c", "f", "m")
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    table = spark.createDataFrame([(*design.cells[i], i, f, *map(float, s.ravel())) for (i, f), s in design.scalers.items()], f"{kinds}cell int, fold int" + "".join(f", {k}{n} double" for n in names for k in ("low", "high", "mean", "sd")))
    folds = design.rows.join(F.broadcast(table), "cell").where(F.col("block") <= F.col("fold")).withColumn("is_test", F.col("block") == F.col("fold"))
    z = {f"z{n}": (F.greatest(F.col(f"low{n}"), F.least(F.col(f"high{n}"), F.col(f"v{i}"))) - F.col(f"mean{n}")) / F.col(f"sd{n}") for i, n in enumerate(names)}
    return folds.select(*by, "fold", "is_test", "ticker", "y", "base_logit", *(c.alias(n) for n, c in z.items())).withColumns({"zcm": F.col("zc") * F.col("zm"), "zfm": F.col("zf") * F.col("zm")})


def _columns(base: np.ndarray, values: np.ndarray, reliable: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Intercept and columns of the longest model: of an interaction, if there is a modifier."""
    z = [(np.clip(v, low, high) - mean) / sd for v, (low, high, mean, sd) in zip(values, s)]
    more = [z[1] * base * reliable] if len(z) == 2 else [z[0] * z[2], z[1] * z[2]]
    return np.column_stack([np.ones(len(base)), base, *z, *more])


def _chunks(batches: Iterator[pa.RecordBatch], n_values: int) -> Iterator[tuple]:
    """(table, order, bounds of each cell's blocks, cell numbers, columns) of about CHUNK rows, ordered by cell and block."""

    def whole(held: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(held)
        cell, block = table["cell"].to_numpy().astype(np.int64), table["block"].to_numpy()
        width = len(C.FOLD_BOUNDS)
        place = cell * width + block
        order = np.argsort(place, kind="stable")
        place = place[order]
        ids = np.unique(cell)
        ends = np.searchsorted(place, (ids[:, None] * width + np.arange(width + 1)))
        column = lambda c: table[c].to_numpy(zero_copy_only=False).astype(float)[order]
        return table, order, ids, ends, column("y"), column("base_logit"), column("reliability"), [column(f"v{i}") for i in range(n_values)]

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield whole(held)
            held, n = [], 0
    if n:
        yield whole(held)


def _probability(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


def _pieces(design: np.ndarray, y: np.ndarray, betas: list[np.ndarray]) -> np.ndarray:
    """Rows, ones, then of each model (a beginning of the longest one) its loss, gradient and Hessian."""
    out = [[len(y), y.sum()]]
    for beta in betas:
        d = design[:, : len(beta)]
        z = d @ beta
        p = _probability(z)
        w = np.maximum(p * (1 - p), 1e-12)
        out += [[(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z).sum()], d.T @ (y - p), (d.T @ (d * w[:, None])).ravel()]
    return np.concatenate(out)


def out_of_fold(design: Placed, models: dict[str, list[str]] = NESTED) -> tuple[DataFrame, DataFrame]:
    """(predictions of test rows by each model, pa, pb and so on; coefficients of each fold's models).

    Every pass of the fits reads each row once and standardises it for all folds that it trains.
    """
    by, cells, scalers, n_values = design.by, design.cells, design.scalers, len(next(iter(design.scalers.values()), ()))
    spark, last, sizes = design.rows.sparkSession, len(C.FOLD_BOUNDS) - 1, {m: len(x) + 1 for m, x in models.items()}
    ship(spark)
    groups = {k: g for g, k in enumerate(dict.fromkeys(cells.values()))}
    length = 2 + sum(1 + n + n * n for n in sizes.values())

    def sums(live: dict) -> dict:
        betas = {k: [of[m] for m in models] for k, of in live.items()}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            for _, _, ids, ends, y, base, reliable, values in _chunks(batches, n_values):
                for i, at in zip(ids.tolist(), ends.tolist()):
                    for fold in range(1, last + 1):
                        a, b, k = at[0], at[fold], (groups[cells[i]], fold)
                        if a < b and k in betas and (i, fold) in scalers:
                            d = _columns(base[a:b], [v[a:b] for v in values], reliable[a:b], scalers[i, fold])
                            total[k] = total.get(k, 0) + _pieces(d, y[a:b], betas[k])
            if total:
                yield pa.RecordBatch.from_pydict({"grp": pa.array([k[0] for k in total], pa.int32()), "fold": pa.array([k[1] for k in total], pa.int32()), "v": pa.array([v.tolist() for v in total.values()])})

        parts = design.rows.where(F.col("block") < last).drop("ticker").mapInArrow(work, "grp int, fold int, v array<double>")
        found = {}
        for r in parts.groupBy("grp", "fold").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(length))).alias("v")).collect():
            v, at, of = np.array(r["v"]), 2, {}
            if v[0] < C.MIN_TRAIN or not 0 < v[1] < v[0]:
                continue
            for m, n in sizes.items():
                of[m] = v[at], v[at + 1 : at + 1 + n], v[at + 1 + n : at + 1 + n + n * n].reshape(n, n)
                at += 1 + n + n * n
            found[r["grp"], r["fold"]] = of
        return found

    keys = list(dict.fromkeys((groups[cells[i]], fold) for i, fold in scalers))
    fits = _newton(keys, sizes, sums, C.RIDGE, C.MAX_STEPS, C.STEP_TOLERANCE)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, order, ids, ends, y, base, reliable, values in _chunks(batches, n_values):
            tickers = table["ticker"].combine_chunks()
            for i, at in zip(ids.tolist(), ends.tolist()):
                for fold in range(1, last + 1):
                    a, b, k = at[fold], at[fold + 1], (groups[cells[i]], fold)
                    if a < b and k in fits and (i, fold) in scalers:
                        d = _columns(base[a:b], [v[a:b] for v in values], reliable[a:b], scalers[i, fold])
                        p = {f"p{m}": _probability(d[:, :n] @ fits[k][m]) for m, n in sizes.items()}
                        yield pa.RecordBatch.from_pydict({"grp": pa.array(np.full(b - a, k[0], np.int32)), "fold": pa.array(np.full(b - a, fold, np.int32)), "ticker": tickers.take(pa.array(order[a:b])), "y": pa.array(y[a:b]), **{c: pa.array(x) for c, x in p.items()}})

    kind = design.rows.schema["ticker"].dataType.simpleString()
    kinds = design.key_types
    names = spark.createDataFrame([(g, *k) for k, g in groups.items()], "__group int" + "".join(f", `{c}` {kinds[c]}" for c in by))
    drawn = design.rows.where("block > 0").mapInArrow(predict, f"grp int, fold int, ticker {kind}, y double" + "".join(f", p{m} double" for m in models)).withColumnRenamed("grp", "__group")
    test = drawn.join(F.broadcast(names), "__group").select(*by, "fold", "ticker", "y", *(f"p{m}" for m in models))
    back = {g: k for k, g in groups.items()}
    betas = spark.createDataFrame([(*back[g], fold, *(of[m].tolist() for m in models)) for (g, fold), of in fits.items()], "".join(f"`{c}` {kinds[c]}, " for c in by) + "fold int" + "".join(f", beta_{m} array<double>" for m in models))
    return test, betas


#: Modulus and multiplier of the minimal standard generator (fixed values).
PRIME, FACTOR = 2147483647, 48271


def poisson_weight(seed: int, cluster: Column, rep: Column) -> Column:
    """A Poisson(1) draw seeded by cluster and replicate, in whole-number arithmetic that any engine repeats."""
    h = ((cluster % 1000003) * 7919 + rep * 104729 + seed) % PRIME
    h = (h * FACTOR + rep * 16807) % PRIME
    h = (h * h + cluster % 65537) % PRIME
    u = (h * FACTOR) % PRIME / float(PRIME)
    below, total, term = [], 0.0, float(np.exp(-1))
    for k in range(1, 12):
        total += term
        below.append(total)
        term /= k
    # the number of values of the distribution function that the draw passes; the array holds the draw once
    passed = lambda v: F.size(F.filter(F.array(*map(F.lit, below)), lambda x: x <= v))
    return F.transform(F.array(u), passed)[0]


def _fold(x: np.ndarray, times: int) -> np.ndarray:
    """``x`` in place to what is equal modulo PRIME, which is 2**31 - 1: high and low halves add up."""
    for _ in range(times):
        high = x >> 31
        x &= PRIME
        x += high
    return x


def _marks() -> list[int]:
    """The smallest whole numbers that, over PRIME, pass each value of the Poisson distribution function."""
    marks, total, term = [], 0.0, float(np.exp(-1))
    for k in range(1, 12):
        total += term
        m = int(total * PRIME) - 2
        while m / float(PRIME) < total:
            m += 1
        marks.append(m)
        term /= k
    return marks


def _poisson_weights(seed: int, cluster: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The same draws in numpy (clusters not below 0)."""
    h = _fold(((cluster % 1000003) * 7919 + seed) % PRIME + rep * 104729, 1)
    h *= FACTOR
    h += rep * 16807
    _fold(h, 2)[h == PRIME] = 0
    h *= h
    h += cluster % 65537
    _fold(h, 2)
    h *= FACTOR
    _fold(h, 2)[h == PRIME] = 0
    marks = _marks()
    out = np.zeros(h.shape, np.uint8)
    for m in marks[:4]:
        out += (h >= m).view(np.uint8)
    rare = h >= marks[4]
    out[rare] = np.searchsorted(marks, h[rare], side="right")
    return out


def by_cluster(rows: DataFrame, cluster: str) -> DataFrame:
    """``rows`` dealt out by cluster, so that sums by cluster need no other shuffle and each draw is made in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), cluster)


def resampled(sums: DataFrame, by: list[str], cluster: str, values: list[str], seed: int, reps: int) -> DataFrame:
    """(by, rep, values): the cluster sums weighted by each replicate's draws.

    ``sums`` come from ``by_cluster``.  Each task draws once for each of its clusters, whatever the number of groups that
    share it, and adds up all replicates, so that one row per group and task moves, however many draws.
    """
    ship(sums.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        rep = np.arange(1, reps + 1, dtype=np.int64)

        def add(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            ids, place = np.unique(table[cluster].to_numpy(), return_inverse=True)
            x = np.array([table[c].to_numpy(zero_copy_only=False).astype(float) for c in values])
            coded = table.select(by).append_column("__at", pa.array(np.arange(len(table)))).group_by(by, use_threads=False).aggregate([("__at", "list")])
            keys, members = list(zip(*(coded[c].to_pylist() for c in by))), coded["__at_list"].combine_chunks()
            group = np.empty(len(table), np.int64)
            group[members.values.to_numpy()] = np.repeat(np.arange(len(keys)), np.diff(members.offsets.to_numpy()))
            for i in range(0, len(ids), DRAWN):
                n = min(DRAWN, len(ids) - i)
                w = np.empty((n, reps))
                # a few clusters at a time, so that what is drawn stays in the processor's cache
                for j in range(0, n, 16):
                    w[j : j + 16] = _poisson_weights(seed, ids[i + j : i + min(j + 16, n), None], rep)
                inside = np.nonzero((place >= i) & (place < i + n))[0]
                inside = inside[np.argsort(group[inside], kind="stable")]
                for g in range(0, len(keys), GROUPS):
                    own = inside[slice(*np.searchsorted(group[inside], (g, g + GROUPS)))]
                    at, m = (group[own] - g) * n + place[own] - i, min(GROUPS, len(keys) - g)
                    found = np.array([np.bincount(at, v[own], m * n).reshape(m, n) @ w for v in x])
                    for k, s in zip(keys[g : g + m], found.swapaxes(0, 1)):
                        total[k] = total[k] + s if k in total else s

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK // 10:
                add(held)
                held, n = [], 0
        if n:
            add(held)
        if total:
            keys = {c: pa.array([k[i] for k in total], schema.field(c).type) for i, c in enumerate(by)}
            yield pa.RecordBatch.from_pydict(keys | {c: pa.array([v[i].tolist() for v in total.values()]) for i, c in enumerate(values)})

    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by)
    schema = to_arrow_schema(sums.select(*by).schema)
    ordered = sums.select(*by, cluster, *values).sortWithinPartitions(cluster)
    drawn = ordered.mapInArrow(work, kinds + "".join(f", `{c}` array<double>" for c in values))
    each = drawn.select(*by, F.posexplode(F.arrays_zip(*values)).alias("rep", "v")).groupBy(*by, "rep")
    return each.agg(*(F.sum(f"v.{c}").alias(c) for c in values))


def cluster_bootstrap(rows: DataFrame, by: list[str], cluster: str, value: str, seed: int, reps: int = REPS) -> DataFrame:
    """Per group: mean of ``value``, its 95 % interval over resampled clusters and the one-sided p that it is not above 0.

    Replicates that draw no cluster of a group are left out.
    """
    sums = written(by_cluster(rows.select(*by, cluster, value), cluster).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")))
    stats = resampled(sums, by, cluster, ["s", "n"], seed, reps).where("n > 0").withColumn("v", F.col("s") / F.col("n"))
    ends = stats.groupBy(*by).agg(F.percentile("v", 0.025).alias("ci_low"), F.percentile("v", 0.975).alias("ci_high"), ((F.count_if(F.col("v") <= 0) + 1) / (F.count("*") + 1.0)).alias("p_value"))
    means = sums.groupBy(*by).agg(F.count("*").alias("clusters"), (F.sum("s") / F.sum("n")).alias("mean"))
    return means.join(ends, by)


def screen(rows: DataFrame, by: list[str], control: str, feature: str, reliability: Column, reps: int = REPS) -> DataFrame:
    """One row per group: what the feature adds out of fold to base and control, with signs, interval and p-value.

    Several features can be screened at once: unpivot them and name the feature column in ``by``.
    """
    design = placed(rows, by, [control, feature], reliability)
    oof, betas = out_of_fold(design)
    oof = written(oof)
    y, ll = F.col("y"), lambda p: -(F.col("y") * F.log(clamp_p(p)) + (1 - F.col("y")) * F.log(1 - clamp_p(p)))
    m = oof.groupBy(*by).agg(
        F.count("*").alias("oof_n"), *[F.avg((F.col(f"p{k}") - y) ** 2).alias(f"brier_{k}") for k in "abc"], *[F.avg(ll(F.col(f"p{k}"))).alias(f"logloss_{k}") for k in "abc"],
    )
    gain = oof.withColumn("gain", (F.col("pb") - y) ** 2 - (F.col("pc") - y) ** 2)
    boot = cluster_bootstrap(gain, by, "ticker", "gain", C.SEED, reps).drop("mean")
    kinds = rows.sparkSession.createDataFrame([(*k, v) for k, v in design.reliable.items()], "".join(f"`{c}` {k}, " for c, k in design.key_types.items()) + "reliability boolean")
    gamma = F.when(F.col("reliability"), F.col("beta_c")[4]).otherwise(F.col("beta_c")[3])
    signs = betas.join(kinds, by).groupBy(*by).agg(F.count("*").alias("valid_folds"), F.count_if(gamma > C.ZERO_VARIANCE).alias("positive"), F.count_if(gamma < -C.ZERO_VARIANCE).alias("negative"))
    out = m.join(boot, by).join(signs, by)
    consistency = 100 * F.greatest("positive", "negative") / F.col("valid_folds")
    return out.select(
        *by, "oof_n", "clusters", "valid_folds", (F.col("brier_b") - F.col("brier_c")).alias("brier_gain"), (F.col("logloss_b") - F.col("logloss_c")).alias("logloss_gain"),
        (F.col("brier_a") - F.col("brier_c")).alias("brier_gain_a"), "ci_low", "ci_high", "p_value", consistency.alias("sign_pct"),
    )


def _losses(y: Column, p: Column) -> Column:
    return -(y * F.log(clamp_p(p)) + (1 - y) * F.log(1 - clamp_p(p)))


def screen_interaction(rows: DataFrame, by: list[str], control: str, feature: str, modifier: str, reps: int = REPS) -> DataFrame:
    """One row per group: what the product of feature and modifier adds out of fold to both main effects and control x modifier.

    Several pairs can be screened at once: unpivot them and name the pair in ``by``.
    """
    oof, betas = out_of_fold(placed(rows, by, [control, feature, modifier]), CROSSED)
    oof, y = written(oof), F.col("y")
    pb, pc = F.col("pb"), F.col("pc")
    m = oof.groupBy(*by).agg(F.count("*").alias("oof_n"), F.avg((pb - y) ** 2 - (pc - y) ** 2).alias("brier_gain"), F.avg(_losses(y, pb) - _losses(y, pc)).alias("logloss_gain"))
    boot = cluster_bootstrap(oof.withColumn("gain", (pb - y) ** 2 - (pc - y) ** 2), by, "ticker", "gain", C.SEED, reps).drop("mean")
    gamma = F.col("beta_c")[6]
    signs = betas.groupBy(*by).agg(F.count("*").alias("valid_folds"), F.count_if(gamma > C.ZERO_VARIANCE).alias("positive"), F.count_if(gamma < -C.ZERO_VARIANCE).alias("negative"))
    out = m.join(boot, by).join(signs, by)
    return out.select(*by, "oof_n", "clusters", "valid_folds", "brier_gain", "logloss_gain", "ci_low", "ci_high", "p_value", (100 * F.greatest("positive", "negative") / F.col("valid_folds")).alias("sign_pct"))


def classify(screened: DataFrame, by: list[str], least: int = 200, q_max: float = 0.05, sign_pct: float = 75) -> DataFrame:
    """Corrects p-values within each group and names each result's status."""
    q = X.bh_qvalues(screened, by)
    better = (F.col("brier_gain") > 0) & (F.col("logloss_gain") > 0) & (F.col("ci_low") > 0) & (F.col("q_value") <= q_max)
    steady = F.col("sign_pct") >= sign_pct
    status = (
        F.when((F.col("oof_n") < least) | (F.col("valid_folds") == 0), "INSUFFICIENT").when(better & steady & (F.col("valid_folds") >= 3), "CANDIDATE").when(~steady & (F.col("brier_gain") > 0), "UNSTABLE").otherwise("NO_VALUE")
    )
    return q.withColumn("status", status)
