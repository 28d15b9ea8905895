"""Trailing windows and as-of joins over irregular time.

There may be few keys (coins) and very long series, so partitioning by key alone would leave a handful of huge tasks.
Series are cut into (key, time bucket) groups.  Windows look back a bounded time, so each bucket also gets the rows of
that time before it (a halo), which are not given back; a task reads a bucket in order of time.  As-of joins may look back without
bound: the last row of all earlier buckets is carried into a bucket through a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship

#: Rows of a bucket that are taken up at once, at least; where more rows are held, an eighth of those.
SLICE = 20_000


def with_halo(df: DataFrame, time: str, lookback: int, apply: Callable[[dict[str, np.ndarray]], Callable[[int, int], dict[str, np.ndarray]]], columns: list[str], keep: list[str], schema: str, key: str = "coin", tie: str = "event_id", only: DataFrame | None = None) -> DataFrame:
    """Each row with its ``keep`` columns and those of ``apply``, which sees the rows of ``lookback`` before it too.

    ``apply`` gets ``columns`` of consecutive rows as arrays in order of time (then of ``tie``), and gives a function of
    the new columns of rows i to j.  A sliding frame in SQL is worked out anew for every row; arrays with running sums
    and binary search take n log n.  Spark sorts the buckets and a task reads them in order: it holds the arrays of
    ``lookback`` and of the rows just taken up, never a bucket.  With ``only`` (``tie``, each once) just those rows are given back.
    """
    first, last = F.floor(F.col(time) / lookback), F.floor((F.col(time) + lookback) / lookback)
    rows, few = df.select(*dict.fromkeys([key, time, tie, *columns, *keep])), only is not None
    if few:
        rows = rows.join(only.select(tie, F.lit(True).alias("__wanted")), tie, "left")
    spread = rows.withColumn("bucket", F.explode(F.sequence(first, last)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bucket), parts in groupby(_runs(batches, key), lambda x: x[0]):
            past = {c: np.empty(0, np.int64 if c == time else float) for c in {time, *columns}}
            for rows in _taken(parts, time, lambda: max(SLICE, len(past[time]) // 8)):
                held, at = len(past[time]), rows[time].to_numpy()
                arrays = {c: np.concatenate((past.pop(c), at if c == time else rows[c].to_numpy().astype(float))) for c in list(past)}
                i = int(np.searchsorted(arrays[time], bucket * lookback))
                end = held + len(at)
                of = apply(arrays) if i < end else None  # else all rows are of the halo
                size = max(SLICE, end // 16)
                for i in range(max(i, held), end, size):
                    j = min(i + size, end)
                    part = rows.slice(i - held, j - i).select(keep)
                    wanted = rows["__wanted"].slice(i - held, j - i) if few else None
                    if few and wanted.null_count == len(wanted):
                        continue
                    for c, x in of(i, j).items():
                        part = part.append_column(c, pa.array(x, from_pandas=True))
                    if few:
                        part = part.filter(wanted)
                    yield from part.combine_chunks().to_batches()
                del of
                low = int(np.searchsorted(arrays[time], at[-1] - lookback))
                past = {c: x[low:].copy() for c, x in arrays.items()}

    ship(df.sparkSession)
    return spread.repartition(key, "bucket").sortWithinPartitions(key, "bucket", time, tie).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((key, bucket), rows) of sorted batches, cut where either changes."""
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows + 1, bool)
        new[[0, -1]] = True
        for c in (b[key], b["bucket"]):
            new[1:-1] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(new).tolist()
        for i, j in zip(cuts, cuts[1:]):
            yield (b[key][i].as_py(), b["bucket"][i].as_py()), b.slice(i, j - i)


def _taken(parts: Iterator[tuple[tuple, pa.RecordBatch]], time: str, size: Callable[[], int]) -> Iterator[pa.Table]:
    """The rows of a bucket by ``size`` or a few more at a time, never parting rows of equal time."""
    waiting, n = [], 0
    for _, part in parts:
        waiting.append(part)
        n += part.num_rows
        if n >= size() and waiting[0][time][0] != part[time][-1]:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            at = rows[time].to_numpy()
            j = int(np.searchsorted(at, at[-1]))
            waiting, n = rows.take(pa.array(range(j, len(at)))).to_batches(), len(at) - j  # a copy: a slice would hold all rows
            yield rows.slice(0, j)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


class Series:
    """A value over sorted times, with what trailing frames of it need; missing values are left out."""

    def __init__(self, us: np.ndarray, value: np.ndarray, sums: bool = False) -> None:
        there = ~np.isnan(value)
        self.us, self.value = (us, value) if there.all() else (us[there], value[there])
        if sums:
            self.middle = self.value.mean() if len(self.value) else 0.0
            self.sums, self.squares = _running(self.value - self.middle), _running((self.value - self.middle) ** 2)

    def before(self, at: np.ndarray, horizon: int, tolerance: int) -> np.ndarray:
        """The newest value at or before ``horizon`` ago, if no more than ``tolerance`` older."""
        i = np.searchsorted(self.us, at - horizon, "right") - 1
        out = np.full(len(at), np.nan)
        ok = i >= 0
        ok[ok] = self.us[i[ok]] >= at[ok] - horizon - tolerance
        out[ok] = self.value[i[ok]]
        return out

    def trailing(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Over (t - window, t]: number, mean, sample deviation and first time; nan or -1 where there is none."""
        a, b = np.searchsorted(self.us, at - window, "right"), np.searchsorted(self.us, at, "right")
        n = b - a
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = (self.sums[b] - self.sums[a]) / n
            deviation = np.sqrt(np.maximum(self.squares[b] - self.squares[a] - n * mean**2, 0) / (n - 1))
        begun = np.where(n > 0, self.us[np.minimum(a, len(self.us) - 1)], -1) if len(self.us) else np.full(len(n), -1)
        return n, mean + self.middle, deviation, begun


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(x)))


class Volatility:
    """Realized volatility over trailing frames of sorted times: squared log returns and gaps wider than ``gap``, summed up."""

    def __init__(self, us: np.ndarray, value: np.ndarray, gap: int) -> None:
        self.us = us
        step = np.diff(np.log(value), prepend=np.log(value[:1])) if len(value) else value
        self.sums = _running(np.square(step, out=step))
        self.wide = np.concatenate(([0], np.cumsum(np.diff(us, prepend=us[:1]) > gap, dtype=np.int32)), dtype=np.int32)

    def over(self, at: np.ndarray, window: int, least_n: int, least_span: int, second: int) -> np.ndarray:
        """Bps per square root of a minute over [t - window, t]; the first point's own return reaches out of it and is left out."""
        us, sums, wide = self.us, self.sums, self.wide
        a, b = np.searchsorted(us, at - window, "left"), np.searchsorted(us, at, "right")
        span, after = at - us[a] if len(us) else at, np.minimum(a + 1, len(us))
        enough = (b - a >= least_n) & (span >= least_span) & (span > 0) & (wide[b] == wide[after])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(enough, np.sqrt(np.maximum(sums[b] - sums[after], 0) * 60 * second / span) * 10000, np.nan)


class _Frames(BaseIndexer):
    """Frames of pandas given by their bounds."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):  # noqa: ANN001, ANN201
        return self.first, self.end


def rolling_median(value: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Medians of ``value`` from ``first`` to before ``end``, both rising; nan for nothing."""
    low = int(first[0])
    values, more = value[low : int(end[-1])], int(end[-1]) - low - len(first)
    # pandas wants a frame for each value: empty ones before, and values of no frame after
    first, end = (np.concatenate((np.zeros(max(more, 0), np.int64), x - low)) for x in (first, end))
    values = np.concatenate((values, np.zeros(max(-more, 0))))
    return pd.Series(values).rolling(_Frames(first=first, end=end), min_periods=1).median().to_numpy()[max(more, 0) :]


def asof(left: DataFrame, right: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """Each left row with ``match``: the newest right row (as a struct) of its key at or before it; null if none."""
    bucket = F.floor(F.col(time) / width).alias("bucket")
    rows = F.struct(*[F.col(c) for c in right.columns])
    l = left.select(key, F.col(time).alias("__t"), bucket, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    r = right.select(key, F.col(time).alias("__t"), bucket, F.lit(0).alias("__side"), rows.alias("__r"))
    newest = r.groupBy(key, "bucket").agg(F.max_by("__r", "__t").alias("__last"))
    # one row per bucket
    buckets = l.select(key, "bucket").union(r.select(key, "bucket")).distinct().join(newest, [key, "bucket"], "left")
    earlier = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(key, "bucket", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key, "bucket").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return found.join(carried, [key, "bucket"], "left").select("__l.*", F.coalesce("__m", "__carried").alias("match"))
