"""Sequential rules over long ordered groups, cut into buckets: linear recurrences, greedy thinning, runs of a flag, order statistics.

There may be a handful of groups with very many rows each.  Rows are numbered by range sums (``ordered``) and cut into
buckets of BUCKET rows.  What a bucket does to a state that enters it is worked out for each bucket on its own and is a
row or a few; those rows are composed by doubling (a join a doubling, on the group and the bucket), so no task sees more
than a bucket and the number of steps is the logarithm of the number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.shipping import ship
from tidemark.storage import written


def affine_prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) of the maps x -> A x + B that the first 1, 2, ... steps x -> a x + b make together; ``b`` may have several rows."""
    a, b, s = a.astype(float).copy(), b.astype(float).copy(), 1
    while s < len(a):
        b[..., s:] = a[s:] * b[..., :-s] + b[..., s:]
        a[s:] = a[s:] * a[:-s]
        s *= 2
    return a, b


def _entering(maps: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, bucket, names): the state 0 after all buckets before each one; ``maps`` (by, bucket, a, names) has every bucket from 0 on."""
    state, reach = written(maps), 1
    last = state.agg(F.max("bucket")).first()[0] or 0
    while reach <= last:
        before = state.select(*by, (F.col("bucket") + reach).alias("bucket"), F.col("a").alias("__a"), *(F.col(x).alias(f"__{x}") for x in names))
        both = state.join(before, [*by, "bucket"], "left")
        values = {x: F.when(F.col("__a").isNull(), F.col(x)).otherwise(F.col("a") * F.col(f"__{x}") + F.col(x)) for x in names}
        state = written(both.select(*by, "bucket", (F.col("a") * F.coalesce("__a", F.lit(1.0))).alias("a"), *(v.alias(x) for x, v in values.items())))
        reach *= 2
    return state.select(*by, (F.col("bucket") + 1).alias("bucket"), *names)


def linear_scan(rows: DataFrame, by: list[str], a: str, values: list[str], bucket: str = "bucket", i: str = "i") -> DataFrame:
    """``rows`` with each of ``values`` (b) replaced by the recurrence x = a x + b over the rows of a group in the order of ``i``, from 0.

    Rows are numbered and in buckets without a halo, from bucket 0 on without a gap; other columns stay.
    """
    ship(rows.sparkSession)
    kinds, names = {f.name: f.dataType.simpleString() for f in rows.schema.fields}, rows.columns

    def steps(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.sort_by(i)
        return table, *affine_prefix(table[a].to_numpy(), np.array([table[v].to_numpy() for v in values], float))

    def whole(table: pa.Table) -> pa.Table:
        table, big, sums = steps(table)
        out = table.slice(0, 1).select([*by, bucket])
        for name, x in (("a", big[-1]), *zip(values, sums[:, -1])):
            out = out.append_column(name, pa.array([float(x)]))
        return out

    def each(table: pa.Table) -> pa.Table:
        table, big, sums = steps(table)
        for v, x in zip(values, sums):
            entry = np.nan_to_num(table[f"__{v}"].to_numpy(zero_copy_only=False).astype(float))
            table = table.set_column(table.schema.get_field_index(v), v, pa.array(big * entry + x))
        return table.select(names)

    rows = written(rows)
    maps = rows.groupBy(*by, bucket).applyInArrow(whole, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, bucket)), "a double", *(f"{v} double" for v in values)]))
    carry = _entering(maps.withColumnRenamed(bucket, "bucket"), by, values)
    carry = carry.select(*by, F.col("bucket").alias(bucket), *(F.col(v).alias(f"__{v}") for v in values))
    schema = ", ".join(f"`{c}` {'double' if c in values else kinds[c]}" for c in names)
    return rows.join(carry, [*by, bucket], "left").groupBy(*by, bucket).applyInArrow(each, schema)


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their number from 0 in the group (i) and their bucket; the order must tell rows apart."""
    rows = ordered.with_before(df, by, order, name="i")
    return rows.withColumn("bucket", F.floor(F.col("i") / ordered.BUCKET).cast("long"))


def with_halo(rows: DataFrame, lookback: int) -> DataFrame:
    """Numbered rows once more in each bucket that looks back at them (in_halo)."""
    own, last = F.col("bucket"), F.floor((F.col("i") + lookback) / ordered.BUCKET).cast("long")
    return rows.withColumn("__own", own).withColumn("bucket", F.explode(F.sequence(own, last))).withColumn("in_halo", F.col("bucket") != F.col("__own")).drop("__own")


def begin(time: Column, width: int) -> Column:
    """Where the time bucket of ``time`` begins, in whole numbers."""
    return time - F.pmod(time, F.lit(width))


def doors(t: np.ndarray, spacing: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, reach) of a time bucket with rows at ``t``, which rise, that begins at ``start`` and is no shorter than ``spacing``.

    A bucket is entered up to ``spacing`` after it begins.  Entered up to a time ``entry`` (after the one before), its last
    kept row lets the next one come from ``reach`` on; of entries with one reach the last stands for all.
    """
    after = np.searchsorted(t, t + spacing)
    last = np.where(after < len(t), after, np.arange(len(t)))
    while (last[last] != last).any():
        last = last[last]
    n = min(len(t), 1 + int(np.searchsorted(t, start + spacing)))
    reach = t[last[:n]] + spacing
    stands = np.append(reach[1:] != reach[:-1], np.ones(min(n, 1), bool))
    return t[:n][stands], reach[stands]


def kept(t: np.ndarray, spacing: int, reach: int) -> np.ndarray:
    """Positions kept of rows at ``t``, which rise: the first from ``reach`` on, then always the next one ``spacing`` later."""
    out, i = [], int(np.searchsorted(t, reach))
    while i < len(t):
        out.append(i)
        i = int(np.searchsorted(t, t[i] + spacing))
    return np.array(out, np.int64)


def entered(found: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by, bucket, reach): the buckets that are gone through from the first row of each group, and from when on rows count there.

    ``found`` (by, bucket, entry, reach) has the ``doors`` of all buckets of ``width`` with rows.  A door leads to the first
    one from its reach on, which is met in order of time within the bucket of that time, else to the first of the next
    bucket with rows, which is carried through a table with one row per bucket.  The path is then followed by doubling.
    """
    found = written(found)
    into = found.select(*by, begin(F.col("reach"), width).alias("bucket"), F.col("reach").alias("__t"), F.lit(0).alias("__side"), F.col("bucket").alias("__from"), F.col("entry").alias("__entry"))
    stand = found.select(*by, "bucket", F.col("entry").alias("__t"), F.lit(1).alias("__side"))
    first = found.groupBy(*by, "bucket").agg(F.min("entry").alias("__first"))
    onward = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = into.select(*by, "bucket").union(stand.select(*by, "bucket")).distinct().join(first, [*by, "bucket"], "left")
    carried = buckets.select(*by, "bucket", F.last("__first", ignorenulls=True).over(onward).alias("__next"))
    w = Window.partitionBy(*by, "bucket").orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = into.unionByName(stand, allowMissingColumns=True).withColumn("__to", F.last(F.when(F.col("__side") == 1, F.col("__t")), ignorenulls=True).over(w)).where("__side = 0")
    to = F.coalesce("__to", "__next")
    links = written(ahead.join(carried, [*by, "bucket"], "left").select(*by, F.col("__entry").alias("entry"), F.col("__t").alias("reach"), to.alias("to")).where("to IS NOT NULL"))
    # the doors that are gone through: from the first of each group along the links, doubling their reach
    steps, gone = links.drop("reach"), written(found.groupBy(*by).agg(F.min("entry").alias("entry")))
    begun, held = gone, gone.count()
    while True:
        gone = written(gone.unionByName(gone.join(steps, [*by, "entry"]).select(*by, F.col("to").alias("entry"))).distinct())
        now = gone.count()
        if now == held:
            break
        held = now
        then = steps.select(*by, F.col("entry").alias("to"), F.col("to").alias("__then"))
        steps = written(steps.join(then, [*by, "to"]).select(*by, "entry", F.col("__then").alias("to")))
    passed = links.join(gone, [*by, "entry"], "left_semi").select(*by, begin(F.col("to"), width).alias("bucket"), "reach")
    return passed.unionByName(begun.select(*by, begin(F.col("entry"), width).alias("bucket"), begin(F.col("entry"), width).alias("reach")))


def thinned(rows: DataFrame, by: list[str], time: str, spacing: int, usable: str) -> DataFrame:
    """The rows kept greedily in each group: the first usable one, then always the next usable one at least ``spacing`` later.

    Of rows of one time one counts, whichever is first by the other columns.  Groups are cut into time buckets longer than
    ``spacing``.  What a bucket does to any time from which it is entered is worked out for each bucket on its own
    (``doors``), the way from bucket to bucket is found (``entered``), and each bucket then follows its rows from there.
    """
    ship(rows.sparkSession)
    names, width = rows.columns, 8 * spacing
    others = [c for c in names if c not in (*by, time)]
    one = rows.where(F.col(usable)).groupBy(*by, time).agg(F.min(F.struct(*others)).alias("__row")).select(*by, time, "__row.*")
    placed = written(one.withColumn("bucket", begin(F.col(time).cast("long"), width)))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def of_bucket(table: pa.Table) -> pa.Table:
        entry, reach = doors(np.sort(table[time].to_numpy()), spacing, table["bucket"][0].as_py())
        out = pa.Table.from_arrays([pa.array([table[c][0].as_py()] * len(entry), table.schema.field(c).type) for c in (*by, "bucket")], [*by, "bucket"])
        return out.append_column("entry", pa.array(entry, pa.int64())).append_column("reach", pa.array(reach, pa.int64()))

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        return table.take(pa.array(kept(table[time].to_numpy(), spacing, table["__reach"][0].as_py()))).select(names)

    found = placed.select(*by, "bucket", time).groupBy(*by, "bucket").applyInArrow(of_bucket, f"{head}, bucket long, entry long, reach long")
    inside = placed.join(entered(found, by, width).withColumnRenamed("reach", "__reach"), [*by, "bucket"])
    return inside.groupBy(*by, "bucket").applyInArrow(follow, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def run_lengths(rows: DataFrame, by: list[str], order: list[str], flag: Column, reset: Column, name: str = "run") -> DataFrame:
    """Adds how many rows with ``flag`` there have been since the last ``reset``, this row with them (a reset row has none)."""
    one = rows.withColumn("__one", F.when(flag, 1).otherwise(0)).withColumn("__reset", F.when(reset, 1).otherwise(0))
    placed = written(numbered(one, by, order))
    w = Window.partitionBy(*by, "bucket").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # a bucket adds to what enters it unless it has a reset: the map x -> a x + b
    segment = F.sum("__reset").over(w)
    rows_in = placed.withColumn("__segment", segment)
    inside = Window.partitionBy(*by, "bucket", "__segment").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("__reset") == 1, 0).otherwise(F.sum(F.when(F.col("__reset") == 0, F.col("__one")).otherwise(0)).over(inside))
    local = written(rows_in.withColumn(name, counted))
    maps = local.groupBy(*by, "bucket").agg(F.min(F.when(F.col("__reset") == 1, 0.0).otherwise(1.0)).alias("a"), F.max_by(name, "i").cast("double").alias("n"))
    carry = _entering(maps, by, ["n"]).withColumnRenamed("n", "__carried")
    out = local.join(carry, [*by, "bucket"], "left")
    total = F.col(name) + F.when(F.col("__segment") == 0, F.coalesce("__carried", F.lit(0.0))).otherwise(0.0)
    return out.withColumn(name, total.cast("long")).drop("__one", "__reset", "__segment", "__carried", "bucket", "i")


def percentiles(rows: DataFrame, by: list[str], columns: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(by, column, n, q): exact percentiles with linear interpolation of each column in each group; nulls are left out.

    Values are counted first, so repeats cost nothing; running counts come from ranges of (group, column, value), and the
    two values around each percentile are picked by their ranks.  No task holds a group, as ``percentile`` would.
    """
    key = [*by, "column"]
    long = rows.unpivot(list(by), list(columns), "column", "value").where("value IS NOT NULL")
    # written, as dealing out by ranges looks at the counts twice
    counts = written(long.select(*key, F.col("value").cast("double").alias("value")).groupBy(*key, "value").agg(F.count("*").alias("__n")))
    return counted_percentiles(counts, key, at)


def counted_percentiles(counts: DataFrame, key: list[str], at: Sequence[float]) -> DataFrame:
    """(key, n, q): the percentiles of values that are counted already (value, __n)."""
    ahead = written(ordered.with_before(counts, key, ["value"], n="__n", name="__before"))
    totals = ahead.groupBy(*key).agg(F.sum("__n").alias("n"))
    placed = ahead.join(totals, key)
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
    picks = []
    for k, q in enumerate(at):
        low = F.floor(q * (F.col("n") - 1))
        picks += [F.max(F.when(holds(low), F.col("value"))).alias(f"__low{k}"), F.max(F.when(holds(F.least(low + 1, F.col("n") - 1)), F.col("value"))).alias(f"__high{k}")]
    found = placed.groupBy(*key, "n").agg(*picks)
    part = lambda q: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    values = [F.col(f"__low{k}") + part(q) * (F.col(f"__high{k}") - F.col(f"__low{k}")) for k, q in enumerate(at)]
    return found.select(*key, "n", F.array(*values).alias("q"))


def running(rows: DataFrame, by: list[str], value: Column, name: str, how: str = "max") -> DataFrame:
    """Adds the greatest ``value`` (or the sum) of the rows of the group before each one; null (0) before the first.

    Rows are numbered and in buckets; values may be structs, so the latest of something is the greatest (i, something).
    """
    combine = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[how]
    total = {"max": F.max, "sum": F.sum}[how]
    placed = written(rows.withColumn("__value", value))
    state, reach = written(placed.groupBy(*by, "bucket").agg(total("__value").alias("__sum"))), 1
    last = state.agg(F.max("bucket")).first()[0] or 0
    while reach <= last:
        before = state.select(*by, (F.col("bucket") + reach).alias("bucket"), F.col("__sum").alias("__before"))
        state = written(state.join(before, [*by, "bucket"], "left").select(*by, "bucket", combine(F.col("__sum"), F.col("__before")).alias("__sum")))
        reach *= 2
    entering = state.select(*by, (F.col("bucket") + 1).alias("bucket"), F.col("__sum").alias("__entering"))
    w = Window.partitionBy(*by, "bucket").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("__inside", total("__value").over(w)).join(entering, [*by, "bucket"], "left")
    return inside.withColumn(name, combine(F.col("__inside"), F.col("__entering"))).drop("__value", "__inside", "__entering")
