"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import written

__all__ = ["SPACE", "WORD", "bounded_sample", "lean", "let", "pieces", "sized", "table", "unused", "words", "written"]

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body (or a lambda in it) names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def sized(small: DataFrame, rows: int = 100_000) -> DataFrame:
    """``small``, a written table of narrow rows, marked for broadcasting only if it has no more than ``rows`` of them.

    Beyond that it is returned as it is and joins by a shuffle.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that hands free memory back to the system when a task ends: workers live on between stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def pieces(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut where the bytes of a text or binary column come to ``size``; a longer value goes alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        held = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, held + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def bounded_sample(df: DataFrame, place: str, size: int) -> DataFrame:
    """The ``size`` rows with the least hash in column ``place`` (a 64-bit hash), or all rows if there are fewer.

    A first cut by the hash leaves about twice that many, so that what is sorted stays small however many partitions
    the table has.
    """
    total = df.count()
    if total > 2 * size:
        share = F.shiftrightunsigned(F.col(place), 11) / float(1 << 53)
        df = df.where(share < 2 * size / total)
        place_order = share
    else:
        place_order = F.col(place)
    return df.orderBy(place_order, place).limit(size)
