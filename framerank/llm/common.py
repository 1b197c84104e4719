"""Helpers that several operators share: written cuts, words and bounded ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framerank.operators.cuts import cut, shared_dir, shared_path  # noqa: F401

#: Words are runs of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 in the same places.
WORD = r"[^\x20\x09-\x0D]+"


def trimming(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; at its end the worker, which is kept for later tasks, gives its free memory back."""

    @wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return trimmed


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def ranked(rows: DataFrame, groups: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, a gapless number from 0 within ``groups``, in the order of ``bucket`` and then ``order``.

    ``bucket`` splits a group into about as many buckets as a bucket has rows, so that neither the numbering of
    the rows nor the running sum over the buckets puts a whole group into one task. Columns in ``groups`` may be
    null.
    """
    keys = [*groups, bucket]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        numbered.join(sums, same, "inner")
        .withColumn(out, (F.col("__before") + F.col("__row") - 1).cast("long"))
        .drop("__before", "__row", *[f"__{k}" for k in keys])
    )
