"""Running sums inside groups of any size.

A window over a whole group would send one hot host or root to a single task.
Here the order numbers are cut into chunks of a fixed width: a chunk is summed
on its own, the chunk totals are summed in turn, and the offset of its chunk is
added to every row.  Three levels of 16 bits leave 16 of a long for the last sums, so
with any order values no window sees more than ``2 * WIDTH`` rows of a group (chunk 0 takes
both signs).  The plan is the same for inputs of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH, levels: int = 3
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with this row, by ``order`` within ``keys``.

    ``order`` is a whole number, unique within the keys, which are not NULL.
    ``df`` is read more than once; pass a narrow frame that is already written.
    """
    return _chunked_sum(df, keys, order, value, out, width, levels)


def _chunked_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int, levels: int
) -> DataFrame:
    chunk, total, before = f"__chunk{levels}", f"__total{levels}", f"__before{levels}"
    by_chunk = df.withColumn(chunk, F.expr(f"`{order}` div {width}")).withColumn(total, value)
    totals = by_chunk.groupBy(*keys, chunk).agg(F.sum(total).alias(total))
    if levels > 1:
        offsets = _chunked_sum(totals, keys, chunk, F.col(total), before, width, levels - 1)
    else:
        window = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0)
        offsets = totals.withColumn(before, F.sum(total).over(window))
    offsets = offsets.select(*keys, chunk, (F.col(before) - F.col(total)).alias(before))
    inner = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        by_chunk.withColumn(total, F.sum(total).over(inner))
        .join(offsets, [*keys, chunk])
        .withColumn(out, F.col(total) + F.col(before))
        .drop(chunk, total, before)
    )


def numbered(df: DataFrame, keys: list[str], order: str, out: str, width: int = WIDTH) -> DataFrame:
    """Add ``out``: 1, 2, ... by ``order`` within ``keys``."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, width)
