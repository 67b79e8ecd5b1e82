"""Ranks and running sums over hash-random order, without one task per group.

A window over ``partitionBy(source)`` sends a source with a third of all rows to one task.  Here a group's
order is a uniform hash, so its leading bits cut every group into slices of equal expected size: a window
runs inside each slice, and the totals of the slices before it, a table of groups times slices, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a slice holds on average.
SLICE_ROWS = 50_000


def slices_for(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    """Slices per group so that even a group of all rows gets slices of about `slice_rows`."""
    return max(256, -(-rows // slice_rows))


def hash_key(*columns: Column, seed: int) -> Column:
    """A uniform 60-bit key: the leading bits of the MD5 of the columns' texts, null as empty."""
    joined = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_slice(key: Column, slices: int) -> Column:
    """The slice of a key of `hash_key`, monotone in it."""
    return F.least(F.floor(key / F.lit(float(1 << 60)) * slices), F.lit(slices - 1)).cast("int")


def running(
    df: DataFrame, group: list[str], slice_col: str, order: list[str], amount: Column, before: str, total: str
) -> DataFrame:
    """Adds `before`, the sum of `amount` over the rows of the same group that precede in (slice, order), and
    `total`, the group's sum.  `group` may be empty: then all rows are one group.  Group columns are never null.
    """
    keys = [*group, slice_col]
    totals = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *keys,
        (F.sum("_sum").over(over.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_offset"),
        F.sum("_sum").over(over).alias(total),
    )
    inner = Window.partitionBy(*keys).orderBy(*order)
    within = F.sum(amount).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - amount
    return (
        df.withColumn("_within", within)
        .join(offsets, keys)
        .withColumn(before, F.col("_within") + F.col("_offset"))
        .drop("_within", "_offset")
    )
