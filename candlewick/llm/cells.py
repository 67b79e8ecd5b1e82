"""All-pairs work inside groups, in cells of bounded size.

A group is dealt into blocks by a hash of the row's id, and a pair of blocks that has to be compared is a cell.  No
pair of rows becomes a row: a cell is handled in one pass over two blocks, and what it returns is for its function to
keep linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.runtime import partitions, tidy

CELL = ("_group", "_i", "_j")


def sides(rows: DataFrame, group: list[str], row_id: str, component: str, block: int) -> DataFrame:
    """`rows` of groups with several components, with `_group` (a hash of the group's columns), `_i` <= `_j` (the
    cell) and `_second` (the row is in block `_j` of two).  Pairs within a group's largest component are left out: its
    rows meet the others, and the others meet all.  Where most of a group is one component, a row goes to few cells
    however large the group is."""
    counted = rows.groupBy(*group, component).agg(F.count(F.lit(1)).alias("_n"))
    sized = (
        counted.groupBy(*group)
        .agg(F.max(F.struct("_n", component)).alias("_top"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_parts"))
        .filter("_parts > 1")
        .select(*group, F.col(f"_top.{component}").alias("_main"), F.ceil(F.col("_top._n") / block).cast("int").alias("_ms"), F.ceil((F.col("_all") - F.col("_top._n")) / block).cast("int").alias("_os"))
    )
    main = F.col(component) == F.col("_main")
    place = F.xxhash64(F.lit(5), row_id)
    own = F.when(main, F.col("_os") + F.pmod(place, F.col("_ms"))).otherwise(F.pmod(place, F.col("_os"))).cast("int")
    others = F.sequence(F.lit(0), F.when(main, F.col("_os")).otherwise(F.col("_os") + F.col("_ms")) - 1)
    return (
        rows.join(sized, group)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .withColumn("_group", F.xxhash64(*group))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .withColumn("_second", F.col("_own") > F.col("_i"))
        .drop("_main", "_ms", "_os", "_own", "_other")
    )


def blocks(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a cell's two blocks, and whether they are two: a block that meets itself is both."""
    second = cell["_second"].to_numpy()
    two = cell["_i"][0].as_py() != cell["_j"][0].as_py()
    every = np.arange(cell.num_rows)
    return (np.flatnonzero(~second), np.flatnonzero(second), True) if two else (every, every, False)


def each(dealt: DataFrame, group: list[str], row_id: str, function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies `function` to the rows of each cell, in order of `row_id`, so that a repeated task gives the same."""
    return grouped(dealt, list(CELL), [*CELL, *group], row_id, function, schema)


def grouped(rows: DataFrame, by: list[str], keys: list[str], row_id: str, function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies `function` to the rows of each value of `keys`, which are shuffled by the columns `by` among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch[k]
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            mark = tuple(batch[k][0].as_py() for k in keys)
            if held and mark != key:
                yield from function(pa.Table.from_batches(held))
                held = []
            start = np.flatnonzero(new).tolist()
            for a, b in zip([0, *start], [*start, batch.num_rows], strict=True):
                if a:
                    yield from function(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
            key = tuple(batch[k][-1].as_py() for k in keys)
        if held:
            yield from function(pa.Table.from_batches(held))

    spread = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*keys, row_id)
    return spread.mapInArrow(tidy(run), schema)
