"""Counts of hashes in a table of fixed size: an upper bound of how often each occurs, for dealing out work.

Every map task fills a table of its own; the tables are merged segment by segment.  Hashes that fall on one counter are
counted together, so callers may use the numbers to order or to split work, not to decide a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candlewick.llm import textkit
from candlewick.llm.runtime import give_back, partitions, tidy

COUNTERS, SEGMENTS = 1 << 18, 64


def slots(hashes: np.ndarray) -> np.ndarray:
    """The counter of each hash."""
    return (textkit.fmix(hashes) & np.uint64(COUNTERS - 1)).astype(np.int64)


def count(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The merged table over all hashes that `hashes` gives for the batches of `rows`."""
    width = COUNTERS // SEGMENTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                for h in hashes(batch):
                    total += np.bincount(slots(h), minlength=COUNTERS)
        if total.any():
            own = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in total.reshape(SEGMENTS, width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array(own, pa.binary())], names=("seg", "n"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, n in zip(batch["seg"].to_pylist(), batch["n"].to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(n), "<i8")
                total[seg] = total[seg] + own if seg in total else own
        for seg, n in total.items():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "n": pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())})

    schema = "seg int, n binary"
    merged = rows.mapInArrow(tidy(fill), schema).repartition(min(SEGMENTS, partitions(rows.sparkSession)), "seg").mapInArrow(tidy(merge), schema)
    out = np.zeros((SEGMENTS, width), np.int64)
    for row in merged.toLocalIterator():
        out[row.seg] = np.frombuffer(zlib.decompress(bytes(row.n)), "<i8")
    give_back()
    return out.reshape(-1)
