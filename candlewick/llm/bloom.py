"""Two Bloom filters over a distributed stream of hashes: seen once, and seen at least twice.

Every map task fills a pair of filters of its own; the pairs are merged segment by segment.  A hash that two tasks
have seen once each is in the intersection of their once-filters, so the merged twice-filter is the union of the
twice-filters and of all pairwise intersections, and holds every repeated hash.  It may hold others; callers confirm
what it admits.  A hash sets two bits of one 64-bit word, so that both are found with one look-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candlewick.llm.runtime import give_back, partitions

U64 = np.uint64
#: 64-bit words per segment: the unit that is shuffled and merged.
SEGMENT = 1 << 13


def words_for(expected: int, bits_per_key: int = 16, least: int = 1 << 16, most: int = 1 << 24) -> int:
    """Filter words for `expected` keys: a power of two from 0.5 MB to 128 MB.

    Beyond the upper bound the filter admits more of the unrepeated keys, which then cost a shuffle, not a result.
    """
    return int(min(most, max(least, 1 << int(max(1, expected) * bits_per_key // 64).bit_length())))


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash, and its two bits."""
    h = hashes.astype(U64)
    at = (h >> U64(12)) & U64(words - 1)
    bits = (U64(1) << (h & U64(63))) | (U64(1) << ((h >> U64(6)) & U64(63)))
    return at.astype(np.int64), bits


def _set(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at, bits = at[order], bits[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    words[at[start]] |= np.bitwise_or.reduceat(bits, start)


class Pair:
    """The filters of one task."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, U64), np.zeros(words, U64)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        keys, counts = np.unique(hashes, return_counts=True)
        at, bits = places(keys, len(self.once))
        again = (counts > 1) | ((self.once[at] & bits) == bits)
        if again.any():
            _set(self.twice, at[again], bits[again])
        _set(self.once, at, bits)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, len(self.once), SEGMENT):
            once = self.once[k : k + SEGMENT]
            if once.any():
                yield k // SEGMENT, pack(once.tobytes()), pack(self.twice[k : k + SEGMENT].tobytes())


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, bits = places(hashes, len(words))
    return (words[at] & bits) == bits


def repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], words: int) -> np.ndarray:
    """The twice-filter over all hashes that `hashes` gives for the batches of `rows`.

    Its size is `words`, whatever the data: the driver collects compressed segments of it and nothing else.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(words)
        for batch in batches:
            for h in hashes(batch):
                pair.add(h)
        for seg, once, twice in pair.segments():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "once": [once], "twice": [twice]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=1).compress
        now, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                yield pa.RecordBatch.from_pydict({"seg": pa.array([now], pa.int32()), "twice": [pack(twice.tobytes())]})

        for batch in batches:
            for seg, o, t in zip(*(batch[c].to_pylist() for c in ("seg", "once", "twice")), strict=True):
                o, t = np.frombuffer(unpack(o), U64), np.frombuffer(unpack(t), U64)
                if seg != now:
                    yield from done()
                    now, once, twice = seg, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        yield from done()

    import zstandard

    spark = rows.sparkSession
    filled = rows.mapInArrow(fill, "seg int, once binary, twice binary")
    merged = filled.repartition(partitions(spark), "seg").sortWithinPartitions("seg").mapInArrow(merge, "seg int, twice binary")
    out = np.zeros(words, U64)
    for row in merged.toLocalIterator():
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.twice)), U64)
        out[row.seg * SEGMENT : row.seg * SEGMENT + len(part)] = part
    give_back()
    return out


def split(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For filters of `repeated_keys`: the segment of each hash, and the 32 bits that stand for it there."""
    h = hashes.astype(U64)
    return ((h >> U64(32)) & U64(words // SEGMENT - 1)).astype(np.int64), h.astype(np.uint32)


def _marks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = key.astype(U64)
    bits = (U64(1) << ((key >> U64(13)) & U64(63))) | (U64(1) << ((key >> U64(19)) & U64(63)))
    return (key & U64(SEGMENT - 1)).astype(np.int64), bits


def holds_key(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    seg, key = split(hashes, len(words))
    at, bits = _marks(key)
    return (words[seg * SEGMENT + at] & bits) == bits


def repeated_keys(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], words: int, at_once: int = 1 << 21) -> np.ndarray:
    """A filter that holds every repeated hash, and of the others next to none but what repeated ones hide.

    Tasks send what they have seen as sorted lists of 32 bits for each segment, and a segment's lists are merged by one
    task, so hashes that occur once never reach the filter, however many there are: it fills with the repeated ones only.
    A task holds `at_once` hashes, and the task of a segment the segment's; the driver collects a filter of fixed size.
    """
    import zstandard

    def send(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        keys = np.repeat(keys, np.minimum(counts, 2))  # twice here is repeated for sure
        seg, key = split(keys, words)
        order = np.lexsort((key, seg))
        seg, key = seg[order], key[order]
        bounds = np.append(np.flatnonzero(np.append(True, seg[1:] != seg[:-1])), len(seg)).tolist()
        for lo in range(0, len(bounds) - 1, 512):
            part = list(zip(bounds[lo : lo + 512], bounds[lo + 1 : lo + 513], strict=False))
            yield pa.RecordBatch.from_pydict({"seg": pa.array([int(seg[a]) for a, _ in part], pa.int32()), "keys": pa.array([key[a:b].tobytes() for a, b in part], pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for h in hashes(batch):
                held.append(h.astype(U64))
                n += len(h)
                if n >= at_once:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                key = np.sort(np.concatenate(held))
                again = np.unique(key[1:][key[1:] == key[:-1]])
                if len(again):
                    own = np.zeros(SEGMENT, U64)
                    _set(own, *_marks(again))
                    yield pa.RecordBatch.from_pydict({"seg": pa.array([now], pa.int32()), "twice": [pack(own.tobytes())]})

        for batch in batches:
            for seg, keys in zip(batch["seg"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                if seg != now:
                    yield from done()
                    now, held = seg, []
                held.append(np.frombuffer(keys, np.uint32))
        yield from done()

    spark = rows.sparkSession
    sent = rows.mapInArrow(fill, "seg int, keys binary")
    merged = sent.repartition(partitions(spark), "seg").sortWithinPartitions("seg").mapInArrow(merge, "seg int, twice binary")
    out = np.zeros(words, U64)
    for row in merged.toLocalIterator():
        out[row.seg * SEGMENT : (row.seg + 1) * SEGMENT] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.twice)), U64)
    give_back()
    return out
