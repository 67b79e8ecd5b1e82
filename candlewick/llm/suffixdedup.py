"""Exact substring dedup: bytes that a string of `length` bytes covers which also starts earlier are removed.

Suffixes are sorted by bucket-pointer refinement (`refine`).  They start in the buckets of their first 8 bytes; a
suffix's pointer is the place at which its bucket begins.  Buckets with several members are sorted by the pointers of
the suffixes `depth` further on, which splits them to twice the depth; the new pointers are what the next round sorts
by.  What shares a bucket at depth `length` is equal, byte by byte.

Sorting all suffixes of a corpus would shuffle every byte many times over.  Suffixes are therefore brought together by
q-grams of 32 bytes, entered at anchors only: of every `length` bytes the leftmost q-gram with the smallest identifier.
All starts with one anchor are a run of neighbours, and equal strings have their anchors at equal offsets.  A q-gram
that occurs once needs no refinement: a filter of the repeated ones lets only their runs go on.  Tasks cannot share
pointers, so between tasks a string has an identifier of 128 bits, built the same way: that of depth 2m from those of
depth m at offsets 0 and m.

1. Within a task, runs that are equal as a whole are one bucket: its first member goes on, the others are removed.
2. Runs are shuffled by q-gram and, within it, sorted by the bucket of the whole run; again the first goes on.
3. Different runs of one q-gram are refined to depth `length`; of each bucket the first start stays.  The starts of a
   q-gram with more runs than a task may hold are passed on with their identifiers, for Spark to group.

The order is that of doc_id, then start.  Defined results: a null text is empty; texts under `length` bytes lose nothing;
a text of any length is handled in windows of `length` bytes by the task that reads it; rows with equal doc_id and text
are one document; rows of one doc_id with different texts are ordered by a hash of the
text; a null doc_id comes after all others; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import bloom, textkit
from candlewick.llm.runtime import cut, partitions, small_batches

U64 = np.uint64
Q = 32
#: Runs of one q-gram that are refined in memory, bytes of text whose runs a task compares among themselves, and runs
#: that are refined at once.
MOST_RUNS, LOT_BYTES, AT_ONCE = 100_000, 16 << 20, 10_000
#: Bytes of text whose suffixes are bucketed at once.
CHUNK = 1 << 20
_LAST = (1 << 63) - 1
_FAMILY = ((U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)), (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)))
_RUN = "k long, c1 long, c2 long, doc long, version long, place long, text binary"
_PART = "kind int, h1 long, h2 long, doc long, version long, span long"


def _mix(a: np.ndarray, b: np.ndarray, family: int) -> np.ndarray:
    x, y = _FAMILY[family]
    h = (a ^ (b >> U64(31))) * x + b * y
    h ^= h >> U64(29)
    h *= y
    return h ^ (h >> U64(32))


class Buckets:
    """Identifiers of all suffixes of a buffer at depths 32 and 64, and from them at any depth from 64 to 192."""

    def __init__(self, raw: np.ndarray, family: int, to: int = 64):
        padded = np.concatenate([raw, np.zeros(to, np.uint8)]).astype(U64)
        level = padded[:-3] | padded[1:-2] << U64(8) | padded[2:-1] << U64(16) | padded[3:] << U64(24)
        level = level[:-4] | level[4:] << U64(32)
        depth, self.family = 8, family
        self.at: dict[int, np.ndarray] = {}
        while depth < to:
            level = _mix(level[:-depth], level[depth:], family)
            depth *= 2
            self.at[depth] = level

    def string(self, start: np.ndarray, length: np.ndarray | int, tag: np.ndarray | int = 0) -> np.ndarray:
        """Identifiers of strings: three buckets of depth 64 that cover each, its length and a tag."""
        b = self.at[64]
        n = np.atleast_1d(np.asarray(length, np.int64))
        h = _mix(b[start], b[start + (n - 64) // 2], self.family)
        h = _mix(h, b[start + n - 64], self.family)
        return _mix(h, (n.astype(U64) << U64(16)) + np.asarray(tag, np.int64).astype(U64), self.family)


def runs(rows: list[bytes], first: Buckets, raw: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(q-gram identifier, first start, number of starts, offset of the anchor from the first start) of every run."""
    h = first.at[Q][: max(0, len(raw) - Q + 1)]
    value, where = h, np.arange(len(h), dtype=np.int32)
    have, width = 1, length - Q + 1
    while have < width and len(value) > have:
        step = min(have, width - have)
        left = value[:-step] <= value[step:]
        value, where = np.where(left, value[:-step], value[step:]), np.where(left, where[:-step], where[step:])
        have += step
    edge = np.zeros(len(where) + 1, np.int8)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    long = size >= length
    if have < width or not long.any():
        return (np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
    np.add.at(edge, start[long], 1)
    np.add.at(edge, start[long] + size[long] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= (where[1:] != where[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    end = np.minimum(np.append(at[1:], len(valid)), stop[np.searchsorted(stop, at, side="right")])
    return h[where[at]], at, end - at, where[at] - at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_of(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A sort by (keys, order), and for each place in it the place where its key begins."""
    by = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    return by, np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))


def _later(by: np.ndarray, head: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows come after the first of their key, by the order and not only by place."""
    out = np.zeros(len(by), bool)
    differ = np.zeros(len(by), bool)
    for o in order:
        differ |= o[by] != o[by][head]
    out[by] = differ
    return out


def refine(raw: np.ndarray, length: int) -> np.ndarray:
    """The bucket pointers of all suffixes of `raw` at depth `length` (8 at least): equal where the first `length` bytes are.

    Bytes after the end count as zeros.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(U64)
    gram = np.zeros(n, U64)
    for k in range(8):
        gram = gram << U64(8) | padded[k : k + n]
    order = np.argsort(gram, kind="stable")
    new = np.append(True, gram[order[1:]] != gram[order[:-1]])[:n]
    pointer = np.zeros(n, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        size = np.bincount(pointer, minlength=n)
        open_ = np.flatnonzero(size[pointer] > 1)
        if not len(open_):
            break
        # suffixes that end before the later offset come before all others
        later = np.where(open_ + step < n, pointer[np.minimum(open_ + step, n - 1)], -1)
        by = np.lexsort((later, pointer[open_]))
        at, later = open_[by], later[by]
        own = pointer[at]
        first = np.append(True, own[1:] != own[:-1])
        new = first | np.append(True, later[1:] != later[:-1])
        place = np.arange(len(at))
        # a bucket's members keep its places: a part begins as far into it as its first member comes
        pointer[at] = own + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        depth += step
    return pointer


def _refine(table: dict[str, np.ndarray], texts: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """Step 3 for whole q-grams: the removed starts of different runs, as spans of the starts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0, *map(len, texts)])[:-1]
    n = (table["place"] >> 8) & 0xFF
    row = np.repeat(np.arange(len(n)), n)
    x = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    bucket = refine(raw, length)[base[row] + x]
    start = (table["place"] >> 16)[row] + x
    order = (table["doc"][row], table["version"][row], start)
    by, head = _first_of((bucket,), order)
    gone = np.flatnonzero(_later(by, head, order))
    if len(gone):
        # neighbouring starts of one run are one span
        new = np.append(True, (row[gone][1:] != row[gone][:-1]) | (x[gone][1:] != x[gone][:-1] + 1))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(gone)))
        yield _spans(table["doc"][row[gone[first]]], table["version"][row[gone[first]]], start[gone[first]], count)


def _joined(doc: np.ndarray, version: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Removed starts with neighbours of one document made one, of fewer than 2**24 starts each."""
    by = np.lexsort((start, version, doc))
    doc, version, start, count = doc[by], version[by], start[by], count[by]
    new = np.ones(len(by), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (start[1:] >> 23 != start[:-1] >> 23)
    first = np.flatnonzero(new)
    return doc[first], version[first], start[first], np.add.reduceat(count, first)


def _spans(doc: np.ndarray, version: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Removed starts [start, start + count)."""
    zero = np.zeros(len(doc), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(zero), pa.array(doc), pa.array(version), pa.array(start << 24 | count)],
        names=("kind", "h1", "h2", "doc", "version", "span"),
    )


def _starts(table: dict[str, np.ndarray], texts: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """Step 3 for a q-gram with too many runs: every start with its identifier."""
    for a in range(0, len(texts), AT_ONCE):
        part = {c: v[a : a + AT_ONCE] for c, v in table.items()}
        raw = np.frombuffer(b"".join(texts[a : a + AT_ONCE]), np.uint8)
        base = np.cumsum([0, *map(len, texts[a : a + AT_ONCE])])[:-1]
        n = (part["place"] >> 8) & 0xFF
        row = np.repeat(np.arange(len(n)), n)
        x = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h1, h2 = (Buckets(raw, f).string(base[row] + x, length) for f in (0, 1))
        start = (part["place"] >> 16)[row] + x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(row), np.int32)), _signed(h1), _signed(h2), pa.array(part["doc"][row]), pa.array(part["version"][row]), pa.array(start << 24 | 1)],
            names=("kind", "h1", "h2", "doc", "version", "span"),
        )


def remove_repeats(docs: DataFrame, length: int = 100, most_runs: int = MOST_RUNS, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the maximal removed byte ranges, ascending, and the remaining bytes."""
    if not 96 <= length <= 128:
        raise ValueError("lengths from 96 to 128 bytes are supported")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = bloom.words_for(n_bytes * 2 // (length - Q + 2), bits_per_key=8)

    def q_grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for lo, hi in textkit.chunks(batch["text"], CHUNK):
            own = textkit.as_bytes(batch["text"].slice(lo, hi - lo))
            raw, start, _ = textkit.buffer(own)
            yield runs(own, Buckets(raw, 0, Q), raw, start, length)[0]

    twice = spark.sparkContext.broadcast(bloom.repeated_keys(rows.select("text"), q_grams, words))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        size = 0
        for batch in batches:
            docs_, versions = batch["doc"].to_numpy(), batch["version"].to_numpy()
            for lo, hi in textkit.chunks(batch["text"], CHUNK):
                own = textkit.as_bytes(batch["text"].slice(lo, hi - lo))
                raw, start, _ = textkit.buffer(own)
                one = Buckets(raw, 0)
                k, at, n, offset = runs(own, one, raw, start, length)
                hit = bloom.holds_key(twice.value, k)
                k, at, n, offset = k[hit], at[hit], n[hit], offset[hit]
                if not len(k):
                    continue
                two = Buckets(raw, 1)
                row = np.searchsorted(start, at, side="right") - 1
                held.append((raw, {
                    "k": k, "c1": one.string(at, n + length - 1, offset), "c2": two.string(at, n + length - 1, offset),
                    "doc": docs_[lo + row], "version": versions[lo + row], "place": (at - start[row]) << 16 | n << 8 | offset, "at": at,
                }))
                size += len(raw)
                if size >= LOT_BYTES:
                    yield from _lot(held, length)
                    held, size = [], 0
        if held:
            yield from _lot(held, length)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k", "c1", "c2", "doc", "version", "place")
        held: list[tuple[dict[str, np.ndarray], list[bytes]]] = []
        kept = 0
        large: int | None = None

        def settle(tables: list[tuple[dict[str, np.ndarray], list[bytes]]], key: int | None = None) -> Iterator[pa.RecordBatch]:
            table = {c: np.concatenate([t[c] for t, _ in tables]) for c in names}
            texts = [x for _, own in tables for x in own]
            order = (table["doc"], table["version"], table["place"] >> 16)
            by, head = _first_of((table["c1"], table["c2"]), order)
            gone = _later(by, head, order)
            if gone.any():
                yield _spans(*_joined(table["doc"][gone], table["version"][gone], order[2][gone], (table["place"][gone] >> 8) & 0xFF))
            firsts = np.sort(by[head == np.arange(len(by))])
            if key is None:
                # q-grams with one run left are done
                _, number, count = np.unique(table["k"][firsts], return_inverse=True, return_counts=True)
                firsts = firsts[count[number] > 1]
            if len(firsts):
                rest, own = {c: v[firsts] for c, v in table.items()}, [texts[i] for i in firsts.tolist()]
                if key is not None:
                    yield from _starts(rest, own, length)
                else:
                    group = np.argsort(rest["k"], kind="stable")
                    rest, own = {c: v[group] for c, v in rest.items()}, [own[i] for i in group.tolist()]
                    bounds = np.append(np.flatnonzero(np.append(True, rest["k"][1:] != rest["k"][:-1])), len(own)).tolist()
                    a = 0
                    for b, nxt in zip(bounds[1:], [*bounds[2:], None], strict=True):
                        if nxt is None or nxt - a > at_once:
                            yield from _refine({c: v[a:b] for c, v in rest.items()}, own[a:b], length)
                            a = b

        for batch in batches:
            is_span = pc.is_null(batch["text"]).to_numpy(zero_copy_only=False)
            if is_span.any():
                s = np.flatnonzero(is_span)
                yield _spans(batch["doc"].to_numpy()[s], batch["version"].to_numpy()[s], batch["place"].to_numpy()[s] >> 24, batch["place"].to_numpy()[s] & 0xFFFFFF)
                batch = batch.filter(pa.array(~is_span))
            if not batch.num_rows:
                continue
            held.append(({c: batch[c].to_numpy() for c in names}, batch["text"].to_pylist()))
            kept += batch.num_rows
            last = int(batch["k"][-1].as_py())
            if kept < at_once:
                continue
            # all but the last q-gram is complete
            table = {c: np.concatenate([t[c] for t, _ in held]) for c in names}
            texts = [x for _, own in held for x in own]
            whole = int(np.searchsorted(table["k"], last))
            if whole:
                yield from settle([({c: v[:whole] for c, v in table.items()}, texts[:whole])], large)
                large = None
            held, kept = [({c: v[whole:] for c, v in table.items()}, texts[whole:])], len(texts) - whole
            if kept >= most_runs or large is not None and kept:
                large = last
                yield from settle(held, last)
                held, kept = [], 0
        if held:
            yield from settle(held, large)

    posted = rows.select("doc", "version", "text").mapInArrow(local, _RUN)
    sorted_ = posted.repartition(partitions(spark), "k").sortWithinPartitions("k")
    parts = cut(sorted_.mapInArrow(resolve, _PART))
    gone = parts.filter("kind = 0").select("doc", "version", "span")
    if parts.filter("kind = 1").limit(1).count():
        starts = parts.filter("kind = 1").withColumn("own", F.struct("doc", "version", "span"))
        first = starts.groupBy("h1", "h2").agg(F.min("own").alias("first"))
        gone = gone.union(starts.join(first, ["h1", "h2"]).filter("own > first").select("doc", "version", "span"))
    per_doc = gone.groupBy("doc", "version").agg(F.collect_list("span").alias("removed"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict[str, int]]] = []
            kept: list[bytes] = []
            texts = textkit.as_bytes(batch["text"])
            for text, removed in zip(texts, batch["removed"].to_pylist(), strict=True):
                if not removed:
                    out.append([])
                    kept.append(text)
                    continue
                code = np.sort(np.array(removed, np.int64))
                start = code >> 24
                end = np.maximum.accumulate(start + (code & 0xFFFFFF) - 1 + length)
                new = np.append(True, start[1:] > end[:-1])
                s = start[new]
                e = end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                out.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                kept.append(b"".join([text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=("doc_id", "n_bytes", "spans", "kept"),
            )

    both = rows.join(per_doc, ["doc", "version"], "left").select("doc_id", "text", "removed")
    return both.mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def _lot(held: list[tuple[np.ndarray, dict[str, np.ndarray]]], length: int) -> Iterator[pa.RecordBatch]:
    """Step 1: the first of equal runs with its text, and the others as removed starts (text null, place start << 24 | count)."""
    table = {c: np.concatenate([t[c] for _, t in held]) for c in held[0][1]}
    buffer = np.repeat(np.arange(len(held)), [len(t["k"]) for _, t in held])
    start, n = table["place"] >> 16, (table["place"] >> 8) & 0xFF
    order = (table["doc"], table["version"], start)
    by, head = _first_of((table["c1"], table["c2"]), order)
    gone = np.flatnonzero(_later(by, head, order))
    if len(gone):
        doc, version, at, count = _joined(table["doc"][gone], table["version"][gone], start[gone], n[gone])
        zero = pa.array(np.zeros(len(doc), np.int64))
        yield pa.RecordBatch.from_arrays(
            [_signed(textkit.fmix(doc.astype(U64))), zero, zero, pa.array(doc), pa.array(version), pa.array(at << 24 | count), pa.nulls(len(doc), pa.binary())],
            names=("k", "c1", "c2", "doc", "version", "place", "text"),
        )
    first = np.sort(by[head == np.arange(len(by))])
    raws = [memoryview(raw) for raw, _ in held]
    for a in range(0, len(first), 50_000):
        f = first[a : a + 50_000]
        at = table["at"][f]
        texts = [bytes(raws[b][s : s + m]) for b, s, m in zip(buffer[f].tolist(), at.tolist(), (n[f] + length - 1).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(_signed(table[c][f]) for c in ("k", "c1", "c2")), *(pa.array(table[c][f]) for c in ("doc", "version", "place")), pa.array(texts, pa.binary())],
            names=("k", "c1", "c2", "doc", "version", "place", "text"),
        )
