"""Benchmark decontamination over a distributed positional inverted index.

`build` makes the index once: a row per block of documents, with the block's terms and, for each, its postings (token
positions in the block, ascending, as compressed steps).  It holds all tokens of all documents and is a table in the
shared folder, so that any benchmark, now or later, is searched for without reading the documents again.

`search` takes the lists of a window of benchmark words from the term on that is rarest in the whole corpus, shifts them
by the term's offset in the window, and intersects them.  Windows are entered by their rarest term: a block visits those
of the rare terms it holds, and of these the ones all of whose terms it holds.  What is left are exact phrase matches.
With `slop`, terms may also stand up to so many tokens off their place (proximity matches).

Words are runs of 0-9, a-z and characters beyond ASCII after A-Z is lower-cased.  A window is `width` consecutive words
of an item; an item with fewer, but not none, is one window.  Defined results: a null or empty text has no words; an item
without words has no window; items whose item_id is null are left out, or with `unnamed` searched for like others, only
that no id of theirs is listed; repeated items count once; repeated documents are judged one by one; a very long text is
one block; an empty table on either side gives no matches.  Columns beside the documents' key and text and the items'
item_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import textkit
from candlewick.llm.runtime import cut, small_batches, tidy

#: Bytes of benchmark text that are searched for at once, and so the bound of what is broadcast; a larger benchmark is
#: searched for block by block.
BENCHMARK_BYTES = 16 << 20

Item = tuple[str | None, bytes]


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i4").tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i4")


def tokens(rows: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased buffer of `rows`, the starts and ends of all words in it, each row's first word and its number of words."""
    raw, start, _ = textkit.buffer(rows)
    low = textkit.LOWER[raw]
    s, e = textkit.word_spans(textkit.IS_ALNUM[low])
    first = np.searchsorted(s, start)
    return low.tobytes(), s, e, first, np.diff(np.append(first, len(s)))


def postings(rows: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, where each one's postings end, all postings, and each row's number of words."""
    low, s, e, _, count = tokens(rows)
    if not len(s):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), count
    buffer = np.frombuffer(low, np.uint8)
    a, b = (textkit.Prefix(buffer, k).hash(s, e) for k in (0, 1))
    order = np.argsort(a, kind="stable")
    same = a[order[1:]] == a[order[:-1]]
    if (b[order[1:]] != b[order[:-1]])[same].any():  # two words with one hash
        order = np.lexsort((np.arange(len(a)), b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    head = np.flatnonzero(np.append(True, ~same))
    one = order[head]
    return [low[x:y] for x, y in zip(s[one].tolist(), e[one].tolist(), strict=True)], np.append(head[1:], len(order)), order, count


class Queries:
    """The windows of a block of the benchmark, as stretches of one sequence of term numbers."""

    def __init__(self, items: list[Item], width: int):
        low, s, e, first, count = tokens([t for _, t in items])
        self.number: dict[bytes, int] = {}
        every = [self.number.setdefault(low[x:y], len(self.number)) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
        self.sequence = np.array(every, np.int32)
        self.names = [i for i, _ in items]
        n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), n)
        self.start = (np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)).astype(np.int32)
        self.length = np.repeat(np.minimum(count, width), n).astype(np.int16)
        self.width = width

    def enter(self, rarity: np.ndarray) -> None:
        """Sorts the windows by their rarest term, so that `of` finds those of a term."""
        self.rarity = rarity
        rarest = np.zeros(len(self.start), np.int32)
        for lo in range(0, len(self.start), 1 << 16):
            terms = self.terms(np.arange(lo, min(lo + (1 << 16), len(self.start))))
            n = np.where(terms >= 0, rarity[terms], np.iinfo(np.int64).max)
            rarest[lo : lo + len(terms)] = np.take_along_axis(terms, n.argmin(1)[:, None], 1)[:, 0]
        self.by_rarest = np.argsort(rarest, kind="stable").astype(np.int32)
        self.bounds = np.searchsorted(rarest[self.by_rarest], np.arange(len(self.number) + 1))

    def terms(self, windows: np.ndarray) -> np.ndarray:
        """A row of term numbers per window, -1 beyond its length."""
        k = np.arange(self.width)
        at = self.start[windows].astype(np.int64)[:, None] + k
        inside = k < self.length[windows][:, None]
        return np.where(inside, self.sequence[np.where(inside, at, 0)], -1) if len(self.sequence) else np.zeros(at.shape, np.int32)

    def candidates(self, present: list[int]) -> np.ndarray:
        """The windows whose rarest term is among `present`, and all other terms too."""
        spans = [self.by_rarest[self.bounds[t] : self.bounds[t + 1]] for t in present]
        windows = np.sort(np.concatenate(spans)) if spans else np.zeros(0, np.int32)
        here = np.zeros(len(self.number) + 1, bool)
        here[present] = True
        here[-1] = True  # of -1: beyond a window's length
        kept = [w[here[self.terms(w)].all(1)] for w in np.array_split(windows, 1 + len(windows) // (1 << 16))]
        return np.concatenate(kept)


def build(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The index of all tokens of `docs`: one row per block of documents, kept in the shared folder."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in textkit.chunks(batch["text"]):
                terms, ends, order, count = postings(textkit.as_bytes(batch["text"].slice(lo, hi - lo)))
                step = order.copy()
                step[1:] -= order[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([batch["_key"].slice(lo, hi - lo).to_pylist()], pa.list_(batch.schema.field("_key").type)),
                        pa.array([count.tolist()], pa.list_(pa.int64())),
                        *(pa.array([x], pa.binary()) for x in (zlib.compress(b" ".join(terms), 1), _pack(ends), _pack(step))),
                    ],
                    names=("block", "keys", "n_words", "terms", "ends", "postings"),
                )
                block += 1

    schema = f"block long, keys array<{kind}>, n_words array<long>, terms binary, ends binary, postings binary"
    return cut(docs.select(F.col(key).alias("_key"), "text").mapInArrow(tidy(part), schema))


def _present(terms: bytes, ends: bytes, number: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(term number, start, end in the postings) of a block's terms that the benchmark has."""
    stop = _unpack(ends).tolist()
    words = zlib.decompress(terms).split()
    return [(t, a, b) for w, a, b in zip(words, [0, *stop], stop, strict=False) if (t := number.get(w)) is not None]


def _rarity(index: DataFrame, queries) -> np.ndarray:
    """How often each benchmark term stands in the whole corpus: one partial count per term and task reaches Spark's sum."""
    n_terms = len(queries.value.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, ends in zip(batch["terms"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                for t, a, b in _present(terms, ends, queries.value.number):
                    total[t] += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=("term", "n"))

    out = np.zeros(n_terms, np.int64)
    for row in index.select("terms", "ends").mapInArrow(tidy(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


def _starts(terms: list[int], rarity: np.ndarray, lists: dict[int, np.ndarray], doc_of: np.ndarray, slop: int) -> np.ndarray:
    """Where a window occurs in the block: its terms' lists intersected, the rarest first."""
    starts = None
    for k in sorted(range(len(terms)), key=lambda k: (rarity[terms[k]], k)):
        shifted = lists[terms[k]] - k
        if starts is None:
            starts = shifted[shifted >= 0]
        else:
            at = np.minimum(np.searchsorted(shifted, starts), len(shifted) - 1)
            near = np.abs(shifted[at] - starts)
            if slop:
                near = np.minimum(near, np.abs(shifted[np.maximum(at - 1, 0)] - starts))
            starts = starts[near <= slop]
        if not len(starts):
            return starts
    last = np.minimum(starts + len(terms) - 1, len(doc_of) - 1)
    return starts[(doc_of[starts] == doc_of[last]) & (starts + len(terms) <= len(doc_of))]


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, unnamed: bool = False) -> DataFrame:
    """(key, n_words, spans, items) per document of the index: spans are the hit words' ranges [start, end) in ascending
    order, disjoint, and items are the ids, as strings, of the items with windows that occur, sorted."""
    named = items if unnamed else items.filter("item_id is not null")
    known = named.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    parts: list[DataFrame] = []
    block: list[Item] = []
    size = 0
    for row in known.toLocalIterator():
        text = (row.text or "").encode()
        if block and size + len(text) > BENCHMARK_BYTES:
            parts.append(_search(index, block, width, slop))
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    parts.append(_search(index, block, width, slop))
    return (parts[0] if len(parts) == 1 else _merged(parts)).drop("block", "place")


def find(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, unnamed: bool = False, key: str = "doc_id") -> DataFrame:
    """`search` in an index made for it; the key's column comes back under its name."""
    return search(build(docs, key), items, width, slop, unnamed).withColumnRenamed("key", key)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The answers to the parts of a large benchmark as one."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    gathered = every.groupBy("block", "place").agg(
        F.any_value("key").alias("key"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # spans in order of their starts: one that begins within the last one so far lengthens it
    spans = F.expr("""aggregate(_all, cast(array() AS array<struct<start: bigint, end: bigint>>), (done, x) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).end >= x.start
        THEN concat(slice(done, 1, size(done) - 1),
                    array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end))))
        ELSE concat(done, array(x)) END)""")
    return gathered.select("block", "place", "key", "n_words", spans.alias("spans"), "items")


def _search(index: DataFrame, block: list[Item], width: int, slop: int) -> DataFrame:
    spark = index.sparkSession
    q = Queries(sorted(block, key=lambda x: (x[0] is not None, x[0] or "", x[1])), width)
    q.enter(_rarity(index, spark.sparkContext.broadcast(q)))
    shared = spark.sparkContext.broadcast(q)
    kind = index.schema["keys"].dataType.elementType

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                number, packed_terms, packed_ends, packed = (batch[c][r].as_py() for c in ("block", "terms", "ends", "postings"))
                keys = batch["keys"][r].values
                n_words = batch["n_words"][r].values.to_numpy()
                n = len(n_words)
                doc_of = np.repeat(np.arange(n), n_words)
                first = np.concatenate(([0], np.cumsum(n_words)[:-1])) if n else n_words
                present = _present(packed_terms, packed_ends, q.number)
                windows = q.candidates([t for t, _, _ in present])
                edge = np.zeros(len(doc_of) + 1, np.int32)
                owners: dict[int, set[int]] = defaultdict(set)
                if len(windows):
                    at = np.cumsum(_unpack(packed), dtype=np.int64)
                    lists = {t: at[a:b] for t, a, b in present}
                for w in windows.tolist():
                    length = int(q.length[w])
                    starts = _starts(q.sequence[q.start[w] : q.start[w] + length].tolist(), q.rarity, lists, doc_of, slop)
                    if len(starts):
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + length, -1)
                        for d in np.unique(doc_of[starts]).tolist():
                            owners[d].add(int(q.item[w]))
                inside = np.append(np.cumsum(edge[:-1]) > 0, False)
                spans: dict[int, list[list[int]]] = defaultdict(list)
                # a hit run may touch the next document's: runs are cut at the documents' bounds
                for s, e in zip(*textkit.word_spans(inside), strict=True):
                    while s < e:
                        d = int(doc_of[s])
                        stop = min(int(e), int(first[d] + n_words[d]))
                        spans[d].append([int(s - first[d]), int(stop - first[d])])
                        s = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number, np.int64)),
                        pa.array(np.arange(n, dtype=np.int64)),
                        keys,
                        pa.array(n_words, pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in spans.get(d, [])] for d in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted({q.names[i] for i in owners.get(d, ()) if q.names[i] is not None}) for d in range(n)], pa.list_(pa.string())),
                    ],
                    names=("block", "place", "key", "n_words", "spans", "items"),
                )

    return index.mapInArrow(tidy(part), f"block long, place long, key {kind.simpleString()}, n_words long, spans array<struct<start: long, end: long>>, items array<string>")
