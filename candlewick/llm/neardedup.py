"""MinHash near-dedup by a signature-coordinate inverted join.

A document's signature has `coordinates` MinHash values; each coordinate-value pair is a token under which the document
is posted.  Two documents whose shingle sets have a Jaccard similarity of the threshold agree in a binomial number of
coordinates, so pairs below a match threshold some 4.5 standard deviations under its mean are let go (a chance below
1e-5 for a pair right at the threshold).  Tokens have one order, rare ones first as far as a table of counters of fixed
size tells: signatures that share `t` of `k` tokens share one among the first k - t + 1 of each, so only this prefix is
posted, and what is posted under a token once is skipped.  The other coordinates are only looked at for candidates.

1. Lists are merged: every member is a candidate with its list's first member, once however many lists they share; a
   candidate's collisions are counted over all coordinates, and what matches connects documents to families.
2. In lists whose members are in several families, those outside the largest meet all others, in cells of bounded size.
   Collisions are counted there coordinate by coordinate, and pairs that can no longer reach the threshold are skipped.
3. Links are confirmed on full shingle sets, most collisions first; pairs that are connected already are skipped.  The
   texts of a family are dealt once into blocks, and its first text goes into each; of a family that is not one
   component after that, the documents outside the largest component meet all others in cells of bounded size.

So a group of a third of all rows costs work in proportion to its size as long as most of it is one component.  Cells
return spanning forests, never all pairs.

Words are what 0x20 and 0x09-0x0D separate, A-Z lower-cased; a set is the distinct shingles of five words, as 64-bit
hashes; fewer words are one shingle.  Equal sets are one node from the start, and the sets of one doc_id are linked with
each other.  Defined results: a null, empty or blank text has no shingles and links with nothing, but belongs to where
its doc_id's other rows belong; a pair exactly at the threshold is linked; a row whose doc_id is null links with
nothing, has no component and is kept; a text of any length is one set, held in memory by the task that handles it; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import cells, counters, textkit
from candlewick.llm.components import components, roots
from candlewick.llm.runtime import cut, partitions, small_batches, tidy

U64 = np.uint64
COORDINATES = 64
BLOCK = 1_024
#: Postings of one token that a task merges, beyond what a counter holds on average.
LIST_ROWS = 1_000_000
_MULTIPLIERS = np.random.default_rng(808).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 32-bit MinHash values per document; documents without shingles have the largest values."""
    out = np.full((len(at) - 1, COORDINATES), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(np.diff(at) > 0)
    if len(has):
        for k in range(COORDINATES):
            h = hashes * _MULTIPLIERS[k]
            out[has, k] = np.minimum.reduceat((h ^ (h << U64(17))) >> U64(32), at[has]).astype(np.uint32)
    return out


def match_threshold(percent: int, k: int = COORDINATES) -> int:
    p = percent / 100
    return max(1, int(k * p - 4.5 * (k * p * (1 - p)) ** 0.5))


def _describe(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, version, n_shingles, set_id, signature) per row; `version` is a hash of the text."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.chunks(batch["text"]):
                h, at = textkit.shingles(textkit.as_bytes(batch["text"].slice(lo, hi - lo)), shingle)
                sig = signatures(h, at)
                n = hi - lo
                ids = [xxhash.xxh3_128_digest(h[at[d] : at[d + 1]].tobytes()) for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(lo, n),
                        batch["version"].slice(lo, n),
                        pa.array(np.diff(at)),
                        pa.array(ids, pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=("doc_id", "version", "n_shingles", "set_id", "signature"),
                )

    return rows.mapInArrow(tidy(part), "doc_id long, version long, n_shingles long, set_id binary, signature binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of coordinates per signature."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _tokens(column: pa.Array) -> np.ndarray:
    """A row of tokens per document: coordinate and value."""
    return _matrix(column).astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)


def _lists(classes: DataFrame, least: int) -> DataFrame:
    """(token, node, first, split): the postings of prefix tokens that occur more than once, with their list's first node.

    A token that is far more frequent than others is split by node into several lists.
    """
    spark = classes.sparkSession

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _tokens(batch["signature"]).reshape(-1).astype(U64)

    shared = spark.sparkContext.broadcast(counters.count(classes.select("signature"), hashes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shared.value
        usual = int(np.median(total))
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, node = _tokens(batch["signature"]), batch["node"].to_numpy()
            n = total[counters.slots(tokens.astype(U64))]
            order = np.lexsort((tokens, n))[:, : COORDINATES - least + 1]
            own, n = np.take_along_axis(tokens, order, 1), np.take_along_axis(n, order, 1)
            lists = 1 + np.maximum(0, n - usual) // LIST_ROWS
            share = (textkit.fmix(node.astype(U64)) >> U64(8)).astype(np.int64)[:, None] % lists
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.reshape(-1)), pa.array(np.repeat(node, own.shape[1])), pa.array(np.where(lists > 1, share + 1, 0).astype(np.int32).reshape(-1))],
                names=("token", "node", "split"),
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, alone = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            token, node, split = (batch[c].to_numpy() for c in ("token", "node", "split"))
            new = np.append(True, (token[1:] != token[:-1]) | (split[1:] != split[:-1]))
            new[0] = last != (token[0], split[0])
            start = np.flatnonzero(new)
            head = np.full(len(token), first)
            if len(start):
                head[start[0] :] = np.repeat(node[start], np.diff(np.append(start, len(token))))
            # a list's first member is passed on when the second comes, or at once in a split list
            again = ~new | (split > 0)
            opens = np.flatnonzero(~new[1:] & new[:-1] & (split[:-1] == 0))
            again[opens] = True
            out = [token[again], node[again], head[again], split[again]]
            if not new[0] and alone:
                out = [np.concatenate(([x], y)) for x, y in zip((token[0], first, first, 0), out, strict=True)]
            alone = bool(new[-1]) and split[-1] == 0
            last, first = (token[-1], split[-1]), int(head[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in out[:3]] + [pa.array(out[3].astype(np.int32))], names=("token", "node", "first", "split")
            )

    posted = classes.select("node", "signature").mapInArrow(tidy(post), "token long, node long, split int")
    dealt = posted.repartition(partitions(spark), "token", "split").sortWithinPartitions("token", "split", "node")
    return cut(dealt.mapInArrow(tidy(merge), "token long, node long, first long, split int"))


def _collisions(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `a`, row of `b`, coordinates in common) where at least `least` are.

    After half of the coordinates, pairs that the other half cannot bring to `least` are skipped.
    """
    half = COORDINATES // 2
    n = np.zeros((len(a), len(b)), np.uint8)
    for k in range(half):
        n += a[:, k][:, None] == b[:, k][None, :]
    x, y = np.nonzero(n >= least - half)
    n = n[x, y].astype(np.int64)
    for lo in range(0, len(x), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        n[part] += (a[x[part], half:] == b[y[part], half:]).sum(1)
    hit = n >= least
    return x[hit], y[hit], n[hit]


def _cell_matches(sig: np.ndarray, cell: pa.Table, component: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that match across a cell's two blocks, or within its one."""
    left, right, two = cells.blocks(cell)
    a, b, n = _collisions(sig[left], sig[right], least)
    a, b = left[a], right[b]
    new = component[a] != component[b]
    if not two:
        new &= a < b
    return a[new], b[new], n[new]


def _families(classes: DataFrame, least: int) -> DataFrame:
    """(node, component): documents connected by signatures that match."""
    lists = _lists(classes, least)
    signed = classes.select("node", "signature")
    stars = lists.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    # the first nodes of a split token's lists are candidates of each other
    heads = lists.filter("split > 0 AND node = first").select("token", "first")
    crown = heads.join(heads.groupBy("token").agg(F.min("first").alias("b")), "token").filter("first <> b").select(F.col("first").alias("a"), "b")
    candidates = stars.union(crown).distinct()

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = (_matrix(batch["x"]) == _matrix(batch["y"])).sum(1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(hit))

    paired = candidates.join(signed.toDF("a", "x"), "a").join(signed.toDF("b", "y"), "b").select("a", "b", "x", "y")
    first = cut(paired.mapInArrow(tidy(matching), "a long, b long"), narrow=True)

    def connect(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        node, component = cell["node"].to_numpy(), cell["component"].to_numpy()
        a, b, _ = _cell_matches(_matrix(cell["signature"]), cell, component, least)
        root = roots(len(node), a, b)
        hit = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[root[hit]])], names=("a", "b"))

    placed = lists.select("token", "node").join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = cut(cells.sides(placed, ["token"], "node", "component", BLOCK))
    rest = cells.each(dealt.join(signed, "node"), ["token"], "node", connect, "a long, b long")
    return components(first.union(rest))


def _confirm(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _links(families: DataFrame, classes: DataFrame, rows: DataFrame, percent: int, shingle: int, least: int) -> DataFrame:
    """(a, b): confirmed links that connect the nodes of each family as all its links would."""

    def confirm(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        node = cell["node"].to_numpy()
        texts = textkit.as_bytes(cell["text"].combine_chunks() if cell["text"].num_chunks != 1 else cell["text"].chunk(0))
        sets: list[np.ndarray] = []
        sig = np.zeros((len(node), COORDINATES), np.uint32)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= textkit.CHUNK_BYTES):
                size += len(texts[hi])
                hi += 1
            h, at = textkit.shingles(texts[lo:hi], shingle)
            sig[lo:hi] = signatures(h, at)
            sets += [h[at[d] : at[d + 1]] for d in range(hi - lo)]
            lo = hi
        label = cell["component"].to_numpy().copy()
        a, b, n = _cell_matches(sig, cell, label, least)
        found: list[tuple[int, int]] = []
        for k in np.argsort(-n, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            if label[i] != label[j] and _confirm(sets[i], sets[j], percent):
                found.append((i, j))
                label[label == label[j]] = label[i]
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[[i for i, _ in found]], pa.int64()), pa.array(node[[j for _, j in found]], pa.int64())], names=("a", "b")
        )

    def texts_of(members: DataFrame) -> DataFrame:
        """`members` with the text of each node; repeated rows give one."""
        found = members.join(classes.select("node", "doc_id", "version"), "node").join(rows, ["doc_id", "version"])
        return found.groupBy("doc_id", "version", *members.columns).agg(F.max("text").alias("text"))

    # a family's number is its first node
    members = families.select("node", F.col("component").alias("family"))
    sized = members.join(members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")), "family")
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("_blocks")).cast("int")
    every = F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(own))
    sized = cut(sized, narrow=True)
    dealt = (
        texts_of(sized)
        .withColumn("_i", F.explode(every))
        .select("node", "family", F.col("node").alias("component"), "text", F.col("family").alias("_group"), "_i", F.col("_i").alias("_j"), F.lit(False).alias("_second"))
    )
    first = cut(cells.each(dealt, ["family"], "node", confirm, "a long, b long"), narrow=True)
    large = sized.filter("_blocks > 1").select("node", "family")
    if not large.limit(1).count():
        return first
    placed = large.join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = cells.sides(placed, ["family"], "node", "component", BLOCK)
    meeting = cut(across, narrow=True)
    texts = texts_of(meeting.select("node").distinct()).select("node", "text")
    return first.union(cells.each(meeting.join(texts, "node"), ["family"], "node", confirm, "a long, b long"))


def link(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents link where 100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    least = match_threshold(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    described = cut(_describe(rows, shingle))
    known = F.col("doc_id").isNotNull()
    with_set = described.filter(known & (F.col("n_shingles") > 0))
    classes = cut(
        with_set.groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "version")).alias("own"), F.first("signature").alias("signature"))
        .select("set_id", "own.doc_id", "own.version", "signature", F.monotonically_increasing_id().alias("node"))
    )
    families = _families(classes, least)
    links = _links(families, classes, rows, percent, shingle, least)

    placed = cut(with_set.select("doc_id", "n_shingles", "set_id").join(classes.select("set_id", "node", F.col("doc_id").alias("low")), "set_id").drop("set_id"), narrow=True)
    several = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b < top")
    within = placed.join(several, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")
    linked = components(links.union(within))
    lowest = linked.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    target = linked.join(lowest, "component").select("node", "component_id")
    found = placed.join(target, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "low").alias("component_id"))
    blank = described.filter(known & (F.col("n_shingles") == 0)).select("doc_id", "n_shingles")
    elsewhere = found.join(blank.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    blank = blank.join(elsewhere, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = described.filter(~known).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = found.union(blank).union(nameless)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
