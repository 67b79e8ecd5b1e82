"""Embedding near-dedup: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation of the principal axes is learned on a bounded sample so that the signs of the rotated vectors are balanced
and close to the vectors; they are a code of up to 64 bits.  A code is cut into as many pieces as there are Hamming
tables, each piece the key of one.  A table is searched within a radius: vectors meet if their pieces differ in at most
`radius` bits.  For radius 1 a vector is stored under its own key, and if that has an odd number of ones, it also looks
under all keys one bit away: of two keys one bit apart, one is odd.  Tables and radius are the same for every size of
input, so that which pairs meet does not change with the number of rows.

Only identifiers and codes are sent to the tables.  Codes that meet are compared bit by bit, and pairs further apart
than vectors at the threshold get with a chance of about 1e-5 are let go.  The vectors themselves go to cells in which
pairs are left, once each, and are compared by cosine in double precision, if their labels are equal.  A pair that meets
in several tables counts in the first.  Equal vectors of one label are one node that is compared once and counted as
often as it has members.

Pieces of 9-10 bits within one bit find a pair right at a cosine of 0.93, isotropic and not learned from, with a chance of
0.9998, and unrelated codes meet with an expected sum over the tables of 0.13 of their pairs.  Defined results: a
vector that is null, empty, all zeros, or has null or non-finite components, or has no label, links with nothing and is
its own component; vectors of different lengths are never linked; a pair whose cosine is the threshold is linked, as far
as double precision tells; repeated rows link with each other, whatever their vec_ids; an empty table gives an empty
result.  A row whose vec_id is null comes back without links and with no component.
"""

from __future__ import annotations

import functools
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm import cells, counters, textkit
from candlewick.llm.components import components, roots
from candlewick.llm.runtime import cut, fresh_dir, small_batches

#: Vectors of one length that its rotation is learned from, the smallest by a hash.
SAMPLE = 10_000
BLOCK = 1_024
#: Hamming tables, and the bits in which the pieces of vectors that meet in one may differ.
TABLES, RADIUS = 7, 1
U64 = np.uint64


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for codes of at most `bits` bits, from unit vectors as rows."""
    dim = x.shape[1]
    bits = min(bits, dim)
    random = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    if len(x) < 2 * dim:
        return np.zeros(dim), random[:, :bits]
    mean = x.mean(0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    z = (x - mean) @ axes[:, ::-1][:, :bits]
    turn = np.linalg.qr(random[:bits, :bits])[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ v).T
    return mean, axes[:, ::-1][:, :bits] @ turn


def most_bits_apart(threshold: float, bits: int) -> int:
    """Bits in which codes differ at the threshold, and 4.5 standard deviations more."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def _masks(bits: int, tables: int) -> list[np.ndarray]:
    """The bits of a code that are the key of each table, each as a power of two."""
    return np.array_split(U64(1) << np.arange(bits, dtype=U64), min(tables, bits))


def _codes(code_bits: np.ndarray) -> np.ndarray:
    return (code_bits.astype(U64) << np.arange(code_bits.shape[1], dtype=U64)).sum(1, dtype=U64)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def postings(codes: np.ndarray, bits: int, tables: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(table, rows, keys, whether the rows only look there) for all tables."""
    every = np.arange(len(codes))
    for t, powers in enumerate(_masks(bits, tables)):
        key = codes & powers.sum(dtype=U64)
        yield t, every, key, False
        if radius:
            odd = np.flatnonzero(np.bitwise_count(key) & 1)
            for p in powers:
                yield t, odd, key[odd] ^ p, True


@functools.lru_cache(16)
def _rotation(path: str) -> tuple[np.ndarray, np.ndarray]:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f, np.load(io.BytesIO(f.read())) as got:
        return got["mean"], got["turn"]


def _learn(classes: DataFrame) -> dict[int, str]:
    """The file of the rotation learned for each length of vectors; executors read those of the lengths they meet."""
    out = fresh_dir(classes.sparkSession, "rotations")

    def learn(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        mean, turn = learn_rotation(_units(np.array(own.sort_values("node")["v"].tolist(), np.float64)))
        buffer = io.BytesIO()
        np.savez(buffer, mean=mean, turn=turn)
        store, base = fs.FileSystem.from_uri(out)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{key[0]}.npz") as f:
            f.write(buffer.getvalue())
        return pd.DataFrame({"d": [key[0]]})

    place = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("node"), "node"))
    sample = classes.select("node", "v", F.size("v").alias("d")).withColumn("place", place).filter(F.col("place") <= SAMPLE).drop("place")
    return {r.d: f"{out}/{r.d}.npz" for r in sample.groupBy("d").applyInPandas(learn, "d int").toLocalIterator()}


def link(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, radius: int = RADIUS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    small_batches(spark, 2_048)
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    # adding 0 makes -0 and 0 equal in the keys of classes
    value = F.transform(F.col("embedding").cast("array<double>" if wide else "array<float>"), lambda x: x + F.lit(0.0).cast("double" if wide else "float"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("ok", usable).withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "v")))
    # copies are one class, pre-aggregated by task before the shuffle
    grouped = marked.filter("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    models = spark.sparkContext.broadcast(_learn(classes))

    def coded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(rows, codes, bits, a hash of label and length) for the lengths of vectors in a batch."""
        labels = [xxhash.xxh3_64_intdigest(x.encode()) for x in batch["label"].to_pylist()]
        lists = batch["v"].to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(lists):
            by_size.setdefault(len(v), []).append(i)
        for d, at in by_size.items():
            mean, turn = _rotation(models.value[d])
            code = _codes((_units(np.array([lists[i] for i in at], np.float64)) - mean) @ turn > 0)
            yield np.array(at), code, turn.shape[1], textkit.fmix(np.array([labels[i] for i in at], U64) + U64(d))

    def buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, np.ndarray, int]]:
        for at, code, bits, salt in coded(batch):
            for t, own, key, looks in postings(code, bits, tables, radius):
                yield t, at[own], textkit.fmix(key + textkit.fmix(salt[own] + U64(t))), looks, code[own], bits

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, bucket, *_ in buckets(batch):
            yield bucket

    sizes = spark.sparkContext.broadcast(counters.count(classes.select("label", "v"), hashes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy()
            for t, at, bucket, looks, code, bits in buckets(batch):
                blocks = -(-sizes.value[counters.slots(bucket)] // BLOCK)
                own = (textkit.fmix(node[at].astype(U64)) >> U64(20)).astype(np.int64) % blocks
                row = np.repeat(np.arange(len(at)), blocks)
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                i, j = np.minimum(own[row], other), np.maximum(own[row], other)
                cell = bucket[row] ^ textkit.fmix((i.astype(U64) << U64(32)) + j.astype(U64))
                meta = t | looks << 8 | (own[row] > i).astype(np.int64) << 9 | (i != j).astype(np.int64) << 10 | bits << 16
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.view(np.int64)), pa.array(meta), pa.array(node[at][row]), pa.array(code[row].view(np.int64))], names=("cell", "meta", "node", "code")
                )

    posted = classes.select("node", "label", "v").mapInArrow(post, "cell long, meta long, node long, code long")

    def pairs(cell: pa.Table, near) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a cell that are near by `near` and do not meet in an earlier table."""
        meta, node, code = (cell[c].to_numpy() for c in ("meta", "node", "code"))
        code = code.view(U64)
        t, two, bits = int(meta[0]) & 0xFF, bool(meta[0] >> 10 & 1), int(meta[0]) >> 16
        looks, second = (meta >> 8 & 1).astype(bool), (meta >> 9 & 1).astype(bool)
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if two else (np.arange(len(node)),) * 2
        a, b = near(code, bits, left, right)
        new = (node[a] != node[b]) & ~(looks[a] & looks[b])
        if not two:
            new &= a < b
        differ = code[a] ^ code[b]
        for powers in _masks(bits, tables)[:t]:
            new &= np.bitwise_count(differ & powers.sum(dtype=U64)) > radius
        return a[new], b[new]

    def close(code: np.ndarray, bits: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.nonzero(np.bitwise_count(code[left][:, None] ^ code[right][None, :]) <= most_bits_apart(threshold, bits))
        return left[a], right[b]

    def meet(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = pairs(cell, close)
        if len(a):
            yield from cell.take(np.unique(np.concatenate((a, b)))).to_batches()

    met = cut(cells.grouped(posted, ["cell"], ["cell"], "node", meet, "cell long, meta long, node long, code long"))

    def compare(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, label = cell["node"].to_numpy(), cell["n"].to_numpy(), np.array(cell["label"].to_pylist(), object)
        vectors = cell["v"].combine_chunks()
        size = vectors.value_lengths().to_numpy()
        links, ends = np.zeros(len(node), np.int64), []

        def alike(code: np.ndarray, bits: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = []
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                x = np.zeros((len(node), d))
                x[own] = _units(vectors.take(pa.array(own)).flatten().to_numpy().astype(np.float64).reshape(len(own), d))
                ld, rd = left[size[left] == d], right[size[right] == d]
                a, b = np.nonzero(x[ld] @ x[rd].T >= threshold)
                found.append((ld[a], rd[b]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            same = label[a] == label[b]
            return a[same], b[same]

        a, b = pairs(cell, alike)
        if not len(a):
            return
        links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
        root = roots(len(node), a, b)
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[root[hit]])], names=("node", "links", "root"))

    wide_rows = met.join(classes.select("node", "n", "label", "v"), "node")
    found = cut(cells.grouped(wide_rows, ["cell"], ["cell"], "node", compare, "node long, links long, root long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lowest = joined.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))
    per_class = (
        classes.select("k1", "k2", "node", "rep", "n")
        .join(linked, "node", "left")
        .join(joined.join(lowest, "component").select("node", "lowest"), "node", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("lowest", "rep").alias("component_id"))
    )
    component = F.coalesce("component_id", "vec_id")
    return marked.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
