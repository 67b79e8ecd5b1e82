"""Line dedup: lines that several documents share stay in the first of them only.

Two Bloom filters over the hashes of all lines tell which may repeat; only those are shuffled, as 128-bit BLAKE2
digests with their doc_id, to confirm that at least two documents hold them and to find the first.  Keys that make up a
ten-thousandth of the suspects are at most ten thousand, so these are broadcast, and no task gets all rows of such a
key.  A third filter, over the documents that lose lines, tells which texts have to meet their drops in a shuffle; all
others are passed on where they are read.

A line's key is the line stripped of 0x20 and 0x09-0x0D at both ends, with A-Z lower-cased.  Defined results: a null
or empty text is one empty line and comes back empty; a key repeated within one document only stays; rows of one
doc_id count as one document; a null doc_id is one document after all others; a text of any length is split in memory
by the task that reads it; an empty table gives an empty result.
Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import bloom
from candlewick.llm.runtime import cut, small_batches
from candlewick.llm.textkit import as_bytes, fmix

_WHITE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id in comparisons.
_LAST = (1 << 63) - 1
#: Rows from which a key is joined by broadcast, and the share of all rows (one in so many) that it must have as well.
HOT_ROWS, HOT_SHARE = 1_000, 10_000


def keys(text: bytes, least: int) -> list[bytes | None]:
    """Each line's key, None where it has fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        k = line.strip(_WHITE).lower()  # of bytes: A-Z only
        out.append(k if len(k) >= 4 * least or len(k) >= least and len(k.decode("utf-8", "replace")) >= least else None)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): the texts without the lines that an earlier document holds too."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    words = bloom.words_for(n_lines or 0)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        found: list[int] = []
        for text in as_bytes(batch["text"]):
            found += {xxhash.xxh3_64_intdigest(k) for k in keys(text, least) if k is not None}
        yield np.array(found, np.uint64)

    twice = spark.sparkContext.broadcast(bloom.repeated(rows.select("text"), hashes, words))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[bytes] = []
            for i, text in enumerate(as_bytes(batch["text"])):
                own = {k for k in keys(text, least) if k is not None}
                at += [i] * len(own)
                found += own
            hit = bloom.holds(twice.value, np.array([xxhash.xxh3_64_intdigest(k) for k in found], np.uint64)).nonzero()[0].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array([at[i] for i in hit], pa.int64())), pa.array([_digest(found[i]) for i in hit], pa.binary())],
                names=("doc_id", "key"),
            )

    place = F.coalesce("doc_id", F.lit(_LAST))
    maybe = cut(rows.mapInArrow(suspects, "doc_id long, key binary").select(place.alias("place"), "key"))
    # partial aggregation leaves one row per key and task before the shuffle
    counted = cut(maybe.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").drop("last"))
    hot = F.col("n") >= max(HOT_ROWS, maybe.count() / HOT_SHARE)
    marked = maybe.join(F.broadcast(counted.filter(hot).select("key", F.col("first").alias("hot"))), "key", "left")
    common = marked.filter("place > hot").select("place", "key")
    rare = marked.filter("hot IS NULL").select("place", "key").join(counted.filter(~hot).select("key", "first"), "key").filter("place > first").select("place", "key")
    drops = cut(common.union(rare).groupBy("place").agg(F.collect_set("key").alias("drop")))

    def losing(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.repeat(fmix(batch["place"].to_numpy().astype(np.uint64)), 2)

    losers = spark.sparkContext.broadcast(bloom.repeated(drops.select("place"), losing, bloom.words_for(drops.count())))

    def parted(lose: bool):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = bloom.holds(losers.value, fmix(batch["place"].to_numpy().astype(np.uint64)))
                yield batch.filter(pa.array(hit == lose))

        return part

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, drop in zip(as_bytes(batch["text"]), batch["drop"].to_pylist(), strict=True):
                lines = text.split(b"\n")
                total.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x, k in zip(lines, keys(text, least), strict=True) if k is None or _digest(k) not in gone]
                    text = b"\n".join(lines)
                dropped.append(total[-1] - len(lines))
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                names=("doc_id", "text", "n_lines", "n_dropped"),
            )

    placed = rows.withColumn("place", place)
    columns = "doc_id long, text string, place long"
    untouched = placed.mapInArrow(parted(False), columns).withColumn("drop", F.lit(None).cast("array<binary>"))
    met = placed.mapInArrow(parted(True), columns).join(drops, "place", "left")
    out = "doc_id long, text string, n_lines long, n_dropped long"
    both = (d.select("doc_id", "text", "drop").mapInArrow(apply, out) for d in (untouched, met))
    return next(both).union(next(both))
