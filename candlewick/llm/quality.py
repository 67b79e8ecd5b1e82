"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its words, its words' character n-grams (with the separators around a word as part of it)
and its pairs of neighbouring words, hashed into buckets.  Every bucket has a learned vector; the mean of a document's
vectors goes through a linear layer and a softmax.  Training is plain stochastic gradient descent in numpy on a
bounded sample of labelled rows.  Since everything before the softmax is linear, scoring needs one number per bucket:
a document's logit is the mean of its features' numbers plus a bias, computed over whole texts in a few passes.

Defined results: a null, empty or blank text has no features and gets the bias alone; repeated rows get equal
scores; rows whose label is null or not 0 or 1 are not learned from; a doc_id labelled several times has its largest
label; without labels of both kinds the score is the (smoothed) share of label 1; a very long text is scored whole, in
memory; an empty table gives an empty result.  Only `text` is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm import textkit
from candlewick.llm.runtime import give_back, small_batches, tidy

U64 = np.uint64


@dataclass(frozen=True)
class Config:
    """max_rows bounds the labelled rows learned from, and so the memory of training: 8 bytes per distinct feature of a row."""

    buckets: int = 1 << 18
    dim: int = 12
    ngrams: tuple[int, ...] = (2, 4)
    max_rows: int = 6_000
    epochs: int = 6
    rate: float = 4.0
    seed: int = 3


def features(rows: list[bytes], config: Config) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers of all features of `rows`, kind by kind, and where each row's begin (one more bound at the end).

    A kind's features of one row are contiguous and in text order.
    """
    raw, start, end = textkit.buffer(rows)
    prefix = textkit.Prefix(raw)
    low = U64(config.buckets - 1)
    s, e = textkit.word_spans(~textkit.IS_SPACE[raw])
    bounds = np.append(np.searchsorted(s, start), len(s))
    word = prefix.hash(s, e)
    yield ((word ^ U64(0x51)) & low).astype(np.int64), bounds
    pair = textkit.fmix(word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:]) if len(word) > 1 else word[:0]
    # the pair that spans two rows belongs to none: it stands last in its row and is given to the padding bucket
    pair = (pair & low).astype(np.int64)
    inner = bounds[1:-1]
    pair[inner[(inner > 0) & (inner <= len(pair))] - 1] = config.buckets
    yield pair, np.minimum(bounds, len(pair))
    for n in config.ngrams:
        at = np.arange(max(0, len(raw) - n + 1))
        if len(at):
            # not through Prefix.hash: all lengths are equal, so one multiplication per position is left
            h = (prefix.sums[n:] - prefix.sums[: len(at)]) * prefix.inv[: len(at)]
            h = ((textkit.fmix(h + U64(n)) >> U64(7)) & low).astype(np.int64)
        else:
            h = at
        # an n-gram may take in the separator after its row, not the next row's text
        last = np.maximum(start, np.minimum(end + 1 - n + 1, len(h)))
        keep = np.zeros(len(h) + 1, np.int8)
        np.add.at(keep, np.minimum(start, len(h)), 1)
        np.add.at(keep, np.minimum(last, len(h)), -1)
        inside = np.cumsum(keep[:-1]) > 0
        h[~inside] = config.buckets
        yield h, np.append(np.minimum(start, len(h)), len(h))


def counts(rows: list[bytes], config: Config) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct buckets and how often they occur."""
    kinds = list(features(rows, config))
    out = []
    for d in range(len(rows)):
        own = np.concatenate([h[b[d] : b[d + 1]] for h, b in kinds])
        out.append(np.unique(own[own < config.buckets], return_counts=True))
    return out


@dataclass
class Model:
    """One number per bucket, of which a document's features are averaged, and the bias."""

    weight: np.ndarray
    bias: float
    config: Config

    def logits(self, rows: list[bytes]) -> np.ndarray:
        w = np.append(self.weight, np.float32(0.0)).astype(np.float32)
        total, n = np.zeros(len(rows)), np.zeros(len(rows))
        for h, bounds in features(rows, self.config):
            sums = np.zeros(len(h) + 1)
            np.cumsum(w[h], out=sums[1:], dtype=np.float64)
            real = np.zeros(len(h) + 1, np.int64)
            np.cumsum(h < self.config.buckets, out=real[1:])
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            n += real[bounds[1:]] - real[bounds[:-1]]
        return self.bias + total / np.maximum(n, 1)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], config: Config) -> Model:
    """From rows of (distinct buckets, counts, label)."""
    rng = np.random.default_rng(config.seed)
    positive = sum(y for _, _, y in samples)
    base = float(np.log((positive + 1) / (len(samples) - positive + 1)))
    if positive in (0, len(samples)):
        return Model(np.zeros(config.buckets, np.float32), base, config)
    vectors = rng.uniform(-1 / config.dim, 1 / config.dim, (config.buckets, config.dim)).astype(np.float32)
    out = np.zeros((2, config.dim), np.float32)
    out_bias = np.array([-base / 2, base / 2], np.float32)
    steps, step = config.epochs * len(samples), 0
    for _ in range(config.epochs):
        for k in rng.permutation(len(samples)).tolist():
            at, c, y = samples[k]
            share = (c / max(1, c.sum())).astype(np.float32)
            rate = config.rate * (1 - step / steps)
            step += 1
            own = vectors[at]
            hidden = share @ own
            z = out @ hidden + out_bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = -p
            g[y] += 1
            back = g @ out
            out += 0.2 * rate * np.outer(g, hidden)
            out_bias += 0.02 * rate * g
            vectors[at] = own + rate * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(out_bias[1] - out_bias[0]), config)


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Learns from (doc_id, text) and (doc_id, label), from at most config.max_rows labelled rows.

    The sample is the labelled rows whose hashed doc_id is smallest; of several texts of one doc_id it takes the one
    with the smallest hash.  Executors turn it into feature counts, of whole texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(config.max_rows)
    )
    # at most max_rows rows, so the broadcasts are bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    picked = texts.drop("text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("version").alias("version"))
    sample = texts.join(F.broadcast(picked), ["doc_id", "version"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.chunks(batch["text"]):
                at, n = [], []
                for i, c in counts(textkit.as_bytes(batch["text"].slice(lo, hi - lo)), config):
                    at.append(i.astype("<i4").tobytes())
                    n.append(c.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), batch["label"].slice(lo, hi - lo), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                    names=("doc_id", "label", "at", "n"),
                )

    rows = sample.mapInArrow(tidy(count), "doc_id long, label int, at binary, n binary").toLocalIterator()
    got = sorted(((r.doc_id, np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<i4"), r.label) for r in rows), key=lambda r: r[0])
    model = train([(at, n, y) for _, at, n, y in got], config)
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The columns of `docs` with `score` (0 to 1) and `predicted`; columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*docs.select(*kept).schema.fields, *added])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [shared.value.logits(textkit.as_bytes(batch["text"].slice(lo, hi - lo))) for lo, hi in textkit.chunks(batch["text"])]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"]
            )

    return docs.select(*kept).mapInArrow(tidy(part), schema)


def accept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with a score of at least `threshold`, with their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.chunks(batch["text"]):
                z = shared.value.logits(textkit.as_bytes(batch["text"].slice(lo, hi - lo)))
                yield batch.slice(lo, hi - lo).filter(pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) >= threshold))

    return docs.mapInArrow(tidy(part), docs.schema)


def held_out(doc_id: str = "doc_id"):
    """One row in five by the CRC-32 of the doc_id's text, which is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
