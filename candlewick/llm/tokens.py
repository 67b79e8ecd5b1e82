"""Token-ID output: texts to ids, ids to plane-shuffled binary files, and back.

Documents are dealt by ranges of doc_id and, among equal ones, of their texts' beginnings; each partition sorts its own
and writes one file, so the files in order hold the ids of all documents in ascending doc_id order.  A retried task writes a file of its own first and renames it.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; repeated rows are written as
often as they come, those of one doc_id in order of their text; a very long text is encoded in parts of the same ids;
an empty table makes no file and an empty result.
Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.bpe import CALL_CHARS, Encoder
from candlewick.llm.planes import Reader, Writer
from candlewick.llm.runtime import cut, fresh_dir, partitions, small_batches, tidy

END_ID = 2
_FILES = "file_no int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = END_ID, planes: str = "byte") -> DataFrame:
    """Writes the files under `out`, a URI that all executors can write to, and returns their list.

    The list has one row per file: (file_no, path, n_docs, n_ids), file_no ascending with doc_id.
    """
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        no = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(out)
        store.create_dir(base, recursive=True)
        own = f"{base}/.writing-{no}-{TaskContext.get().taskAttemptId()}"
        writer, encoder = None, Encoder.load(tokenizer)
        for doc_ids, texts in _calls(batches):
            if writer is None:
                sink = store.open_output_stream(own)
                writer = Writer(sink, planes)
            for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                writer.add(doc_id, ids + end)
        encoder.older.clear()  # the worker goes on to other work
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, f"{base}/part-{no:06d}.cwp")
            yield pa.RecordBatch.from_pydict(
                {"file_no": pa.array([no], pa.int32()), "path": [f"{out}/part-{no:06d}.cwp"], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the beginning only says which range a text of a repeated doc_id goes to; whole texts are sorted and written
    begin = F.substring("text", 1, 32)
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), begin).sortWithinPartitions("doc_id", "text")
    return cut(dealt.mapInArrow(tidy(part), _FILES))


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Documents in lots of about as much text as the encoder takes at once: the more, the more words repeat."""
    doc_ids, texts, n = [], [], 0
    for batch in batches:
        own = batch["text"].to_pylist()
        doc_ids += batch["doc_id"].to_pylist()
        texts += own
        n += sum(len(t) for t in own if t)
        if n >= CALL_CHARS:
            yield doc_ids, texts
            doc_ids, texts, n = [], [], 0
    if texts:
        yield doc_ids, texts


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files in a list of `write`.

    `start` counts the ids of all documents before; the checksum is over little-endian unsigned 32-bit ids.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with store.open_input_file(name) as source:
                    for doc_id, pieces in Reader(source, source.size()).documents():
                        n, crc = 0, 0
                        for p in pieces:
                            n, crc = n + len(p), zlib.crc32(np.ascontiguousarray(p, "<u4"), crc)
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) >= 50_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    n = partitions(files.sparkSession)
    upto = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, 0)  # a row per file
    starts = files.select("file_no", "path", (F.sum("n_ids").over(upto) - F.col("n_ids")).alias("before"))
    return starts.repartition(n, "file_no").mapInArrow(tidy(part), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def encode_corpus(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int | None = END_ID, planes: str = "byte") -> DataFrame:
    """Writes the corpus and reads it back; files go to a new folder in the shared one by default."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, out or fresh_dir(spark, "tokens"), tokenizer, end_id, planes))
