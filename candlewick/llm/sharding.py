"""Proportional stratified interleaving: shards that all carry the corpus's mixture of sources.

Rows are put in seeded random order within each source; a row's fractional rank is its place in that order
over the source's size.  Sorting all rows by fractional rank deals every source evenly along one line, which is
cut into shards of row counts at most one apart (the law `rows`).  Everything is DataFrame operations.

Defined results: a null text has no bytes; a null source is a stratum of its own, apart from the empty string; a
null doc_id sorts first among equals; repeated rows are placed one by one, and which of two identical rows gets
which slot cannot be told apart.  Equal texts are not kept together.  Very long texts are read only for their size and
checksum.  An empty table gives an empty result.
Columns beside doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.running import hash_key, hash_slice, running, slices_for
from candlewick.llm.runtime import cut


def interleave(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, stratum, shard, slot): each row's shard and its place in it, from 0.

    The table is read once: each text is reduced to its size, checksum and place in the random order, and the steps
    after that work on these narrow rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("stratum"),
        hash_key(F.col("doc_id"), F.col("text"), seed=seed).alias("_key"),
    )
    rows = cut(rows)
    slices = slices_for(rows.count())
    rows = rows.withColumn("_slice", hash_slice(F.col("_key"), slices))
    one = F.lit(1).cast("long")
    order = ["_key", "doc_id", "text_crc32"]
    ranked = running(rows, ["stratum"], "_slice", order, one, "_rank", "_of").withColumn(
        "_frac", (F.col("_rank") + F.lit(0.5)) / F.col("_of")
    )
    line = ranked.withColumn(
        "_slice", F.least(F.floor(F.col("_frac") * slices), F.lit(slices - 1)).cast("int")
    )
    placed = running(line, [], "_slice", ["_frac", "stratum", *order], one, "_pos", "_rows")
    shard = f"_pos * {shards} div _rows"
    first = f"(({shard}) * _rows + {shards - 1}) div {shards}"
    return placed.select(
        "doc_id", "size", "text_crc32", "stratum", F.expr(shard).cast("int").alias("shard"), (F.col("_pos") - F.expr(first)).alias("slot")
    )
