"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each query applies its operator, with production parameters, to the whole table it is meant for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import decontam, embdedup, htmlmain, linededup, mixing, neardedup, quality, sharding, suffixdedup, tokens
from candlewick.llm.oracle import ORACLE_SQL
from candlewick.llm.runtime import table

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is installed on this machine and on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out()).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10, unnamed=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.link(table(spark, sf_dir, "documents"), percent=85)


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.link(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_planes": op4_token_planes,
    "op5_subword_quality": op5_subword_quality,
    "op6_benchmark_phrases": op6_benchmark_phrases,
    "op7_main_text": op7_main_text,
    "op8_minhash_groups": op8_minhash_groups,
    "op9_stratified_shards": op9_stratified_shards,
    "op10_embedding_links": op10_embedding_links,
}
