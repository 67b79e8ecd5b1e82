"""From raw documents to token files: quality, near-duplicates, benchmark leaks, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  Rows without a doc_id are judged
one by one, as the operators define; of rows that share a doc_id, one passes the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm import decontam, mixing, neardedup, quality, tokens
from candlewick.llm.queries import tokenizer_path
from candlewick.llm.runtime import cut, fresh_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier rejects go; it learns from labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.accept(docs, quality.fit(docs, labels), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Documents link from a similarity of 0.8 on, the general rule; 0.85 is what op8 alone asks for.
    """
    gone = cut(neardedup.link(docs, percent=80).filter("NOT kept").select("doc_id").distinct(), narrow=True)
    named = docs.filter("doc_id IS NOT NULL")
    repeated = cut(named.groupBy("doc_id").count().filter("count > 1").select("doc_id").join(gone, "doc_id", "left_anti"), narrow=True)
    rest = docs.join(gone.union(repeated), "doc_id", "left_anti").select(docs.columns)
    # the rows of one doc_id are one document, of which one row stays
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = docs.join(repeated, "doc_id", "left_semi").withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return rest.unionByName(one.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    # rows are told apart by 128 bits of their doc_id and text
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    found = decontam.find(docs.select(key.alias("row"), "text"), table(spark, sf_dir, "benchmark"), width=10, unnamed=True, key="row")
    hit = found.filter(F.size("spans") > 0).select(F.col("row").alias("_hit")).distinct()
    return docs.join(hit, key == F.col("_hit"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights, over more than one epoch where they are small."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: a row per document and take."""
    return tokens.encode_corpus(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: A trained classifier cannot be expressed in SQL; the stages are tested against plain versions one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
