"""Mixing sources to target weights: exact word budgets per source, repeating epochs where needed.

Each source's documents stand in hash-random order; distributed prefix sums of their word counts are cut at the
source's budget.  A budget above the source's size takes whole epochs first and cuts in the last one, so that a
source gives exactly its budget of words and no document more than once per epoch.  Everything is DataFrame
operations.

Defined results: a null text has no words; a null source is a source of its own that sorts last; repeated rows are
documents of their own; a source without words has target 0; very long texts count and are cut like others; an empty
table gives an empty result.  Columns beside
doc_id, text and source are carried only by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.running import hash_key, hash_slice, running, slices_for
from candlewick.llm.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
_ROW = "_mix_row"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size), one row per source.

    Sources in order of their key weigh `weights`, repeating, and share the sum of all sizes.  A target stops at
    `max_epochs` times its source's size, and the excess goes to the others by weight until none is above.  That
    fixed point is a water level: with sources sorted by cap over weight, the ones below the level stop at their
    caps and the others get level times weight.  The windows run over one row per source.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("source_key")
    whole = Window.partitionBy(F.lit(0))
    by_ratio = whole.orderBy("_ratio", "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        # the first source in that order whose cap is not below the level sets it for all that follow
        .withColumn("_free", F.col("_ratio") >= F.col("_level"))
        .withColumn("_set", F.min(F.when(F.col("_free"), F.struct("_ratio", "source_key", "_level"))).over(whole))
        .withColumn(
            "target",
            F.when(
                F.col("_set").isNotNull() & (F.struct("_ratio", "source_key") >= F.struct("_set._ratio", "_set.source_key")),
                F.col("_set._level") * F.col("_weight"),
            ).otherwise(F.col("_cap").cast("double")),
        )
        .select("source_key", "source_size", "target")
    )


def _counted(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, _id, size, source_key, _key, _slice) for each document, written once: words are counted in one pass."""
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _source_key().alias("source_key"),
            hash_key(F.col("doc_id"), F.col("text"), seed=seed).alias("_key"),
        )
    )
    return rows.withColumn("_slice", hash_slice(F.col("_key"), slices_for(rows.count())))


def _source_key() -> Column:
    """Sorts by code point, null last: UTF-8 binary order is code point order."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))


def _budgets(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source_key, source_size, target, _epochs, _rest), one row per source: whole epochs and the words of the last one."""
    goal = targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    return (
        goal.withColumn("_budget", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs))
        .withColumn("_epochs", F.expr("CASE WHEN source_size > 0 THEN _budget div source_size ELSE 0 END"))
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
        .drop("_budget")
    )


def _summed(rows: DataFrame) -> DataFrame:
    """`rows` with `_before`, the words of the documents that stand before each one in its source's order."""
    return running(rows, ["source_key"], "_slice", ["_key", "_id", "size"], F.col("size"), "_before", "_of")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document.

    `taken` is the number of words that the mix takes from the document, repeats counted; a source's add up to
    its target rounded to whole words.
    """
    rows = _counted(docs, seed)
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("_rest") - F.col("_before"), F.col("size")))
    return (
        _summed(rows)
        .join(_budgets(rows, weights, max_epochs), "source_key")
        .withColumn("taken", F.col("_epochs") * F.col("size") + last)
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def _ends(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Where each source's budget ends, one row per source that has words.

    (_epochs, _end, _left, _twins): documents at a place before `_end`, a struct of key, id and size, are taken once
    more than `_epochs` times; `_left` words are taken at that place, which `_twins` equal rows hold.
    """
    goal = _budgets(rows, weights, max_epochs)
    at = (
        _summed(rows)
        .join(goal, "source_key")
        .filter("_before + size > _rest")
        .groupBy("source_key", "_epochs", "_rest")
        .agg(F.min(F.struct("_key", "_id", "size")).alias("_end"))
    )
    place = F.struct("_key", "_id")
    return (
        rows.join(cut(at, narrow=True), "source_key")
        .groupBy("source_key", "_epochs", "_rest", "_end")
        .agg(
            F.coalesce(F.sum(F.when(place < F.struct("_end._key", "_end._id"), F.col("size"))), F.lit(0)).alias("_until"),
            F.count(F.when(place == F.struct("_end._key", "_end._id"), 1)).alias("_twins"),
        )
        .select("source_key", "_epochs", "_end", (F.col("_rest") - F.col("_until")).alias("_left"), "_twins")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each time that a document is taken.

    Whole takes repeat the row.  The one document per source at which the budget ends is cut after its last
    taken word, with `n_chars`, where there is such a column, set to the length that is left.

    Only keys and counts are shuffled.  Texts are read a second time and compared with the place at which their
    source's budget ends; the table of these places is broadcast if Spark finds it small.  Where equal rows share
    such a place, these rows alone are numbered.
    """
    ends = cut(_ends(_counted(docs, seed), weights, max_epochs), narrow=True)
    placed = (
        docs.select(
            F.struct(*[docs[c] for c in docs.columns]).alias(_ROW),
            _source_key().alias("source_key"),
            F.struct(
                hash_key(F.col("doc_id"), F.col("text"), seed=seed).alias("_key"),
                F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
            ).alias("_place"),
        )
        .filter(F.col(f"{_ROW}.text").rlike(WORD))
        .join(ends, "source_key")
        .withColumn("_stop", F.struct("_end._key", "_end._id"))
        .withColumn("_nth", F.lit(0).cast("long"))
    )
    if not ends.filter("_twins > 1").isEmpty():
        shared = (F.col("_place") == F.col("_stop")) & (F.col("_twins") > 1)
        nth = (F.row_number().over(Window.partitionBy("source_key").orderBy("_place")) - 1).cast("long")
        placed = placed.filter(~shared).unionByName(placed.filter(shared).withColumn("_nth", nth))
    # words of the last epoch: null where the whole document is taken
    size = F.col("_end.size")
    at_end = F.greatest(F.lit(0).cast("long"), F.least(F.col("_left") - F.col("_nth") * size, size))
    part = F.when(F.col("_place") == F.col("_stop"), F.when(at_end < size, at_end)).when(F.col("_place") > F.col("_stop"), 0)
    takes = F.col("_epochs") + F.when(F.col("_part") == 0, 0).otherwise(1)
    copies = (
        placed.withColumn("_part", part)
        .withColumn("_takes", takes)
        .filter("_takes > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_takes"))))
    )
    pieces = F.regexp_extract_all(f"{_ROW}.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    is_cut = (F.col("_part") > 0) & (F.col("_copy") == F.col("_takes"))
    head = F.when(is_cut, F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")).otherwise(F.col(f"{_ROW}.text"))
    cut_text = copies.withColumn("_text", head)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_text") == F.col(f"{_ROW}.text"), F.col(f"{_ROW}.n_chars")).otherwise(
            F.length("_text").cast(docs.schema["n_chars"].dataType)
        )
    return cut_text.select(*[changed.get(c, F.col(_ROW)[c]).alias(c) for c in docs.columns])
