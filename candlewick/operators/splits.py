"""Walk-forward folds over sessions, with an embargo between what is learned from and what is tested on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.config import CALIBRATION_FRACTION, EMBARGO, LABEL_HORIZON, N_SPLITS


def session_index(rows: DataFrame) -> DataFrame:
    """(session, idx): the distinct sessions in order, from 0.  Sessions are few, one task numbers them."""
    return rows.select("session").distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")) - 1)


def walk_forward(rows: DataFrame, n_splits: int = N_SPLITS, embargo: int = EMBARGO) -> DataFrame:
    """(fold, train_start, train_end, embargo_sessions, test_start, test_end), training windows growing from the start.

    Sessions are cut into n_splits + 1 runs of nearly equal length, the longer ones first.
    """
    if embargo < LABEL_HORIZON:
        raise ValueError(f"an embargo of {embargo} sessions is shorter than the label horizon of {LABEL_HORIZON}")
    days = session_index(rows)
    found = days.count()
    if found < (n_splits + 1) * (embargo + 10):
        raise ValueError(f"{found} sessions are too few for {n_splits} splits")
    line = Window.partitionBy(F.lit(0))
    parts = days.withColumn("part", F.ntile(n_splits + 1).over(line.orderBy("session"))).withColumn("train_start", F.min("session").over(line))
    spans = parts.groupBy("part", "train_start").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.max("idx").alias("last_idx"))
    folds = spans.filter("part > 1").select((F.col("part") - 1).alias("fold"), "train_start", F.col("first").alias("test_start"), F.col("last").alias("test_end"))
    ends = spans.select(F.col("part").alias("fold"), F.greatest(F.lit(0), F.col("last_idx") - embargo).alias("idx"))
    trained = ends.join(days, "idx").select("fold", F.col("session").alias("train_end"))
    return folds.join(trained, "fold").select(
        F.col("fold").cast("int").alias("fold"), "train_start", "train_end", F.lit(embargo).alias("embargo_sessions"), "test_start", "test_end"
    )


def inner_split(rows: DataFrame, folds: DataFrame, fraction: float = CALIBRATION_FRACTION, embargo: int = EMBARGO, strict: bool = False) -> DataFrame:
    """(fold, sessions, fit_end, cal_start): where fitting ends and calibration begins within each training window.

    `strict` leaves one more session between the two, so that not even the last fitted label reaches calibration.
    """
    days = session_index(rows)
    inside = days.join(F.broadcast(folds), (F.col("session") >= F.col("train_start")) & (F.col("session") <= F.col("train_end")))
    n = inside.groupBy("fold").agg(F.count(F.lit(1)).alias("sessions"), F.min("idx").alias("base"))
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("sessions") * (1 - fraction)), F.col("sessions") - embargo - 1))
    at = n.filter("sessions >= 40").withColumn("cut", cut.cast("int"))
    fit = at.withColumn("idx", F.col("base") + F.col("cut") - 1).join(days, "idx").select("fold", "sessions", F.col("session").alias("fit_end"))
    cal = at.withColumn("idx", F.col("base") + F.col("cut") - 1 + embargo + int(strict)).join(days, "idx").select("fold", F.col("session").alias("cal_start"))
    return fit.join(cal, "fold")


def assign(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of every fold with `fold` and `part` (train or test); a row trains in several folds."""
    s = F.col("session")
    part = F.when(s.between(F.col("test_start"), F.col("test_end")), "test").when(s.between(F.col("train_start"), F.col("train_end")), "train")
    return rows.join(F.broadcast(folds), s.between(F.col("train_start"), F.col("test_end"))).withColumn("part", part).filter("part IS NOT NULL").drop(
        "train_start", "train_end", "embargo_sessions", "test_start", "test_end"
    )


def verify(folds: DataFrame, rows: DataFrame, embargo: int = EMBARGO) -> None:
    """Raises where a training window reaches within the embargo of its test window."""
    days = session_index(rows)
    a = folds.join(days.select(F.col("session").alias("train_end"), F.col("idx").alias("i")), "train_end")
    b = a.join(days.select(F.col("session").alias("test_start"), F.col("idx").alias("j")), "test_start")
    bad = b.filter(F.col("j") - F.col("i") <= embargo).select("fold").collect()
    if bad:
        raise ValueError(f"folds overlap their embargo: {[r.fold for r in bad]}")


def dense_groups(rows: DataFrame) -> DataFrame:
    """`qid`, the number of a row's session, dense from 0: the groups of a ranking model."""
    return rows.join(session_index(rows).withColumnRenamed("idx", "qid"), "session")
