"""How good scores are: over all rows, and among each session's best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.config import TOP_NS

_LOW = 1e-6


def clipped(p: str) -> Column:
    return F.greatest(F.least(F.col(p), F.lit(1 - _LOW)), F.lit(_LOW))


def auc(rows: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """(by, auc): the rank-sum statistic, null where there is one class only.

    Equal scores are summed up first, so no task ranks single rows: ranks follow from running counts over distinct scores.
    """
    known = rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    steps = known.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("pos"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(score)
    below = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = steps.withColumn("r", below + (F.col("n") + 1) / 2)
    n1, n0 = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    value = F.when((n1 > 0) & (n0 > 0), (F.sum(F.col("pos") * F.col("r")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0)))
    return ranked.groupBy(*by).agg(value.alias("auc")) if by else ranked.agg(value.alias("auc"))


def losses(rows: DataFrame, by: list[str], y: str = "y", p: str = "p_cal") -> DataFrame:
    """(by, n, base_rate, mean_score, brier, logloss)."""
    q, t = clipped(p), F.col(y).cast("double")
    return rows.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(t).alias("base_rate"),
        F.avg(p).alias("mean_score"),
        F.avg((t - q) * (t - q)).alias("brier"),
        F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("logloss"),
    )


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """`rank` within the session, best first, ties by symbol."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc(score), "symbol")))


def top_n(rows: DataFrame, score: str = "score", y: str = "y", hurdle: float = 0.5, ns: tuple[int, ...] = TOP_NS) -> DataFrame:
    """(top_n, signals, realised, se2, lower_2se, clears) for the best n rows of every session."""
    best = ranked(rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull()), score).filter(F.col("rank") <= max(ns))
    each = best.withColumn("top_n", F.explode(F.filter(F.array(*map(F.lit, ns)), lambda n: F.col("rank") <= n)))
    r = F.avg(F.col(y).cast("double"))
    got = each.groupBy("top_n").agg(F.count(F.lit(1)).alias("signals"), r.alias("realised"))
    se2 = 2 * F.sqrt(F.col("realised") * (1 - F.col("realised")) / F.col("signals"))
    return got.withColumn("se2", se2).withColumn("lower_2se", F.col("realised") - F.col("se2")).withColumn("clears", F.col("lower_2se") > hurdle)


def average_rank(c: str, *by: str) -> Column:
    lower = F.rank().over(Window.partitionBy(*by).orderBy(c))
    return lower + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2


def session_ic(rows: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(session, ic): Spearman's correlation, for sessions with at least three rows and both classes."""
    known = rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    r = known.withColumn("a", average_rank(score, "session")).withColumn("b", average_rank(y, "session"))
    g = r.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi"),
        F.covar_samp("a", "b").alias("c"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"),
    ).filter("n >= 3 AND lo < hi")
    return g.select("session", (F.col("c") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0))).alias("ic"))


def ic_summary(per_session: DataFrame) -> DataFrame:
    return per_session.agg(F.count("ic").alias("sessions"), F.avg("ic").alias("mean_daily_spearman"), F.percentile("ic", F.lit(0.5)).alias("median_daily_spearman"))


def experiment_summary(folds: DataFrame, metric: str = "auc", clears: str = "clears") -> DataFrame:
    """(experiment, folds, mean, median, worst, all_clear), best first by worst fold, then mean."""
    return folds.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("folds"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("median"), F.min(metric).alias("worst"), F.bool_and(clears).alias("all_clear")
    ).orderBy(F.desc("worst"), F.desc("mean"))
