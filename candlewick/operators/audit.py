"""Label audit: labels computed a second way, in SQL over the path, against the stored ones; and what must always hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.config import LABEL_HORIZON, LABEL_VARIANTS, PRIMARY_VARIANT


def reference_labels(bars: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """(symbol, session, first_touch, tp, sl) of the primary variant, by joining each bar with the bars ahead of it."""
    v = next(x for x in LABEL_VARIANTS if x.name == PRIMARY_VARIANT)
    bars.createOrReplaceTempView("audit_bars")
    return bars.sparkSession.sql(f"""
        WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn FROM audit_bars),
        ranges AS (SELECT a.symbol, a.rn, greatest(a.high - a.low, abs(a.high - b.close), abs(a.low - b.close)) AS tr FROM numbered a JOIN numbered b ON b.symbol = a.symbol AND b.rn = a.rn - 1),
        levels AS (SELECT n.symbol, n.rn, n.session, n.close, avg(r.tr) / n.close AS atr FROM numbered n JOIN ranges r ON r.symbol = n.symbol AND r.rn BETWEEN n.rn - 13 AND n.rn
                   GROUP BY n.symbol, n.rn, n.session, n.close HAVING count(*) = 14),
        path AS (SELECT l.*, f.rn - l.rn AS k, f.high / l.close - 1 >= {v.take_profit} * l.atr AS up, f.low / l.close - 1 <= -{v.stop_loss} * l.atr AS down
                 FROM levels l JOIN numbered f ON f.symbol = l.symbol AND f.rn BETWEEN l.rn + 1 AND l.rn + {horizon})
        SELECT symbol, session, {v.take_profit} * first(atr) AS tp, {v.stop_loss} * first(atr) AS sl,
          CASE WHEN min(CASE WHEN up THEN k END) < coalesce(min(CASE WHEN down THEN k END), 99) THEN 1.0 WHEN min(CASE WHEN down THEN k END) IS NOT NULL THEN -1.0 ELSE 0.0 END AS first_touch
        FROM path GROUP BY symbol, session HAVING count(*) = {horizon}""")


def mismatches(labelled: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, session, stored, recomputed) where the two ways differ."""
    second = reference_labels(bars).select("symbol", "session", F.col("first_touch").alias("recomputed"))
    both = labelled.select("symbol", "session", F.col("label_first_touch").alias("stored")).join(second, ["symbol", "session"], "left")
    return both.filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def invariants(labelled: DataFrame) -> DataFrame:
    """(check, violations): what must hold for every label whatever the prices."""
    first, tp = F.col("label_first_touch"), F.col("label_tp_before_sl")
    checks = {
        "tp_before_sl is first_touch > 0": first.isNotNull() & (tp != (first > 0).cast("double")),
        "days to tp are known exactly where tp is touched": (F.col(f"label_touch_{PRIMARY_VARIANT}") == 1) != F.col("label_days_to_tp").isNotNull(),
        "an ambiguous session counts as a stop": (F.col("label_same_day_ambiguous") == 1) & (first != -1),
        "neither barrier means the return is inside both": (first == 0) & (F.col("label_days_to_sl").isNotNull() | F.col("label_days_to_tp").isNotNull()),
        "the best is not below the worst": F.col("label_mfe_5d") < F.col("label_mae_5d"),
        "the end is between the worst and the best": (F.col("label_fwd_ret_5d") > F.col("label_mfe_5d") + 1e-12) | (F.col("label_fwd_ret_5d") < F.col("label_mae_5d") - 1e-12),
    }
    names = list(checks)
    counted = labelled.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())))
    return counted.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, c{i}' for i, n in enumerate(names))}) AS (check, violations)"))


def pending_tail(labelled: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """(symbol, pending): labels still open among each symbol's last sessions; there must be `horizon` of them."""
    last = labelled.withColumn("_back", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY session DESC)")).filter(F.col("_back") <= horizon)
    return last.groupBy("symbol").agg(F.count_if(F.col("label_fwd_ret_5d").isNull()).alias("pending"))


def sample_symbols(bars: DataFrame, n: int = 10, edge: int = 5, seed: int = 42) -> DataFrame:
    """(symbol, why): the symbols with fewest and most bars, and others by a seeded hash."""
    sized = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("k"))
    low = sized.orderBy("k", "symbol").limit(edge).select("symbol", F.lit("smallest").alias("why"))
    high = sized.orderBy(F.desc("k"), "symbol").limit(edge).select("symbol", F.lit("largest").alias("why"))
    rest = sized.join(low.union(high), "symbol", "left_anti").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("symbol").cast("string")).cast("binary")), "symbol").limit(n).select("symbol", F.lit("random").alias("why"))
    return low.union(high).union(rest)
