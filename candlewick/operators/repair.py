"""Bars that should not be there, prices that jump by a split, contract rolls, and merging of fresh bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.config import ORPHAN_GAP_DAYS, ORPHAN_REMAINING, SPLIT_MIN_MOVE, SPLIT_RATIO_TOLERANCE, SPLIT_RATIOS

def _by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session")


def listing_start(bars: DataFrame, gap_days: int = ORPHAN_GAP_DAYS, remaining: int = ORPHAN_REMAINING) -> DataFrame:
    """(symbol, start): the first bar after the last long hole that leaves enough bars; symbols without one are not listed."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    marked = bars.select(
        "symbol", "session", F.datediff("session", F.lag("session").over(_by_symbol())).alias("gap"), F.row_number().over(_by_symbol()).alias("rn"), n.alias("n")
    )
    return marked.filter((F.col("gap") >= gap_days) & (F.col("n") - F.col("rn") + 1 >= remaining)).groupBy("symbol").agg(F.max("session").alias("start"))


def trim_orphans(bars: DataFrame, gap_days: int = ORPHAN_GAP_DAYS, remaining: int = ORPHAN_REMAINING) -> DataFrame:
    """Bars from each symbol's listing on."""
    starts = listing_start(bars, gap_days, remaining)
    return bars.join(starts, "symbol", "left").filter(F.col("start").isNull() | (F.col("session") >= F.col("start"))).drop("start")


def discontinuities(bars: DataFrame, min_move: float = SPLIT_MIN_MOVE, tolerance: float = SPLIT_RATIO_TOLERANCE, ratios: tuple[float, ...] = SPLIT_RATIOS) -> DataFrame:
    """Moves that look like an unadjusted split: large, near a common ratio, made overnight, and lasting.

    Volume that moved the other way makes the finding sure, otherwise it is of medium confidence.
    """
    zero = F.lit(0.0)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    df = bars.select("*", F.lag("close").over(_by_symbol()).alias("prev_close"), F.lag("volume").over(_by_symbol()).alias("_pv"), n.alias("_n"))
    df = df.withColumn("ratio", F.col("prev_close") / F.nullif(F.col("close"), zero))
    df = df.withColumn("_move", F.abs(F.col("close") / F.nullif(F.col("prev_close"), zero) - 1))
    df = df.withColumn("_after", F.percentile("close", F.lit(0.5)).over(_by_symbol().rowsBetween(0, 4)))
    df = df.filter((F.col("_n") >= 3) & (F.col("_move") >= min_move) & (F.col("close") > 0) & (F.col("prev_close") > 0))
    # each way by its own division: the reciprocal of the ratio can be one step off, and decide at the tolerance
    wide = F.greatest(F.col("ratio"), F.col("close") / F.col("prev_close"))
    df = df.withColumn("_near", F.filter(F.array(*map(F.lit, ratios)), lambda t: F.abs(wide - t) / t <= tolerance)).filter(F.size("_near") > 0)
    intraday = (F.col("high") - F.col("low")) / F.nullif(F.col("close"), zero)
    stays = F.abs(F.col("_after") / F.nullif(F.col("close"), zero) - 1)
    df = df.filter(F.coalesce(intraday <= 0.5 * F.col("_move"), F.lit(True)) & F.coalesce(stays <= 0.5 * F.col("_move"), F.lit(True)))
    change = F.col("volume") / F.nullif(F.col("_pv"), zero)
    consistent = F.when(F.col("_pv").isNull() | F.col("volume").isNull() | (F.col("_pv") <= 0), True).when(F.col("close") < F.col("prev_close"), change > 1.3).otherwise(change < 0.77)
    return df.select(
        "symbol", "session", "prev_close", "close", "ratio", F.get("_near", F.lit(0)).alias("nearest_split"), (F.col("_move") * 100).alias("move_pct"),
        consistent.alias("volume_consistent"), F.when(consistent, "high").otherwise("medium").alias("confidence"),
    )


def roll_calendar(observed: DataFrame) -> DataFrame:
    """(expiry, tradingsymbol, observed_on): of each expiry the first observation."""
    return observed.groupBy("expiry").agg(F.min_by("tradingsymbol", "observed_on").alias("tradingsymbol"), F.min("observed_on").alias("observed_on"))


def roll_marks(bars: DataFrame, expiries: DataFrame) -> DataFrame:
    """`D_roll`: 1 on the first session after an expiry, 0 on later ones, null before the first known expiry.

    How many expiries lie before a session is counted once for all symbols, on one line of sessions and expiries; where
    that number has grown since a symbol's bar before, the symbol rolls.
    """
    e = expiries.select(F.col("expiry").alias("session")).distinct().withColumn("_e", F.lit(1))
    line = e.union(bars.select("session").distinct().withColumn("_e", F.lit(0)))
    w = Window.partitionBy(F.lit(0)).orderBy("session", "_e").rowsBetween(Window.unboundedPreceding, 0)  # an expiry counts from the next session on
    passed = line.withColumn("_p", F.sum("_e").over(w)).filter("_e = 0").select("session", "_p")
    same_day = e.select("session", F.lit(1).alias("_today"))
    at = bars.join(passed, "session").join(same_day, "session", "left")
    grown = F.col("_p") > F.coalesce(F.lag("_p").over(_by_symbol()), F.lit(0))
    known = (F.col("_p") > 0) | F.col("_today").isNotNull()
    roll = F.when(~known, F.lit(None)).when(grown, 1).otherwise(0).cast("tinyint")
    return at.withColumn("D_roll", roll).select(*bars.columns, "D_roll")


def front_month(instruments: DataFrame, today) -> DataFrame:
    """(underlying, tradingsymbol, expiry): the future that expires next, on or after `today`."""
    open_ = instruments.filter((F.col("instrument_type") == "FUT") & (F.col("expiry") >= F.lit(today)))
    return open_.groupBy(F.col("name").alias("underlying")).agg(F.min_by("tradingsymbol", F.struct("expiry", "tradingsymbol")).alias("tradingsymbol"), F.min("expiry").alias("expiry"))


def dedup(rows: DataFrame, keys: list[str], recency: list[str], last: bool = True) -> DataFrame:
    """One row per key: the latest, or the earliest."""
    order = [F.desc(c) if last else F.asc(c) for c in recency]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def merge_tail(stored: DataFrame, fetched: DataFrame, keys: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """Stored bars corrected by fetched ones, which win."""
    both = stored.withColumn("_src", F.lit(0)).unionByName(fetched.withColumn("_src", F.lit(1)))
    return dedup(both, list(keys), ["_src"]).drop("_src")


def same_bars(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows: then nothing needs to be written."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def refetch_plan(stored: DataFrame, wanted: DataFrame, tail_days: int = 7) -> DataFrame:
    """(symbol, action, fetch_from, fetch_to): what an incremental fetch has to do per symbol.

    `wanted` has (symbol, first, last).  Nothing stored: full; split suspected: full; history missing: backfill; behind: the
    tail, with some days again so that late corrections arrive; else skip.
    """
    have = stored.groupBy("symbol").agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    suspect = discontinuities(stored).select("symbol").distinct().withColumn("_split", F.lit(True))
    j = wanted.join(have, "symbol", "left").join(suspect, "symbol", "left")
    action = (
        F.when(F.col("lo").isNull() | F.col("_split"), "full").when(F.col("lo") > F.col("first"), "backfill").when(F.col("hi") < F.col("last"), "tail").otherwise("skip")
    )
    start = F.when(action == "tail", F.date_sub("hi", tail_days)).when(action == "skip", F.lit(None).cast("date")).otherwise(F.col("first"))
    return j.select("symbol", action.alias("action"), start.alias("fetch_from"), F.when(action != "skip", F.col("last")).alias("fetch_to"))
