"""Trading calendars voted by the symbols themselves, and what a symbol's absences mean.

Nothing here builds the grid of symbols times sessions: who is alive on a day follows from counts of first and last
days, and missing sessions from jumps between a symbol's neighbouring bars on the numbered calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.config import CONSENSUS_SHARE, CONSENSUS_VOTERS, MARKET_WIDE_SHARE, SUSPENSION_RUN
from candlewick.operators.splits import session_index
from candlewick.sources.stage import staged

def _line() -> WindowSpec:
    """All sessions in order: one row each, a few thousand."""
    return Window.partitionBy(F.lit(0)).orderBy("session")


def spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count_distinct("session").alias("n"))


def live(bars: DataFrame) -> DataFrame:
    """(session, present, live): symbols with a bar, and symbols whose first bar has come and whose last has not gone."""
    s = spans(bars)
    days = bars.groupBy("session").agg(F.count_distinct("symbol").alias("present"))
    starts = s.groupBy(F.col("first").alias("session")).agg(F.count(F.lit(1)).alias("starts"))
    ends = s.groupBy(F.col("last").alias("session")).agg(F.count(F.lit(1)).alias("ends"))
    line = days.join(starts, "session", "left").join(ends, "session", "left").fillna(0, ["starts", "ends"])
    upto = _line().rowsBetween(Window.unboundedPreceding, 0)
    return line.select("session", "present", (F.sum("starts").over(upto) - F.sum("ends").over(upto) + F.col("ends")).alias("live"))


def consensus(bars: DataFrame, share: float = CONSENSUS_SHARE, voters: int = CONSENSUS_VOTERS) -> DataFrame:
    """Sessions on which enough of the living symbols traded; none at all with too few voters."""
    enough = bars.agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") >= voters)
    return live(bars).filter(F.col("present") / F.col("live") >= share).join(F.broadcast(enough), F.lit(True), "left_semi").select("session", "present", "live")


def missing(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(symbol, session, idx) of the calendar's sessions within a symbol's span on which it has no bar."""
    days = session_index(sessions)
    # bars off the calendar stand between two numbers; they bound a span but fill no session
    line = Window.partitionBy(F.lit(0)).orderBy("session", "_bar")
    at = bars.select("symbol", "session").distinct().join(days, "session", "left")
    known = at.filter("idx IS NOT NULL")
    edge = at.groupBy("symbol").agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    off = edge.select("symbol", F.explode(F.array("lo", "hi")).alias("session")).join(days.select("session"), "session", "left_anti")
    union = days.select("session", F.lit(0).alias("_bar"), F.lit(None).cast(bars.schema["symbol"].dataType).alias("symbol")).union(off.select("session", F.lit(1), "symbol"))
    placed = union.withColumn("idx", F.sum(F.when(F.col("_bar") == 0, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)) - 0.5).filter("_bar = 1")
    w = Window.partitionBy("symbol").orderBy("idx")
    every = known.select("symbol", F.col("idx").cast("double").alias("idx")).union(placed.select("symbol", "idx"))
    jump = every.withColumn("was", F.lag("idx").over(w)).filter(F.col("idx") - F.col("was") > 1)
    first, last = F.floor(F.col("was")) + 1, F.ceil(F.col("idx")) - 1
    gaps = jump.filter(first <= last).select("symbol", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("idx"))
    return gaps.join(days, "idx").select("symbol", "session", "idx")


def runs(absent: DataFrame) -> DataFrame:
    """`run` and `run_length`: neighbours in calendar numbers are one run."""
    w = Window.partitionBy("symbol").orderBy("idx")
    grouped = absent.withColumn("run", F.col("idx") - F.row_number().over(w))
    return grouped.withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy("symbol", "run")))


def classify(bars: DataFrame, sessions: DataFrame, share: float = MARKET_WIDE_SHARE, suspension: int = SUSPENSION_RUN) -> DataFrame:
    """`missing` with `class`: market_wide where many are absent together, suspension in long runs, else isolated."""
    bars = staged(bars.select("symbol", "session").distinct())
    days = staged(session_index(sessions))
    absent = staged(missing(bars, days))
    s = spans(bars)
    starts = s.groupBy(F.col("first").alias("session")).agg(F.count(F.lit(1)).alias("starts"), F.lit(0).cast("bigint").alias("ends"))
    ends = s.groupBy(F.col("last").alias("session")).agg(F.lit(0).cast("bigint").alias("starts"), F.count(F.lit(1)).alias("ends"))
    marks = days.select("session", F.lit(0).cast("bigint").alias("starts"), F.lit(0).cast("bigint").alias("ends")).union(starts).union(ends)
    daily = marks.groupBy("session").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    upto = _line().rowsBetween(Window.unboundedPreceding, 0)
    alive = daily.select("session", (F.sum("starts").over(upto) - F.sum("ends").over(upto) + F.col("ends")).alias("live"))
    together = absent.groupBy("session").agg(F.count(F.lit(1)).alias("absent")).join(alive, "session").filter((F.col("live") > 0) & (F.col("absent") / F.col("live") >= share))
    wide = absent.join(together.select("session", F.lit("market_wide").alias("wide")), "session", "left")
    own = runs(wide.filter("wide IS NULL").drop("wide")).withColumn("class", F.when(F.col("run_length") >= suspension, "suspension").otherwise("isolated"))
    return own.select("symbol", "session", "idx", "class").union(wide.filter("wide IS NOT NULL").select("symbol", "session", "idx", F.col("wide")))


def absence_counts(classified: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("class") == c).alias(c)
    return classified.groupBy("symbol").agg(n("market_wide"), n("suspension"), n("isolated"))


def date_runs(dates: DataFrame, tolerance: int = 4) -> DataFrame:
    """(symbol, first, last, n): dates at most so many days apart are one gap."""
    w = Window.partitionBy("symbol").orderBy("session")
    new = F.coalesce(F.datediff("session", F.lag("session").over(w)) > tolerance, F.lit(True)).cast("int")
    g = dates.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("symbol", "_g").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def gap_summary(found: DataFrame, shown: int = 5) -> DataFrame:
    """(symbol, n_gaps, summary): the first gaps as text, and how many more there are."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("..", F.col("first").cast("string"), F.col("last").cast("string")))
    g = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_gaps"), F.array_sort(F.collect_list(text)).alias("all"))
    more = F.when(F.col("n_gaps") > shown, F.concat(F.lit(" +"), (F.col("n_gaps") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("symbol", "n_gaps", F.concat(F.concat_ws(", ", F.slice("all", 1, shown)), more).alias("summary"))


def peer_sessions(bars: DataFrame, least: int = 2) -> DataFrame:
    """(exchange, session): the sessions of exchanges with at least so many series."""
    many = bars.groupBy("exchange").agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") >= least)
    return bars.join(many.select("exchange"), "exchange", "left_semi").select("exchange", "session").distinct()


def business_days(spark, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays without the holidays: an authoritative calendar."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS session").filter("weekday(session) < 5")
    return days if holidays is None else days.join(holidays.select("session").distinct(), "session", "left_anti")


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(session, only_in): sessions of one calendar that the other lacks, where both have begun and neither has ended."""
    span = lambda d: d.agg(F.min("session").alias("lo"), F.max("session").alias("hi")).first()
    x, y = span(a), span(b)
    if x.lo is None or y.lo is None:
        return a.select("session", F.lit("a").alias("only_in")).filter("false")
    both = a.select("session", F.lit(1).alias("in_a")).distinct().join(b.select("session", F.lit(1).alias("in_b")).distinct(), "session", "full")
    inside = both.filter(F.col("session").between(F.lit(max(x.lo, y.lo)), F.lit(min(x.hi, y.hi))))
    return inside.filter("in_a IS NULL OR in_b IS NULL").select("session", F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("only_in"))


def build_calendar(bars: DataFrame, authoritative: DataFrame | None = None, reference: DataFrame | None = None, share: float = CONSENSUS_SHARE) -> tuple[DataFrame, dict]:
    """The best calendar there is, and what is known about it: consensus over authoritative over reference.

    It is trusted if a consensus and at least one more source agree to be asked.
    """
    voted = consensus(bars, share).select("session")
    found = {"consensus": voted if voted.limit(1).count() else None, "authoritative": authoritative, "reference": reference}
    have = [k for k, v in found.items() if v is not None]
    if not have:
        return voted, {"source": None, "sources": [], "trusted": False, "disagreements": {}, "notes": ["no calendar source"]}
    pairs = {f"{x}/{y}": disagreements(found[x], found[y]).count() for i, x in enumerate(have) for y in have[i + 1 :]}
    notes = [] if len(have) > 1 else ["single-sourced: nothing to check it against"]
    return found[have[0]], {"source": have[0], "sources": have, "trusted": len(have) >= 2 and "consensus" in have, "disagreements": pairs, "notes": notes}
