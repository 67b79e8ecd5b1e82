"""Forward labels: what the next sessions bring, and which of two barriers the path meets first.

A label is null until all sessions of its horizon exist, or where a price on the path or a level is missing.  A session
that meets both barriers counts for the stop-loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.config import LABEL_HORIZON, LABEL_TOUCH, LABEL_VARIANTS, PRIMARY_VARIANT, LabelVariant
from candlewick.sources.stage import staged

def _by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session")


def atr_fraction() -> Column:
    """The plain mean of the last 14 true ranges over the close; a symbol's first bar has no true range."""
    before = F.lag("close").over(_by_symbol())
    spread = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return spread


def with_paths(bars: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """`bars` with the path ahead, as returns on the close: `_up` and `_down` by session, `_end`, and `_atr`."""
    ahead = range(1, horizon + 1)
    close = F.nullif(F.col("close"), F.lit(0.0))
    last14 = _by_symbol().rowsBetween(-13, 0)
    df = bars.withColumn("_tr", atr_fraction())
    df = df.withColumn("_atr", F.when(F.count("_tr").over(last14) >= 14, F.avg("_tr").over(last14)) / close)
    whole = F.count(F.lit(1)).over(_by_symbol().rowsBetween(1, horizon)) == horizon
    up = F.array(*[F.lead("high", k).over(_by_symbol()) / close - 1 for k in ahead])
    down = F.array(*[F.lead("low", k).over(_by_symbol()) / close - 1 for k in ahead])
    end = F.lead("close", horizon).over(_by_symbol()) / close - 1
    df = df.withColumn("_up", up).withColumn("_down", down).withColumn("_end", end).withColumn("_whole", whole)
    known = F.col("_whole") & ~F.exists("_up", lambda x: x.isNull()) & ~F.exists("_down", lambda x: x.isNull()) & F.col("_end").isNotNull()
    return df.withColumn("_whole", F.coalesce(known, F.lit(False)))


def _variant(v: LabelVariant) -> dict[str, Column]:
    unit = F.col("_atr") if v.atr else F.lit(1.0)
    tp, sl = unit * v.take_profit, unit * v.stop_loss
    ok = F.col("_whole") & tp.isNotNull()
    up = F.array_position(F.transform("_up", lambda x: x >= tp), F.lit(True))
    down = F.array_position(F.transform("_down", lambda x: x <= -sl), F.lit(True))
    first = F.when((up > 0) & ((down == 0) | (up < down)), 1.0).when(down > 0, -1.0).otherwise(0.0)
    exit_ = F.when(first == 1, tp).when(first == -1, -sl).otherwise(F.col("_end"))
    return {
        "first": F.when(ok, first),
        "tp_before_sl": F.when(ok, (first > 0).cast("double")),
        "days_to_tp": F.when(ok & (up > 0), up.cast("double")),
        "days_to_sl": F.when(ok & (down > 0), down.cast("double")),
        "same_day_ambiguous": F.when(ok, ((up > 0) & (up == down)).cast("double")),
        "touch": F.when(ok, (up > 0).cast("double")),
        "exit_ret": F.when(ok, exit_),
    }


def label_names() -> list[str]:
    base = "touch fwd_ret_5d mfe_5d mae_5d first_touch tp_before_sl days_to_tp days_to_sl same_day_ambiguous exit_ret".split()
    own = [f"{x}_{v.name}" for v in LABEL_VARIANTS for x in ("tp_before_sl", "days_to_tp", "same_day_ambiguous", "touch", "exit_ret")]
    return [f"label_{x}" for x in (*base, *own)]


def labels(bars: DataFrame, horizon: int = LABEL_HORIZON, touch: float = LABEL_TOUCH, keep: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """`keep` and all labels; one window pass by symbol, shared by the five variants."""
    df = with_paths(bars, horizon)
    mfe = F.when(F.col("_whole"), F.array_max("_up"))
    out = {
        "label_mfe_5d": mfe,
        "label_mae_5d": F.when(F.col("_whole"), F.array_min("_down")),
        "label_fwd_ret_5d": F.when(F.col("_whole"), F.col("_end")),
        "label_touch": F.when(F.col("_whole"), (mfe >= touch).cast("double")),
    }
    for v in LABEL_VARIANTS:
        made = _variant(v)
        out |= {f"label_{x}_{v.name}": made[x] for x in ("tp_before_sl", "days_to_tp", "same_day_ambiguous", "touch", "exit_ret")}
        if v.name == PRIMARY_VARIANT:
            out["label_first_touch"] = made["first"]
            out |= {f"label_{x}": made[x] for x in ("tp_before_sl", "days_to_tp", "days_to_sl", "same_day_ambiguous", "exit_ret")}
    return df.select(*keep, *(out[n].alias(n) for n in label_names()))


def outcome_mix(labelled: DataFrame) -> DataFrame:
    """How the primary variant ends: shares of take-profit, stop-loss, neither and ambiguous among resolved labels."""
    x = F.col("label_first_touch")
    known = labelled.filter(x.isNotNull())
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return known.agg(
        F.count(F.lit(1)).alias("resolved"),
        share(x == 1).alias("tp_share"),
        share(x == -1).alias("sl_share"),
        share(x == 0).alias("neither_share"),
        share(F.col("label_same_day_ambiguous") == 1).alias("ambiguous_share"),
    )


def outcome_percentiles(labelled: DataFrame, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(point, value): exact percentiles of the primary variant's outcome, interpolated; null where no outcome is known.

    Values are counted, dealt out in ranges and kept.  The ranges' totals tell in which of them a point's two neighbours
    lie, and only those are counted through, so no task holds all values.
    """
    counted = labelled.select(F.col("label_exit_ret").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    spread = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(counted.repartitionByRange(spread, "v").withColumn("part", F.spark_partition_id()))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n"))  # one row per range
    parts = parts.select("part", "n", (F.sum("n").over(line) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    asked = labelled.sparkSession.createDataFrame([(p,) for p in points], "point double")
    at = F.col("point") * (F.col("all") - 1)
    wanted = asked.crossJoin(parts).withColumn("at", at).withColumn("k", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    wanted = wanted.filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n"))).select("part", "before", "point", "at", "k")
    within = dealt.join(F.broadcast(wanted.select("part", "before").distinct()), "part")
    upto = within.select("part", "v", "n", (F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))).alias("upto"))
    found = upto.join(F.broadcast(wanted), "part").filter((F.col("upto") - F.col("n") <= F.col("k")) & (F.col("k") < F.col("upto")))
    weight = F.when(F.col("k") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    # the lower neighbour first; one that carries all the weight is alone
    value = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("v") * weight).alias("x")))), lambda y: y.x), F.lit(0.0), lambda s, x: s + x)
    return asked.join(found.groupBy("point").agg(value.alias("value")), "point", "left")
