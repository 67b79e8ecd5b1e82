"""The feature frame: any set of catalogue columns over bars, with what they need and nothing else."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.dialects import Spark
from candlewick.operators.catalogue import BAR, MONTHLY, RECURSIVE, WEEKLY, feature_names, formulas
from candlewick.operators.recursive import add_recursive

_NAME = re.compile(r"[A-Za-z_]\w*")


def layers(names: list[str], text: dict[str, str], given: set[str]) -> tuple[list[list[str]], set[str]]:
    """The columns to compute, layer by layer so that each uses earlier layers only, and the given columns used."""
    depth: dict[str, int] = {}
    used: set[str] = set()

    def visit(name: str, path: tuple[str, ...] = ()) -> int:
        if name in given:
            used.add(name)
            return 0
        if name in path:
            raise ValueError(f"columns depend on each other: {' '.join((*path, name))}")
        if name not in depth:
            if name not in text:
                raise KeyError(f"no such column: {name}")
            needs = {w for w in _NAME.findall(text[name]) if (w in text or w in given) and w != name}
            depth[name] = 1 + max((visit(w, (*path, name)) for w in sorted(needs)), default=0)
        return depth[name]

    for n in names:
        visit(n)
    return [[n for n, d in depth.items() if d == k] for k in range(1, max(depth.values(), default=0) + 1)], used


# Columns that repeat others, and columns that codes or later steps stand for.
DUPLICATES = "D_pivot D_vpoc D_tmr_cpr_bc D_tmr_cpr_tc D_tmr_cpr_vs_today_code D_atr14_to_close_pct".split()
INTERMEDIATE = "D_nr D_tmr_cpr_vs_today D_cpr_vs_yday D_hh D_hl D_lh D_ll D_structure_trend D_day_type D_golden_regime D_price_and_obv_rising".split()
#: Flags that may be unknown and stay so.
TRI_STATE = "D_roll D_vol_surge_20 D_vol_surge_50".split()


def finalise(frame: DataFrame) -> DataFrame:
    """The frame as it is stored: without those columns, flags as bytes with unknown as 0 except where unknown is a state,
    and no NaN or infinity.  Text columns that say nothing but true and false, in any case, are flags too, with all else as 0."""
    out = []
    texts = [c for c, t in frame.dtypes if t == "string" and c not in (*DUPLICATES, *INTERMEDIATE, "symbol")]
    said = {c: F.lower(F.trim(c)) for c in texts}
    flags = frame.agg(*(F.coalesce(F.bool_and(x.isin("true", "false", "nan", "")), F.lit(False)).alias(c) for c, x in said.items())).first() if texts else {}
    for c, t in frame.dtypes:
        if c in DUPLICATES or c in INTERMEDIATE:
            continue
        x = F.col(c)
        if t == "boolean" or t == "int" and c.startswith(("D_", "DOW_", "Comb_")):
            x = x.cast("smallint") if c in TRI_STATE else F.coalesce(x.cast("smallint"), F.lit(0).cast("smallint"))
        elif c in texts and flags[c]:
            x = F.coalesce((said[c] == "true").cast("smallint"), F.lit(0).cast("smallint"))
        elif t in ("double", "float"):
            x = F.when(F.abs(x) < float("inf"), x)
        out.append(x.alias(c))
    return frame.select(*out)


def point_of_control(rows: DataFrame, keys: list[str], bins: int = 50) -> DataFrame:
    """(keys, vpoc): the middle of the price bin with the most volume, the lowest of equals, over all rows of a key.

    Prices are typical prices; bins split their range.  Without a range it is the price, without volume the range's middle.
    """
    p = rows.withColumn("_p", (F.col("high") + F.col("low") + F.col("close")) / 3).filter("_p IS NOT NULL AND volume IS NOT NULL")
    span = p.groupBy(*keys).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    binned = p.join(span, keys).withColumn("_b", F.coalesce(F.least(F.floor((F.col("_p") - F.col("_lo")) / width * bins), F.lit(bins - 1)), F.lit(0)))
    by_bin = binned.groupBy(*keys, "_lo", "_hi", "_b").agg(F.sum("volume").alias("_v"))
    best = by_bin.groupBy(*keys, "_lo", "_hi").agg(F.max_by("_b", F.struct(F.col("_v"), -F.col("_b"))).alias("_b"), F.sum("_v").alias("_v"))
    flat = F.col("_hi") - F.col("_lo") <= 1e-9 * F.greatest(F.abs("_lo"), F.abs("_hi"))
    value = F.when(flat, F.col("_lo")).when(F.col("_v") == 0, (F.col("_lo") + F.col("_hi")) / 2).otherwise(F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins)
    return best.select(*keys, value.alias("vpoc"))


def weekly_frame(bars: DataFrame) -> DataFrame:
    """Per symbol and week that ends on a Friday, what the weeks before it say; nothing of the week itself.

    Weeks are those with a bar.  A symbol with fewer than five weeks has no weekly features.
    """
    week = bars.withColumn("week_end", F.expr(Spark().date_part("week_end"))).filter(F.col("close").isNotNull())
    agg = week.groupBy("symbol", "week_end").agg(
        F.max_by("close", "session").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("v")
    )
    w = Window.partitionBy("symbol").orderBy("week_end")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    before = w.rowsBetween(-4, -1)
    usual = F.when(F.count("v").over(before) >= 2, F.avg("v").over(before))
    pos = (F.col("c") - F.col("l")) / F.expr("nullif(h - l, 0)")
    rows = agg.select(
        "symbol",
        "week_end",
        "h",
        n.alias("n"),
        ((F.col("c") / F.nullif(F.lag("c", 4).over(w), F.lit(0.0)) - 1) * 100).alias("r4"),
        ((F.col("c") / F.nullif(F.lag("c", 13).over(w), F.lit(0.0)) - 1) * 100).alias("r13"),
        F.when(pos.isNotNull(), F.least(F.greatest(pos, F.lit(0.0)), F.lit(1.0))).alias("pos"),
        (F.col("v") / F.nullif(usual, F.lit(0.0))).alias("vol"),
    )
    earlier = {"week_ret_4": "r4", "week_ret_13": "r13", "week_close_pos": "pos", "week_vol_vs_4": "vol"}
    return rows.select(
        "symbol",
        "week_end",
        *(F.when(F.col("n") >= 5, F.lag(x).over(w)).alias(name) for name, x in earlier.items()),
        F.lag("h").over(w).alias("week_prev_high"),
    )


def monthly_frame(bars: DataFrame) -> DataFrame:
    month = bars.withColumn("month_start", F.expr(Spark().date_part("month")))
    w = Window.partitionBy("symbol").orderBy("month_start")
    return month.groupBy("symbol", "month_start").agg(F.max("high").alias("h")).select("symbol", "month_start", F.lag("h").over(w).alias("month_prev_high"))


def features(bars: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = BAR) -> DataFrame:
    """`keep` and the columns in `names`, by default all features.

    One shuffle by symbol serves all windows; recursive columns take one more, and weekly and monthly frames are
    aggregates of the same bars that are joined back.
    """
    names = feature_names() if names is None else names
    text = formulas(Spark())
    given = {*BAR, "rn", *RECURSIVE, *WEEKLY, *MONTHLY}
    plan, used = layers(names, text, given)
    frame = bars.select(*dict.fromkeys([*BAR, *(c for c in keep if c in bars.columns)]))
    recursive = [n for n in RECURSIVE if n in used]
    if recursive:
        frame = add_recursive(frame, recursive)
    if used & set(WEEKLY):
        weekly = weekly_frame(bars).select("symbol", "week_end", *(c for c in WEEKLY if c in used))
        frame = frame.withColumn("week_end", F.expr(text["week_end"])).join(weekly, ["symbol", "week_end"], "left")
    if used & set(MONTHLY):
        frame = frame.withColumn("month_start", F.expr(text["month_start"])).join(monthly_frame(bars), ["symbol", "month_start"], "left")
    frame = frame.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("session")))
    for layer in plan:
        new = [n for n in layer if n not in frame.columns]
        frame = frame.select("*", *(F.expr(text[n]).alias(n) for n in new))
    return frame.select(*dict.fromkeys([*(c for c in keep if c in frame.columns), *names]))
