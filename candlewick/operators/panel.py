"""The point-in-time panel: features and labels per symbol and session, with what the session's other symbols say.

The order of steps is part of the result: the liquidity floor comes before ranks, the thin-session filter after them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.config import LABEL_HORIZON, LIQ_MIN_OBSERVATIONS, LIQ_WINDOW, WARMUP_BARS, PanelConfig
from candlewick.operators.features import features
from candlewick.operators.labels import label_names, labels

MARKET = ("D_ret_1d_pct", "D_realvol_20", "D_rsi14", "D_adx14", "D_dist_from_52wh", "D_drawdown_252")
#: Rows up to which a table of sessions is broadcast; a century of sessions is under 40,000.
BROADCAST_SESSIONS = 100_000


def _by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session")


def _by_session() -> WindowSpec:
    return Window.partitionBy("session")


def small(sessions: DataFrame) -> DataFrame:
    """A table with one row per session, broadcast if it is as small as that should be; the size is checked."""
    return F.broadcast(sessions) if sessions.limit(BROADCAST_SESSIONS + 1).count() <= BROADCAST_SESSIONS else sessions


def turnover_median(amount: str = "D_dollar_vol", window: int = LIQ_WINDOW, least: int = LIQ_MIN_OBSERVATIONS) -> Column:
    """The symbol's median turnover over its own last bars, this one included."""
    w = _by_symbol().rowsBetween(-(window - 1), 0)
    return F.when(F.count(amount).over(w) >= least, F.percentile(amount, F.lit(0.5)).over(w))


def liquidity_floor(frame: DataFrame, floor: float) -> DataFrame:
    """Rows whose trailing median turnover reaches the floor; an unknown median does not."""
    return frame.withColumn("X_turnover_med", turnover_median()).filter(F.coalesce(F.col("X_turnover_med") >= floor, F.lit(False)))


def rank_pct(c: str) -> Column:
    """Average-tie percentile rank within the session; null has none and counts for nothing."""
    lower = F.rank().over(_by_session().orderBy(F.col(c).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy("session", c))
    return F.when(F.col(c).isNotNull(), (lower + (ties - 1) / F.lit(2.0)) / F.count(c).over(_by_session()))


def z_in_session(c: str, bound: float = 5.0) -> Column:
    z = (F.col(c) - F.avg(c).over(_by_session())) / F.nullif(F.stddev_samp(c).over(_by_session()), F.lit(0.0))
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-bound)), F.lit(bound)))


def cross_section(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """X_rank_ and X_z_ of every column, and X_universe_size, the rows of the session."""
    made = {"X_universe_size": F.count(F.lit(1)).over(_by_session())}
    for c in columns:
        made[f"X_rank_{c}"] = rank_pct(c)
        made[f"X_z_{c}"] = z_in_session(c)
    return frame.select("*", *(e.alias(n) for n, e in made.items()))


def thin_sessions(frame: DataFrame, least: int) -> DataFrame:
    return frame.filter(F.col("X_universe_size") >= least)


def drop_warmup(frame: DataFrame) -> DataFrame:
    return frame.filter("D_is_warmup = 0").drop("D_is_warmup")


def min_history(bars: DataFrame, least: int = WARMUP_BARS + LABEL_HORIZON) -> DataFrame:
    """Bars of symbols with at least so many."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return bars.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def market_relative(frame: DataFrame, market: DataFrame) -> DataFrame:
    """The market's own features, and return and volatility relative to it.  `market` holds bars of one symbol."""
    own = drop_warmup(features(market, [*MARKET, "D_is_warmup"], keep=("session",)))
    own = own.select("session", *(F.col(c).alias(f"MKT_{c}") for c in MARKET))
    out = frame.join(small(own), "session", "left")
    return out.withColumn("X_excess_ret_1d", F.col("D_ret_1d_pct") - F.col("MKT_D_ret_1d_pct")).withColumn(
        "X_relvol_20", F.col("D_realvol_20") / F.nullif(F.col("MKT_D_realvol_20"), F.lit(0.0))
    )


def align(series: DataFrame, sessions: DataFrame, name: str, lag: int = 0) -> DataFrame:
    """A series (session, close) on the calendar: <name>_close, forward-filled and lagged, <name>_stale and <name>_ret_1d.

    Stale counts the sessions since the series last had a row; before its first, since the calendar began.  One ordered
    pass over the sessions, of which there are a few thousand.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("session")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    one = series.groupBy("session").agg(F.max("close").alias("_close"))
    on = sessions.select("session").distinct().join(one.withColumn("_fresh", F.lit(1)), "session", "left")
    filled = on.select("session", F.last("_close", True).over(so_far).alias("_c"), F.coalesce("_fresh", F.lit(0)).alias("_f"))
    if lag:
        filled = filled.select("session", F.lag("_c", lag).over(line).alias("_c"), F.coalesce(F.lag("_f", lag).over(line), F.lit(0)).alias("_f"))
    grouped = filled.withColumn("_g", F.sum("_f").over(so_far))
    stale = F.row_number().over(Window.partitionBy("_g").orderBy("session")) - 1
    ret = F.col("_c") / F.nullif(F.lag("_c").over(line), F.lit(0.0)) - 1
    return grouped.select("session", F.col("_c").alias(f"{name}_close"), stale.alias(f"{name}_stale"), ret.alias(f"{name}_ret_1d"))


def exogenous(frame: DataFrame, series: dict[str, tuple[DataFrame, int]], sessions: DataFrame) -> DataFrame:
    """Joins series, given with their lags, after aligning all of them: one join for all."""
    together = None
    for name, (rows, lag) in series.items():
        one = align(rows, sessions, name, lag)
        together = one if together is None else together.join(one, "session")
    return frame if together is None else frame.join(small(together), "session", "left")


def build(bars: DataFrame, config: PanelConfig = PanelConfig(), market: DataFrame | None = None, series: dict[str, tuple[DataFrame, int]] | None = None, since=None) -> DataFrame:
    """The whole panel from the bars of all symbols, or only its sessions from `since` on.

    With `since`, what compares symbols works on those sessions alone, and the floor on as many earlier bars of each
    symbol as its median looks back over; values are those of the whole panel.
    """
    names = list(config.features) or None
    wanted = None if names is None else list(dict.fromkeys([*names, *config.cross_sectional, "D_dollar_vol", "D_ret_1d_pct", "D_realvol_20", "D_is_warmup"]))
    kept = min_history(bars)
    frame = features(kept, wanted)
    labelled = labels(kept, config.horizon)
    frame = drop_warmup(frame).drop("ret_5d_close_pct").join(labelled, ["symbol", "session"], "left")
    if since is not None:
        before = F.row_number().over(Window.partitionBy("symbol", F.col("session") >= F.lit(since)).orderBy(F.desc("session")))
        frame = frame.withColumn("_before", before).filter((F.col("session") >= F.lit(since)) | (F.col("_before") < LIQ_WINDOW)).drop("_before")
    frame = liquidity_floor(frame, config.liquidity_floor)
    if since is not None:
        frame = frame.filter(F.col("session") >= F.lit(since))
    frame = cross_section(frame, config.cross_sectional)
    if market is not None:
        frame = market_relative(frame, market)
    if series:
        frame = exogenous(frame, series, bars.select("session").distinct())
    frame = thin_sessions(frame, config.min_universe)
    return downcast(frame) if config.downcast else frame


def downcast(frame: DataFrame) -> DataFrame:
    """Features as 32-bit floats; labels keep their width."""
    return frame.select(*(F.col(c).cast("float").alias(c) if t == "double" and not c.startswith("label_") else F.col(c) for c, t in frame.dtypes))


def universe_hash(symbols: DataFrame) -> DataFrame:
    """SHA-256 of the sorted distinct symbols, in hex, the first 16 digits.  One row per symbol meets in one task."""
    return symbols.agg(F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.collect_set(F.col("symbol").cast("string")))), 256), 1, 16).alias("universe_hash"))


def signature(config: PanelConfig, universe: str, version: int = 1) -> str:
    """What a stored panel was built from; a different one forbids an incremental update."""
    return hashlib.sha256(json.dumps({**asdict(config), "universe": universe, "version": version}, sort_keys=True).encode()).hexdigest()[:16]


def upsert(stored: DataFrame, fresh: DataFrame, since, allowed: DataFrame | None = None) -> DataFrame:
    """Stored rows before `since`, of the symbols still allowed, and the fresh ones from then on.

    The two ranges are disjoint, so nothing needs deduplication.
    """
    old = stored.filter(F.col("session") < F.lit(since))
    if allowed is not None:
        old = old.join(allowed.select("symbol").distinct(), "symbol", "left_semi")
    return old.unionByName(fresh.filter(F.col("session") >= F.lit(since)), allowMissingColumns=True)


def refresh(bars: DataFrame, path: str, config: PanelConfig = PanelConfig(), market: DataFrame | None = None, series: dict[str, tuple[DataFrame, int]] | None = None) -> str:
    """Brings a stored panel up to date: `incremental` where it was built from the same symbols and settings, else `full`.

    An incremental run builds and replaces the months that hold the last `rebuild_days` sessions and what came after.
    Features read whole histories of a symbol either way, since some depend on all of it, so that both give the same rows.
    """
    from candlewick.sources import files

    spark = bars.sparkSession
    mark = signature(config, universe_hash(bars.select("symbol").distinct()).first()[0])
    stored = files.read_json(spark, f"{path}_signature")
    if stored and stored.get("signature") == mark:
        last = files.read_panel(spark, path, ["session"]).distinct().orderBy(F.desc("session")).limit(config.rebuild_days).agg(F.min("session")).first()[0]
        if last is not None:
            since = last.replace(day=1)
            files.write_panel(build(bars, config, market, series, since), path, dynamic=True)
            return "incremental"
    files.write_panel(build(bars, config, market, series), path)
    files.write_json(spark, {"signature": mark}, f"{path}_signature")
    return "full"


def panel_meta(panel: DataFrame, label: str = "label_tp_before_sl") -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("session").alias("sessions"),
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.count(label).alias("labels_resolved"),
        F.count_if(F.col(label).isNull()).alias("labels_pending"),
        F.avg(label).alias("label_positive_rate"),
    )


def panel_columns(panel: DataFrame) -> list[str]:
    """Columns a model may use: neither keys nor anything that looks ahead."""
    from candlewick.operators.contract import is_forward_name

    return [c for c in panel.columns if c not in ("symbol", "session", *label_names()) and not is_forward_name(c)]
