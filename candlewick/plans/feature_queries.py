"""Feature queries by family, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.dialects import Duck
from candlewick.operators.catalogue import BAR, MONTHLY, RECURSIVE, WEEKLY, formulas, recursive_formulas
from candlewick.operators.features import features, layers
from candlewick.sources.bars import lineitem_bars

TEXT = ("D_tmr_cpr_vs_today", "D_cpr_vs_yday", "D_structure_trend", "D_day_type")

#: Query by query, the columns it gives.
FAMILIES: dict[str, str] = {
    "lag_returns": "D_ret_1d_pct D_prev_high D_prev_low D_prev_close D_gap_pct D_intraday_ret_pct D_overnight_share ret_5d_close_pct",
    "sma_5_20": "D_sma5 D_sma20 D_sma50 D_sma200 D_golden_regime",
    "ema_20": "D_ema20 D_ema50 D_ema100 D_ema_stack_20_50_100 D_ema20_angle_deg D_ema20_angle_z252",
    "macd": "D_macd D_macd_signal D_macd_hist D_macd_hist_rstd10",
    "rsi_14": "D_rsi7 D_rsi14 D_rsi7_gt_rsi14 D_rsi14_z252 D_rsi14_obv_x D_rsi7_obv_x",
    "atr_14": "D_atr14 D_atr30 D_atr_ratio_14_30 D_atr_pct D_atr_pct_z252 D_atr14_to_close_pct D_range_pct D_range_to_atr14",
    "adx_14": "D_adx14 D_pdi14 D_mdi14 D_mdi14_diff1 D_mdi14_diff5 D_mdi14_rrank10 D_mdi14_rrank20",
    "pivots": "D_cpr_pivot D_cpr_bc D_cpr_tc D_pivot D_support1 D_resistance1 D_support2 D_resistance2 D_vpoc D_cpr_width_pct D_tmr_cpr_bc D_tmr_cpr_tc",
    "cpr_relations": "D_tmr_cpr_vs_today D_cpr_vs_yday D_tmr_cpr_vs_today_code D_cpr_vs_yday_code D_day_type",
    "structure": "D_inside_day D_prev_inside_day D_hh D_hl D_lh D_ll D_daily_trend D_structure_trend D_structure_trend_code",
    "hh_run": "D_hh_run D_hl_run D_lh_run D_ll_run",
    "nr_day": "D_nr D_nr_length D_nr_day D_nr_expand",
    "obv": "D_obv D_obv_slope D_price_and_obv_rising",
    "weekday_dummies": "D_dow DOW_0 DOW_1 DOW_2 DOW_3 DOW_4 DOW_5 DOW_6",
    "bollinger": "D_bb_pctB_20 D_bb_bw_20",
    "compress_state": "D_compress_state",
    "yang_zhang": "D_vol_yz_20 D_vol_yz_50",
    "donchian_20": "D_donch_pos_20 D_donch_pos_50 D_donch_pos_20_rmean50 D_donch_pos_20_lag5 D_donch_pos_50_rmean50 D_donch_pos_50_lag5",
    "breakout_flags": "D_breakout_high_20 D_breakout_low_20 D_breakout_high_50 D_breakout_low_50 D_days_since_boh_20 D_days_since_bol_20",
    "dollar_vol_z": "D_dollar_vol D_dvol_z20 D_dvol_z50 D_dvol_z252 D_vol_z252 D_vol_surge_20 D_vol_surge_50",
    "cmf_20": "D_cmf20 D_cmf20_rmean50",
    "rolling_slope_20": "D_close_roll_slope_20 D_close_roll_slope_50 D_close_roll_slope_20_rstd20 D_close_roll_slope_20_rstd10",
    "slope_stability": "D_slope_stability D_slope_stability_rmean50 D_slope_stability_rstd10 D_slope_stability_rstd20 D_midpoint_slope",
    "rolling_std_20": "D_ret_5d_roll_std D_realvol_20 D_realvol_60 D_realvol_ratio_20_60",
    "skew_kurt_60": "D_ret_skew_60 D_ret_kurt_60",
    "downside_dev": "D_downside_dev_60 D_upside_vol_ratio",
    "amihud": "D_amihud_20 D_amihud_60",
    "big_moves": "D_days_since_5pct_up D_n_5pct_up_60 D_n_5pct_up_252",
    "candles": "D_oli D_body_ratio D_wick_skew D_body_ratio_rmean50 D_body_ratio_rmean20",
    "anchors_52w": "D_dist_from_20h D_dist_from_20l D_dist_from_52wh D_dist_from_52wl D_pos_in_52w_range D_drawdown_252",
    "combinations": "Comb_RSIslopePos__ADX_15_25 Comb_GapUp__CPR_Tmr_Above Comb_GapDown__CPR_Tmr_Below Comb_ATRlow__EMA20pos Comb_ATRhigh__EMA20neg",
    "weekly_momentum": "W_ret_4w W_ret_13w W_close_pos W_vol_vs_4w",
    "weekly_trend": "D_weekly_trend",
    "monthly_trend": "D_monthly_trend",
    "weekly_vpoc": "D_weekly_vpoc",
    "wq_3": "D_WQ_3 D_WQ_44",
    "wq_6": "D_WQ_6 D_WQ_12 D_WQ_23 D_WQ_41",
    "wq_13": "D_WQ_13 D_WQ_16",
    "wq_19": "D_WQ_19",
    "wq_20": "D_WQ_20",
    "wq_26": "D_WQ_26 D_WQ_35",
    "wq_29": "D_WQ_29 D_WQ_33",
    "wq_38": "D_WQ_38 D_WQ_40",
    "warmup_flag": "D_is_warmup",
}

BARS_SQL = """bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session,
    arg_min(l_extendedprice / l_quantity, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

_WEEKLY_SQL = """weeks AS (
  SELECT symbol, {week} AS week_end, arg_max(close, session) AS c, max(high) AS h, min(low) AS l, coalesce(sum(volume), 0) AS v
  FROM bars WHERE close IS NOT NULL GROUP BY 1, 2),
week_values AS (
  SELECT *, count(*) OVER (PARTITION BY symbol) AS n, (c / nullif(lag(c, 4) OVER w, 0) - 1) * 100 AS r4, (c / nullif(lag(c, 13) OVER w, 0) - 1) * 100 AS r13,
    CASE WHEN h > l THEN least(greatest((c - l) / (h - l), 0.0), 1.0) END AS pos,
    v / nullif(CASE WHEN count(v) OVER p >= 2 THEN avg(v) OVER p END, 0) AS vol
  FROM weeks WINDOW w AS (PARTITION BY symbol ORDER BY week_end), p AS (PARTITION BY symbol ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
weekly AS (
  SELECT symbol, week_end, lag(h) OVER w AS week_prev_high, CASE WHEN n >= 5 THEN lag(r4) OVER w END AS week_ret_4,
    CASE WHEN n >= 5 THEN lag(r13) OVER w END AS week_ret_13, CASE WHEN n >= 5 THEN lag(pos) OVER w END AS week_close_pos,
    CASE WHEN n >= 5 THEN lag(vol) OVER w END AS week_vol_vs_4
  FROM week_values WINDOW w AS (PARTITION BY symbol ORDER BY week_end))"""

_MONTHLY_SQL = """monthly AS (
  SELECT symbol, month_start, lag(h) OVER (PARTITION BY symbol ORDER BY month_start) AS month_prev_high
  FROM (SELECT symbol, {month} AS month_start, max(high) AS h FROM bars GROUP BY 1, 2))"""


def feature_ctes(names: list[str], bars: str = BARS_SQL) -> tuple[str, str]:
    """The common table expressions that end in one with `names` beside the bar, and its name."""
    k = Duck()
    text = formulas(k) | recursive_formulas(k)
    plan, used = layers(names, text, {*BAR, "rn", *WEEKLY, *MONTHLY})
    ctes, joins, early = [bars], "", []
    if used & set(WEEKLY):
        ctes.append(_WEEKLY_SQL.format(week=k.date_part("week_end")))
        joins += " LEFT JOIN weekly USING (symbol, week_end)"
        early.append(f"{k.date_part('week_end')} AS week_end")
    if used & set(MONTHLY):
        ctes.append(_MONTHLY_SQL.format(month=k.date_part("month")))
        joins += " LEFT JOIN monthly USING (symbol, month_start)"
        early.append(f"{k.date_part('month')} AS month_start")
    base = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn" + "".join(f", {e}" for e in early) + " FROM bars"
    ctes.append(f"f0 AS (SELECT * FROM ({base}){joins})")
    ready = {e.split(" AS ")[-1] for e in early}
    for i, layer in enumerate(plan, 1):
        ctes.append(f"f{i} AS (SELECT *, {', '.join(f'{text[n]} AS {n}' for n in layer if n not in ready) or '0 AS _none'} FROM f{i - 1})")
    return ",\n".join(ctes), f"f{len(plan)}"


def duck_round(n: str, digits: int = 6) -> str:
    return n if n in TEXT else f"floor(CAST({n} AS DOUBLE) * 1e{digits} + 0.4837) / 1e{digits} AS {n}"


def feature_sql(names: list[str]) -> str:
    ctes, last = feature_ctes(names)
    return f"WITH {ctes}\nSELECT symbol, session, {', '.join(map(duck_round, names))} FROM {last}"


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """Numbers as doubles on a decimal grid, by the same arithmetic as in the oracle.

    The engines add in different orders; the steps between grid values lie where no simple fraction does.
    """
    kinds, scale = dict(df.dtypes), 10.0**digits

    def near(c: str):
        return (F.floor(F.col(c).cast("double") * scale + 0.4837).cast("double") / scale).alias(c)

    return df.select(*(F.col(c) if c in keep or kinds[c] in ("string", "date", "boolean") else near(c) for c in df.columns))


def _query(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(features(lineitem_bars(spark, sf_dir), names, keep=("symbol", "session")))


QUERIES = {name: _query(columns.split()) for name, columns in FAMILIES.items()}
ORACLE_SQL = {name: feature_sql(columns.split()) for name, columns in FAMILIES.items()}
