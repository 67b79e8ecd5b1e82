"""Every per-symbol feature as a formula over bars, in terms of a dialect's kernels.

A formula may use any other column by name; names not starting with D_, W_, DOW_ or Comb_ are intermediate.  Columns
present from the start are symbol, session, rn (the bar's number within its symbol, from 1) and the bar's prices and
volume; `week_*` and `month_*` come from the weekly and monthly frames, recursive columns from `recursive`.
"""

from __future__ import annotations

import math
import re

from candlewick.functions.dialects import ORDER, Duck, Spark

BAR = ("symbol", "session", "open", "high", "low", "close", "volume")
WEEKLY = ("week_ret_4", "week_ret_13", "week_close_pos", "week_vol_vs_4", "week_prev_high")
MONTHLY = ("month_prev_high",)


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def clip(x: str, low: float, high: float) -> str:
    """Null stays null."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE)) END"


def over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def relation(base_bc: str, base_tc: str, other_bc: str, other_tc: str) -> str:
    known = " AND ".join(f"({x}) IS NOT NULL" for x in (base_bc, base_tc, other_bc, other_tc))
    return (
        f"CASE WHEN NOT ({known}) THEN NULL WHEN {other_bc} <= {base_tc} AND {other_tc} >= {base_bc} THEN 'Inside' "
        f"WHEN {other_tc} < {base_bc} THEN 'Below' WHEN {other_bc} > {base_tc} THEN 'Above' ELSE 'Overlap' END"
    )


def code(x: str, up: str, down: str) -> str:
    return f"CASE WHEN {x} = '{up}' THEN 1 WHEN {x} = '{down}' THEN -1 ELSE 0 END"


def zscore(k: Spark, x: str, n: int) -> str:
    return f"({x} - {k.mean(x, n)}) / nullif({k.std(x, n)}, 0)"


def trend(running: str, previous: str) -> str:
    return f"CASE WHEN {running} > {previous} THEN 1 WHEN {running} < {previous} THEN -1 ELSE 0 END"


def formulas(k: Spark) -> dict[str, str]:
    year = repr(math.sqrt(252))
    f: dict[str, str] = {
        # intermediate columns
        "rng": "high - low",
        "rng0": "nullif(high - low, 0)",
        "prev_close": k.lag("close"),
        "ret": over("close", k.lag("close")) + " - 1",
        "typical": "(high + low + close) / 3.0",
        "week_end": k.date_part("week_end"),
        "month_start": k.date_part("month"),
        "atr0": "nullif(D_atr14, 0)",
        "std20": k.std("close", 20),
        "money_flow": "((close - low) - (high - close)) / rng0 * volume",
        "hi20": k.roll("max", "high", 20, lag=1),
        "lo20": k.roll("min", "low", 20, lag=1),
        "hi50": k.roll("max", "high", 50, lag=1),
        "lo50": k.roll("min", "low", 50, lag=1),
        "hi252": k.roll("max", "high", 252, lag=1),
        "lo252": k.roll("min", "low", 252, lag=1),
        "y_bc": f"({k.lag('high')} + {k.lag('low')}) / 2.0",
        "y_tc": f"2 * ({k.lag('high')} + {k.lag('low')} + {k.lag('close')}) / 3.0 - ({k.lag('high')} + {k.lag('low')}) / 2.0",
        "log_oc": k.log(over("open", "prev_close")),
        "log_co": k.log(over("close", "open")),
        "log_ho": k.log(over("high", "open")),
        "log_lo": k.log(over("low", "open")),
        "log_hc": k.log(over("high", "close")),
        "log_lc": k.log(over("low", "close")),
        "yz": "log_oc * log_oc + 0.34D * log_co * log_co + 0.66D * (log_ho * log_hc + log_lo * log_lc)",
        "yz20": k.mean("yz", 20),
        "yz50": k.mean("yz", 50),
        "midpoint": "(high + low) / 2.0",
        "slope5": k.slope("close", 5),
        "slope_mid10": k.slope("midpoint", 10),
        "signed_volume": f"CASE WHEN rn = 1 THEN 0 * volume ELSE sign(close - {k.lag('close')}) * volume END",
        "big_up": flag("ret >= 0.05"),
        "down": "CASE WHEN ret < 0 THEN ret ELSE 0.0D END",
        "down2": "CASE WHEN ret < 0 THEN ret * ret ELSE 0.0D END",
        "up": "CASE WHEN ret > 0 THEN ret ELSE 0.0D END",
        "illiquidity": over("abs(ret)", "D_dollar_vol") + " * 10000000",
        "trailing_ret5": f"({over('close', k.lag('close', 5))} - 1) * 100",
        "bw_values": k.values("D_bb_bw_20", 50),
        "mdi_values10": k.values("D_mdi14", 10),
        "mdi_values20": k.values("D_mdi14", 20),
        "vol_values5": k.values("volume", 5),
        "high_values5": k.values("high", 5),
        "vol_values32": k.values("volume", 32),
        "sum_chl": "close + high - low",
        "chl_values16": k.values("sum_chl", 16),
        "ret_values32": k.values("ret", 32),
        "tsrank_v5": k.rank_in("vol_values5", "volume", 3),
        "tsrank_h5": k.rank_in("high_values5", "high", 3),
        "corr_vh5": k.corr("tsrank_v5", "tsrank_h5", 5, 5),
        "week_rows": k.week_list(),
        "week_low_tp": "min(CASE WHEN volume IS NOT NULL THEN typical END) OVER (PARTITION BY symbol, week_end ORDER BY session ROWS UNBOUNDED PRECEDING)",
        "week_high_tp": "max(CASE WHEN volume IS NOT NULL THEN typical END) OVER (PARTITION BY symbol, week_end ORDER BY session ROWS UNBOUNDED PRECEDING)",
        "week_run_high": "max(high) OVER (PARTITION BY symbol, week_end ORDER BY session ROWS UNBOUNDED PRECEDING)",
        "month_run_high": "max(high) OVER (PARTITION BY symbol, month_start ORDER BY session ROWS UNBOUNDED PRECEDING)",
        # returns, references, pivots
        "D_ret_1d_pct": "ret * 100",
        "D_cmf20": over(k.roll("sum", "money_flow", 20), k.roll("sum", "volume", 20)),
        "D_prev_high": k.lag("high"),
        "D_prev_low": k.lag("low"),
        "D_prev_close": "prev_close",
        "D_inside_day": flag("high <= D_prev_high AND low >= D_prev_low"),
        "D_prev_inside_day": f"coalesce({k.lag('D_inside_day')}, 0)",
        "D_cpr_pivot": "typical",
        "D_cpr_bc": "(high + low) / 2.0",
        "D_cpr_tc": "2 * typical - (high + low) / 2.0",
        "D_pivot": "typical",
        "D_support1": "2 * typical - high",
        "D_resistance1": "2 * typical - low",
        "D_support2": "typical - rng",
        "D_resistance2": "typical + rng",
        "D_vpoc": "typical",
        "D_weekly_vpoc": (
            "CASE WHEN week_low_tp IS NULL THEN NULL WHEN week_high_tp - week_low_tp <= 0.000000001D * greatest(abs(week_low_tp), abs(week_high_tp)) THEN week_low_tp "
            f"ELSE week_low_tp + ({k.heaviest_bin('week_rows', 'week_low_tp', 'week_high_tp')} + 0.5D) * (week_high_tp - week_low_tp) / 50 END"
        ),
        # narrow ranges
        "D_nr": flag(f"rng < {k.roll('min', 'rng', 6, lag=1)}"),
        "D_nr_length": k.streak("D_nr"),
        "D_nr_day": "CASE " + " ".join(f"WHEN rng < {k.roll('min', 'rng', w - 1, lag=1)} THEN {w}" for w in range(20, 4, -1)) + " ELSE 0 END",
        "D_sma5": k.mean("close", 5),
        "D_sma20": k.mean("close", 20),
        "D_sma50": k.mean("close", 50),
        "D_sma200": k.mean("close", 200),
        "D_rsi7_gt_rsi14": flag("D_rsi7 > D_rsi14"),
        "D_ema_stack_20_50_100": flag("D_ema20 > D_ema50 AND D_ema50 > D_ema100"),
        "D_ema20_angle_deg": f"degrees(atan((D_ema20 - {k.lag('D_ema20')}) / nullif({k.lag('D_ema20')}, 0)))",
        "D_atr_ratio_14_30": over("D_atr14", "D_atr30"),
        "D_cpr_width_pct": over("D_cpr_tc - D_cpr_bc", "close") + " * 100",
        "D_tmr_cpr_bc": "D_cpr_bc",
        "D_tmr_cpr_tc": "D_cpr_tc",
        "D_tmr_cpr_vs_today": relation("y_bc", "y_tc", "D_tmr_cpr_bc", "D_tmr_cpr_tc"),
        "D_cpr_vs_yday": relation("y_bc", "y_tc", "D_cpr_bc", "D_cpr_tc"),
        "D_hh": flag("high > D_prev_high"),
        "D_hl": flag("low > D_prev_low"),
        "D_lh": flag("high < D_prev_high"),
        "D_ll": flag("low < D_prev_low"),
        "D_daily_trend": "CASE WHEN D_hh = 1 THEN 1 WHEN D_lh = 1 THEN -1 ELSE 0 END",
        "D_weekly_trend": trend("week_run_high", "week_prev_high"),
        "D_monthly_trend": trend("month_run_high", "month_prev_high"),
        "D_structure_trend": "CASE WHEN D_hh = 1 AND D_hl = 1 THEN 'uptrend' WHEN D_lh = 1 AND D_ll = 1 THEN 'downtrend' ELSE 'range' END",
        "D_tmr_cpr_vs_today_code": code("D_tmr_cpr_vs_today", "Above", "Below"),
        "D_cpr_vs_yday_code": code("D_cpr_vs_yday", "Above", "Below"),
        "D_structure_trend_code": code("D_structure_trend", "uptrend", "downtrend"),
        "D_oli": "(open - low) / rng0",
        "D_day_type": "CASE WHEN open > D_cpr_tc THEN 'bullish' WHEN open < D_cpr_bc THEN 'bearish' ELSE 'inside' END",
        "D_range_to_atr14": "rng / atr0",
        "D_golden_regime": flag("close > D_sma200 AND D_sma50 > D_sma200"),
        # volume
        "D_obv": k.total("signed_volume"),
        "D_obv_slope": f"D_obv - {k.lag('D_obv')}",
        "D_price_and_obv_rising": flag(f"close > prev_close AND D_obv > {k.lag('D_obv')}"),
        "D_dow": k.date_part("weekday"),
        **{f"DOW_{d}": flag(f"D_dow = {d}") for d in range(7)},
        # bands, volatility, channels
        "D_bb_pctB_20": clip("(close - (D_sma20 - 2 * std20)) / nullif(4 * std20, 0)", -5, 5),
        "D_bb_bw_20": over("4 * std20", "D_sma20"),
        "D_vol_yz_20": k.root("yz20"),
        "D_vol_yz_50": k.root("yz50"),
        "D_donch_pos_20": clip(over("close - lo20", "hi20 - lo20"), -1, 2),
        "D_donch_pos_50": clip(over("close - lo50", "hi50 - lo50"), -1, 2),
        "D_breakout_high_20": flag("high > hi20"),
        "D_breakout_low_20": flag("low < lo20"),
        "D_breakout_high_50": flag("high > hi50"),
        "D_breakout_low_50": flag("low < lo50"),
        "D_days_since_boh_20": k.since("D_breakout_high_20"),
        "D_days_since_bol_20": k.since("D_breakout_low_20"),
        "D_dollar_vol": "close * volume",
        "D_dvol_z20": zscore(k, "D_dollar_vol", 20),
        "D_dvol_z50": zscore(k, "D_dollar_vol", 50),
        "D_dvol_z252": zscore(k, "D_dollar_vol", 252),
        **{
            f"D_vol_surge_{n}": f"CASE WHEN volume > {k.mean('volume', n)} + 2 * {k.std('volume', n)} THEN 1 WHEN volume <= {k.mean('volume', n)} + 2 * {k.std('volume', n)} THEN 0 END"
            for n in (20, 50)
        },
        "D_atr_pct": over("D_atr14", "close") + " * 100",
        "D_range_pct": over("rng", "close") + " * 100",
        "D_gap_pct": over("open - prev_close", "prev_close") + " * 100",
        "D_atr14_to_close_pct": over("D_atr14", "close") + " * 100",
        "D_rsi14_z252": zscore(k, "D_rsi14", 252),
        "D_atr_pct_z252": zscore(k, "D_atr_pct", 252),
        "D_vol_z252": zscore(k, "volume", 252),
        "D_ema20_angle_z252": zscore(k, "D_ema20_angle_deg", 252),
        "D_rsi14_obv_x": "D_rsi14 * D_obv_slope",
        "D_rsi7_obv_x": "D_rsi7 * D_obv_slope",
        "ret_5d_close_pct": f"({over(k.lag('close', -5), 'close')} - 1) * 100",
        "D_ret_5d_roll_std": k.std("trailing_ret5", 50),
        "D_close_roll_slope_20": k.slope("close", 20),
        "D_close_roll_slope_50": k.slope("close", 50),
        # combinations
        "Comb_RSIslopePos__ADX_15_25": flag(f"D_rsi14 - {k.lag('D_rsi14')} > 0 AND D_adx14 >= 15 AND D_adx14 <= 25"),
        "Comb_GapUp__CPR_Tmr_Above": flag("D_gap_pct > 0 AND D_tmr_cpr_vs_today_code = 1"),
        "Comb_GapDown__CPR_Tmr_Below": flag("D_gap_pct < 0 AND D_tmr_cpr_vs_today_code = -1"),
        "Comb_ATRlow__EMA20pos": flag("D_atr_pct <= 2 AND D_ema20_angle_deg > 0"),
        "Comb_ATRhigh__EMA20neg": flag("D_atr_pct >= 4 AND D_ema20_angle_deg < 0"),
        # structure
        "D_body_ratio": clip("(close - open) / rng0", -1, 1),
        "D_wick_skew": clip("((high - greatest(close, open)) - (least(close, open) - low)) / rng0", -1, 1),
        "D_hh_run": k.streak("D_hh"),
        "D_hl_run": k.streak("D_hl"),
        "D_lh_run": k.streak("D_lh"),
        "D_ll_run": k.streak("D_ll"),
        "D_nr_expand": flag(f"rng > {k.lag('rng')}"),
        "D_compress_state": k.rank_in("bw_values", "D_bb_bw_20", 10),
        "D_dist_from_20h": "(close - hi20) / atr0",
        "D_dist_from_20l": "(close - lo20) / atr0",
        "D_dist_from_52wh": "(close - hi252) / atr0",
        "D_dist_from_52wl": "(close - lo252) / atr0",
        "D_midpoint_slope": "slope_mid10 / atr0",
        "D_slope_stability": k.std("slope5", 20, 5),
        "W_ret_4w": "week_ret_4",
        "W_ret_13w": "week_ret_13",
        "W_close_pos": "week_close_pos",
        "W_vol_vs_4w": "week_vol_vs_4",
        # alphas that are not recursive
        "D_WQ_6": f"-({k.corr('open', 'volume', 10, 5)})",
        "D_WQ_12": f"sign(volume - {k.lag('volume')}) * -(close - prev_close)",
        "D_WQ_23": f"CASE WHEN {k.mean('high', 20, 10)} < high THEN -(high - {k.lag('high', 2)}) ELSE 0.0D END",
        "D_WQ_26": f"-({k.roll('max', 'corr_vh5', 3)})",
        "D_WQ_35": (
            f"{k.rank_in('vol_values32', 'volume', 16)} * (1 - {k.rank_in('chl_values16', 'sum_chl', 8)}) * (1 - {k.rank_in('ret_values32', 'ret', 16)})"
        ),
        "D_WQ_41": "sqrt(high * low) - typical",
        # transforms
        "D_slope_stability_rmean50": k.mean("D_slope_stability", 50, 12),
        "D_slope_stability_rstd10": k.std("D_slope_stability", 10, 3),
        "D_slope_stability_rstd20": k.std("D_slope_stability", 20, 5),
        "D_body_ratio_rmean50": k.mean("D_body_ratio", 50, 12),
        "D_body_ratio_rmean20": k.mean("D_body_ratio", 20, 5),
        "D_close_roll_slope_20_rstd20": k.std("D_close_roll_slope_20", 20, 5),
        "D_close_roll_slope_20_rstd10": k.std("D_close_roll_slope_20", 10, 3),
        "D_macd_hist_rstd10": k.std("D_macd_hist", 10, 3),
        "D_mdi14_diff1": f"D_mdi14 - {k.lag('D_mdi14')}",
        "D_mdi14_diff5": f"D_mdi14 - {k.lag('D_mdi14', 5)}",
        "D_mdi14_rrank10": k.rank_in("mdi_values10", "D_mdi14", 3),
        "D_mdi14_rrank20": k.rank_in("mdi_values20", "D_mdi14", 5),
        "D_donch_pos_50_rmean50": k.mean("D_donch_pos_50", 50, 12),
        "D_donch_pos_50_lag5": k.lag("D_donch_pos_50", 5),
        "D_donch_pos_20_rmean50": k.mean("D_donch_pos_20", 50, 12),
        "D_donch_pos_20_lag5": k.lag("D_donch_pos_20", 5),
        "D_cmf20_rmean50": k.mean("D_cmf20", 50, 12),
        "D_pos_in_52w_range": clip(over("close - lo252", "hi252 - lo252"), -0.5, 1.5),
        "D_drawdown_252": over("close", k.roll("max", "close", 252)) + " - 1",
        "D_intraday_ret_pct": over("close - open", "open") + " * 100",
        "D_overnight_share": over("D_gap_pct", "abs(D_gap_pct) + abs(D_intraday_ret_pct)"),
        "D_amihud_20": k.mean("illiquidity", 20),
        "D_amihud_60": k.mean("illiquidity", 60),
        "D_realvol_20": f"{k.std('ret', 20)} * {year}D * 100",
        "D_realvol_60": f"{k.std('ret', 60)} * {year}D * 100",
        "D_realvol_ratio_20_60": over("D_realvol_20", "D_realvol_60"),
        "D_ret_skew_60": k.skew("ret", 60),
        "D_ret_kurt_60": k.kurt("ret", 60),
        "D_downside_dev_60": f"sqrt({k.mean('down2', 60)}) * {year}D * 100",
        "D_upside_vol_ratio": over(k.std("up", 60), k.std("down", 60)),
        "D_days_since_5pct_up": k.since("big_up"),
        "D_n_5pct_up_60": k.roll("sum", "big_up", 60),
        "D_n_5pct_up_252": k.roll("sum", "big_up", 252),
        "D_is_warmup": flag(f"count(*) OVER (PARTITION BY symbol) > 312 AND rn <= 312"),
    }
    # a case without an alternative needs its brackets where it is an operand
    if k.name != "spark":  # Spark's mark of a double
        f = {name: re.sub(r"(?<=\d)D\b", "", text) for name, text in f.items()}
    return {name: f"({text})" for name, text in f.items()}


def recursive_formulas(k: Duck) -> dict[str, str]:
    """The recursive columns for the oracle: means that decay exponentially, and ranks among all bars so far."""

    def ewm(x: str, alpha: float, least: int) -> str:
        w = f"OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"
        keep = repr(1 - alpha)
        step = (
            f"lambda a, v: CASE WHEN v.y IS NULL THEN {{'y': a.y, 'w': a.w * {keep}}} WHEN a.y IS NULL THEN {{'y': v.y, 'w': 1.0::DOUBLE}} "
            f"ELSE {{'y': (a.w * {keep} * a.y + {alpha!r} * v.y) / (a.w * {keep} + {alpha!r}), 'w': 1.0::DOUBLE}} END"
        )
        return f"(CASE WHEN count({x}) {w} >= {least} THEN list_reduce(list({{'y': CAST({x} AS DOUBLE), 'w': 1.0::DOUBLE}}) {w}, {step}).y END)"

    def xrank(values: str, x: str) -> str:
        return k.rank_in(values, x, 60)

    def so_far(x: str) -> str:
        return f"list({x}) FILTER (WHERE ({x}) IS NOT NULL) OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"

    f: dict[str, str] = {}

    def ranked(name: str, x: str) -> str:
        f[f"x_{name}"], f[f"all_{name}"] = f"({x})", so_far(f"x_{name}")
        f[f"xr_{name}"] = xrank(f"all_{name}", f"x_{name}")
        return f"xr_{name}"

    for n in (20, 50, 100):
        f[f"D_ema{n}"] = ewm("close", 2 / (n + 1), n)
    f |= {"ema12": ewm("close", 2 / 13, 12), "ema26": ewm("close", 2 / 27, 26), "D_macd": "(ema12 - ema26)"}
    f |= {"D_macd_signal": ewm("D_macd", 2 / 10, 9), "D_macd_hist": "(D_macd - D_macd_signal)"}
    f |= {"gain": f"(CASE WHEN rn > 1 THEN greatest(close - {k.lag('close')}, 0.0) END)", "loss": f"(CASE WHEN rn > 1 THEN greatest({k.lag('close')} - close, 0.0) END)"}
    for n in (7, 14):
        f[f"gain{n}"], f[f"loss{n}"] = ewm("gain", 1 / n, n), ewm("loss", 1 / n, n)
        f[f"D_rsi{n}"] = (
            f"(CASE WHEN gain{n} = 0 AND loss{n} = 0 THEN 50.0 WHEN loss{n} = 0 THEN 100.0 WHEN gain{n} = 0 THEN 0.0 ELSE 100 - 100 / (1 + gain{n} / loss{n}) END)"
        )
    f["tr"] = f"(greatest(high - low, coalesce(abs(high - {k.lag('close')}), high - low), coalesce(abs(low - {k.lag('close')}), high - low)))"
    f |= {"D_atr14": ewm("tr", 1 / 14, 14), "D_atr30": ewm("tr", 1 / 30, 30)}
    f |= {"up_move": f"(high - {k.lag('high')})", "down_move": f"({k.lag('low')} - low)"}
    f |= {"plus_dm": "(CASE WHEN up_move > down_move AND up_move > 0 THEN up_move ELSE 0.0 END)", "minus_dm": "(CASE WHEN down_move > up_move AND down_move > 0 THEN down_move ELSE 0.0 END)"}
    f |= {"D_pdi14": f"(100 * {ewm('plus_dm', 1 / 14, 14)} / nullif(D_atr14, 0))", "D_mdi14": f"(100 * {ewm('minus_dm', 1 / 14, 14)} / nullif(D_atr14, 0))"}
    f |= {"dx": "(abs(D_pdi14 - D_mdi14) / nullif(D_pdi14 + D_mdi14, 0) * 100)", "D_adx14": ewm("dx", 1 / 14, 14)}

    o, v, c, h = (ranked(x, x) for x in ("open", "volume", "close", "high"))
    f["D_WQ_3"] = f"(-({k.corr(o, v, 10, 5)}))"
    for n, a in ((13, c), (16, h)):
        f[f"D_WQ_{n}"] = f"(-{ranked(f'cov{n}', k.cov(a, v, 5, 3))})"
    f["sum250"] = f"({k.roll('sum', 'ret', 250, 50)})"
    f["d5"] = f"(close - {k.lag('close', 5)})"
    f["less7"] = f"(close - {k.lag('close', 7)})"
    f["D_WQ_19"] = f"(-sign(less7 - {k.lag('less7', 5)} + d5) * (1 + {ranked('sum', '1 + sum250')}))"
    f["D_WQ_20"] = f"(-{ranked('oh', 'open - ' + k.lag('high'))} * {ranked('oc', 'open - ' + k.lag('close'))} * {ranked('ol', 'open - ' + k.lag('low'))})"
    f["D_WQ_29"] = f"({ranked('r2', ranked('r1', '-' + ranked('d5', 'd5')))})"
    f["D_WQ_33"] = f"({ranked('o_c', '-1 + open / nullif(close, 0)')})"
    f["close10"] = k.values("close", 10)
    f["D_WQ_38"] = f"(-{ranked('ts10', k.rank_in('close10', 'close', 5))} * {ranked('c_o', 'close / nullif(open, 0)')})"
    f["D_WQ_40"] = f"(-{ranked('std10', k.std('high', 10, 5))} * {k.corr('high', 'volume', 10, 5)})"
    f["D_WQ_44"] = f"(-({k.corr('high', v, 5, 5)}))"
    return f


RECURSIVE = (
    "D_ema20 D_ema50 D_ema100 D_macd D_macd_signal D_macd_hist D_rsi7 D_rsi14 D_atr14 D_atr30 D_pdi14 D_mdi14 D_adx14 "
    "D_WQ_3 D_WQ_13 D_WQ_16 D_WQ_19 D_WQ_20 D_WQ_29 D_WQ_33 D_WQ_38 D_WQ_40 D_WQ_44"
).split()


def feature_names() -> list[str]:
    """Every feature column, without the forward label."""
    own = [n for n in formulas(Spark()) if n.startswith(("D_", "W_", "DOW_", "Comb_"))]
    return [*RECURSIVE, *own]
