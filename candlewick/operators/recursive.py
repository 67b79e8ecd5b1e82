"""Kernels in which a bar's value depends on the one before: exponential means, and ranks among all bars so far.

Spark's windows can only rebuild these from all earlier bars, once per bar.  Here a symbol's bars, a few thousand rows
at most, are one group, and each kernel passes over them once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Columns = dict[str, pd.Series]


def _ewm(x: pd.Series, alpha: float, least: int) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()


def _span(x: pd.Series, n: int) -> pd.Series:
    return _ewm(x, 2 / (n + 1), n)


def _rank(x: pd.Series) -> pd.Series:
    return x.expanding(60).rank(pct=True)


def _over(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def _varies(x: pd.Series, n: int) -> pd.Series:
    r = x.rolling(n, min_periods=1)
    return r.max() > r.min()


def _corr(a: pd.Series, b: pd.Series, n: int, least: int) -> pd.Series:
    both = a.notna() & b.notna()
    a, b = a.where(both), b.where(both)
    return a.rolling(n, min_periods=least).corr(b).where(_varies(a, n) & _varies(b, n))


def _rsi(c: pd.Series, n: int) -> pd.Series:
    step = c.diff()
    gain, loss = _ewm(step.clip(lower=0), 1 / n, n), _ewm(-step.clip(upper=0), 1 / n, n)
    out = 100 - 100 / (1 + _over(gain, loss))
    out[(loss == 0) & (gain > 0)] = 100.0
    out[(gain == 0) & (loss == 0)] = 50.0
    return out


def _directional(b: Columns) -> Columns:
    h, l, c = b["high"], b["low"], b["close"]
    spread = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    up, down = h.diff(), -l.diff()
    atr = _ewm(spread, 1 / 14, 14)
    plus = 100 * _over(_ewm(up.where((up > down) & (up > 0), 0.0), 1 / 14, 14), atr)
    minus = 100 * _over(_ewm(down.where((down > up) & (down > 0), 0.0), 1 / 14, 14), atr)
    index = _over((plus - minus).abs(), plus + minus) * 100
    return {"D_atr14": atr, "D_atr30": _ewm(spread, 1 / 30, 30), "D_pdi14": plus, "D_mdi14": minus, "D_adx14": _ewm(index, 1 / 14, 14)}


def _macd(b: Columns) -> Columns:
    line = _span(b["close"], 12) - _span(b["close"], 26)
    signal = _span(line, 9)
    return {"D_macd": line, "D_macd_signal": signal, "D_macd_hist": line - signal}


def _averages(b: Columns) -> Columns:
    return {f"D_ema{n}": _span(b["close"], n) for n in (20, 50, 100)} | {f"D_rsi{n}": _rsi(b["close"], n) for n in (7, 14)}


def _alphas(b: Columns) -> Columns:
    o, h, l, c, v = (b[x] for x in ("open", "high", "low", "close", "volume"))
    rv = _rank(v)
    out: Columns = {"D_WQ_3": -_corr(_rank(o), rv, 10, 5), "D_WQ_44": -_corr(h, rv, 5, 5)}
    for n, x in ((13, c), (16, h)):
        out[f"D_WQ_{n}"] = -_rank(_rank(x).rolling(5, min_periods=3).cov(rv))
    turn = -np.sign((c - c.shift(7)).diff(5) + c.diff(5))
    out["D_WQ_19"] = turn * (1 + _rank(1 + c.pct_change(fill_method=None).rolling(250, min_periods=50).sum()))
    out["D_WQ_20"] = -_rank(o - h.shift()) * _rank(o - c.shift()) * _rank(o - l.shift())
    out["D_WQ_29"] = _rank(_rank(-_rank(c.diff(5))))
    out["D_WQ_33"] = _rank(_over(o, c) - 1)
    out["D_WQ_38"] = -_rank(c.rolling(10, min_periods=5).rank(pct=True)) * _rank(_over(c, o))
    out["D_WQ_40"] = -_rank(h.rolling(10, min_periods=5).std()) * _corr(h, v, 10, 5)
    return out


#: What each family gives.
FAMILIES: list[tuple[frozenset[str], Callable[[Columns], Columns]]] = [
    (frozenset("D_ema20 D_ema50 D_ema100 D_rsi7 D_rsi14".split()), _averages),
    (frozenset("D_macd D_macd_signal D_macd_hist".split()), _macd),
    (frozenset("D_atr14 D_atr30 D_pdi14 D_mdi14 D_adx14".split()), _directional),
    (frozenset(f"D_WQ_{n}" for n in (3, 13, 16, 19, 20, 29, 33, 38, 40, 44)), _alphas),
]


def add_recursive(bars: DataFrame, names: list[str]) -> DataFrame:
    """`bars` with the recursive columns in `names`; only the families they belong to are computed."""
    families = [f for given, f in FAMILIES if given & set(names)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields] + [f"`{n}` double" for n in names])
    prices = ("open", "high", "low", "close", "volume")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session", ignore_index=True)
        given = {x: pdf[x].astype("float64") for x in prices}
        made: Columns = {}
        for family in families:
            made |= family(given)
        return pdf.assign(**{n: made[n].replace([np.inf, -np.inf], np.nan) for n in names})

    return bars.groupBy("symbol").applyInPandas(run, schema)
