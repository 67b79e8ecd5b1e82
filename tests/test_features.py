"""Features against pandas, and what must hold of all of them."""

import numpy as np
import pandas as pd
import pytest

from candlewick.operators import contract
from candlewick.operators.catalogue import feature_names
from candlewick.operators.features import features
from tests.make import bars, series


def got(spark, frame, names):
    out = features(bars(spark, [frame]), names, keep=("session",)).toPandas().sort_values("session", ignore_index=True)
    return out[names].astype("float64")


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-7, atol=1e-9)


@pytest.fixture(scope="module")
def frame():
    return series("A", 420, 3, nulls=4)


def test_rolling_against_pandas(spark, frame):
    c, h, l, v = (frame[x] for x in ("close", "high", "low", "volume"))
    ret = c.pct_change(fill_method=None)
    g = got(spark, frame, ["D_sma20", "D_realvol_20", "D_ret_skew_60", "D_ret_kurt_60", "D_close_roll_slope_20", "D_donch_pos_20", "D_WQ_6", "D_dvol_z20", "D_drawdown_252"])
    same(g.D_sma20, c.rolling(20).mean())
    same(g.D_realvol_20, ret.rolling(20).std() * np.sqrt(252) * 100)
    same(g.D_ret_skew_60, ret.rolling(60).skew())
    same(g.D_ret_kurt_60, ret.rolling(60).kurt())
    same(g.D_close_roll_slope_20, c.rolling(20).apply(lambda y: np.polyfit(np.arange(20), y, 1)[0], raw=True))
    hi, lo = h.shift().rolling(20).max(), l.shift().rolling(20).min()
    same(g.D_donch_pos_20, ((c - lo) / (hi - lo)).clip(-1, 2))
    same(g.D_WQ_6, -frame["open"].rolling(10, min_periods=5).corr(v))
    dv = c * v
    same(g.D_dvol_z20, (dv - dv.rolling(20).mean()) / dv.rolling(20).std())
    same(g.D_drawdown_252, c / c.rolling(252).max() - 1)


def test_ranks_and_runs_against_pandas(spark, frame):
    c, h, v = frame["close"], frame["high"], frame["volume"]
    g = got(spark, frame, ["D_compress_state", "D_hh_run", "D_days_since_boh_20", "D_WQ_35", "D_nr_day", "D_obv"])
    sd, ma = c.rolling(20).std(), c.rolling(20).mean()
    same(g.D_compress_state, (4 * sd / ma).rolling(50, min_periods=10).rank(pct=True))
    up, run = (h > h.shift()).tolist(), []
    for x in up:
        run.append(run[-1] + 1 if x and run else int(x))
    same(g.D_hh_run, run)
    flag, since, last = (h > h.shift().rolling(20).max()).tolist(), [], None
    for i, x in enumerate(flag):
        last = i if x else last
        since.append(0 if last is None else i - last)
    same(g.D_days_since_boh_20, since)
    chl = c + h - frame["low"]
    ret = c.pct_change(fill_method=None)
    same(g.D_WQ_35, v.rolling(32, min_periods=16).rank(pct=True) * (1 - chl.rolling(16, min_periods=8).rank(pct=True)) * (1 - ret.rolling(32, min_periods=16).rank(pct=True)))
    rng = frame["high"] - frame["low"]
    nr = [next((w for w in range(20, 4, -1) if i >= w - 1 and rng[i] < rng[i - w + 1 : i].min()), 0) for i in range(len(rng))]
    same(g.D_nr_day, nr)
    same(g.D_obv, (np.sign(c.diff().fillna(0)) * v).cumsum())


def test_exponential_means_by_hand(spark, frame):
    g = got(spark, frame, ["D_ema20", "D_rsi14", "D_atr14", "D_adx14"])
    y, out = frame["close"][0], []
    for i, x in enumerate(frame["close"]):
        y = x if i == 0 else y + 2 / 21 * (x - y)
        out.append(y if i >= 19 else np.nan)
    same(g.D_ema20, out)
    step = frame["close"].diff()
    up, down = None, None
    rsi = []
    for i, d in enumerate(step):
        if i == 0:
            rsi.append(np.nan)
            continue
        up = max(d, 0) if up is None else up + (max(d, 0) - up) / 14
        down = max(-d, 0) if down is None else down + (max(-d, 0) - down) / 14
        rsi.append(np.nan if i < 14 else 50 if up == down == 0 else 100 if down == 0 else 100 - 100 / (1 + up / down))
    same(g.D_rsi14, rsi)
    assert g.D_atr14.notna().sum() == len(frame) - 13
    assert ((g.D_adx14.dropna() >= 0) & (g.D_adx14.dropna() <= 100)).all()


def test_week_and_month_see_earlier_periods_only(spark, frame):
    g = got(spark, frame, ["W_ret_4w", "D_weekly_trend", "D_monthly_trend", "D_weekly_vpoc"])
    s = frame.assign(week=pd.to_datetime(frame.session).dt.to_period("W-FRI"))
    closes = s.groupby("week").close.last()
    want = s.week.map(((closes / closes.shift(4) - 1) * 100).shift(1))
    same(g.W_ret_4w, want)
    tops = s.groupby("week").high.max().shift(1)
    running = s.groupby("week").high.cummax()
    same(g.D_weekly_trend, np.sign(running - s.week.map(tops)).fillna(0))
    typical = (frame.high + frame.low + frame.close) / 3
    for i in (0, 3, 57, 200):
        rows = [j for j in range(i + 1) if s.week[j] == s.week[i] and not np.isnan(frame.volume[j])]
        p, v = typical[rows].to_numpy(), frame.volume[rows].to_numpy()
        if len(rows) == 0:
            continue
        if np.isclose(p.min(), p.max(), rtol=1e-9):
            same([g.D_weekly_vpoc[i]], [p.min()])
        else:
            k = np.minimum(((p - p.min()) / (p.max() - p.min()) * 50).astype(int), 49)
            best = np.argmax(np.bincount(k, v, 50))
            same([g.D_weekly_vpoc[i]], [p.min() + (best + 0.5) * (p.max() - p.min()) / 50])


def test_unknown_stays_unknown_and_flags_are_zero(spark):
    flat = series("F", 60, 1, flat=1.0)
    flat["volume"] = np.nan
    g = features(bars(spark, [flat]), ["D_vol_surge_20", "D_obv", "D_breakout_high_20", "D_oli", "D_weekly_vpoc"]).toPandas()
    assert g.D_vol_surge_20.isna().all() and g.D_obv.isna().all() and g.D_oli.isna().all() and g.D_weekly_vpoc.isna().all()
    assert set(g.D_breakout_high_20) <= {0, 1}


def test_all_columns_exist_for_tiny_and_empty_input(spark):
    names = feature_names()
    assert len(names) > 165 and len(set(names)) == len(names)
    one = features(bars(spark, [series("T", 1, 1)]))
    assert set(names) <= set(one.columns) and one.count() == 1
    assert features(bars(spark, [series("T", 1, 1)]).limit(0)).count() == 0


def test_later_bars_change_nothing_earlier(spark):
    changed = contract.canary(bars(spark, [series("A", 330, 5), series("B", 330, 6)]), tail=12).toPandas()
    assert len(changed) > 160
    assert changed[changed.changed > 0].empty, changed[changed.changed > 0]


def test_formulas_do_not_look_ahead():
    assert contract.static_leaks() == []
    assert contract.static_leaks({"D_x": "(lead(close, 1) OVER (PARTITION BY symbol ORDER BY session))"}) == ["D_x"]
    assert contract.static_leaks({"D_x": "(close / max(close) OVER (PARTITION BY symbol))"}) == ["D_x"]
    assert contract.is_forward_name("Label_touch") and not contract.is_forward_name("D_rsi14")
    with pytest.raises(ValueError):
        contract.assert_no_forward(["D_rsi14", "ret_5d_close_pct"])


def test_contract_covers_every_feature(spark):
    c = contract.contract(spark)
    contract.assert_complete(c, feature_names())
    rows = {r["column"]: r for r in c.collect()}
    assert rows["D_sma20"].lookback == 19 and rows["D_rsi14"].lookback == -1 and all(r.hypothesis for r in rows.values())
    with pytest.raises(ValueError):
        contract.assert_complete(c, ["D_unheard_of"])


def test_forward_rule_and_kernels():
    from candlewick.operators import recursive
    from candlewick.operators.catalogue import feature_names

    for name in ("close_fwd", "x_lookahead", "ret_1d_close_pct", "ret_3d_close_pct", "D_close_next", "days_ahead", "mfe5"):
        assert contract.is_forward_name(name)
    assert [n for n in feature_names() if contract.is_forward_name(n)] in ([], ["ret_5d_close_pct"])
    assert contract.kernel_leaks(recursive) == []


def test_kernel_leaks_are_found(tmp_path):
    import importlib.util

    bodies = ["x.shift(-1)", "x.diff(periods=-2)", "x.bfill()", "x.rolling(5, center=True).mean()", "x / x.max()", "x[::-1].cumsum()", "x.fillna(method='bfill')"]
    good = ["x.shift(1)", "x.rolling(5).mean()", "x.expanding().rank()", "x.ewm(span=3).mean()"]
    (tmp_path / "kernels.py").write_text("".join(f"def f{i}(x):\n    return {b}\n" for i, b in enumerate(bodies + good)))
    spec = importlib.util.spec_from_file_location("kernels", tmp_path / "kernels.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert contract.kernel_leaks(module) == [f"f{i}" for i in range(len(bodies))]


def test_words_for_true_become_flags_and_unknowns_are_kept(spark):
    from candlewick.operators.features import finalise

    df = spark.createDataFrame([("A", "True", "x", 1.0), ("B", " false ", "true", None), ("C", None, "false", 2.0)], "symbol string, flag string, word string, D_roll double")
    got = finalise(df).orderBy("symbol").collect()
    assert [r.flag for r in got] == [1, 0, 0] and [r.word for r in got] == ["x", "true", "false"] and [r.symbol for r in got] == ["A", "B", "C"]
    contract.assert_unknowns_kept(df, df)
    with pytest.raises(ValueError):
        contract.assert_unknowns_kept(df, df.na.fill(0.0))
