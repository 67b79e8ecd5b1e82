"""Labels, panel, folds and metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.config import PanelConfig
from candlewick.operators import audit, labels, metrics, panel, splits
from candlewick.sources import files
from tests.make import bars, day, series

FEW = ("D_ret_1d_pct", "D_dvol_z20")


def config(floor=0.0, least=2):
    return PanelConfig(liquidity_floor=floor, min_universe=least, features=FEW, cross_sectional=FEW)


@pytest.fixture(scope="module")
def universe(spark):
    return bars(spark, [series(f"S{i}", 460, i) for i in range(5)] + [series("LATE", 390, 99, start="2020-04-09")]).cache()


def test_labels_by_hand(spark):
    one = series("A", 60, 2)
    got = labels.labels(bars(spark, [one])).toPandas().sort_values("session", ignore_index=True)
    assert got.tail(5).filter(like="label_").isna().all().all()
    c, h, l = one.close, one.high, one.low
    for i in (0, 20, 54):
        up, down = h[i + 1 : i + 6].to_numpy() / c[i] - 1, l[i + 1 : i + 6].to_numpy() / c[i] - 1
        assert got.label_mfe_5d[i] == pytest.approx(up.max(), abs=1e-12)
        assert got.label_mae_5d[i] == pytest.approx(down.min(), abs=1e-12)
        tp = next((k for k in range(5) if up[k] >= 0.03), 9)
        sl = next((k for k in range(5) if down[k] <= -0.02), 9)
        assert got.label_tp_before_sl_3p2[i] == float(tp < sl)
        want = 0.03 if tp < sl else -0.02 if sl < 9 else c[i + 5] / c[i] - 1
        assert got.label_exit_ret_3p2[i] == pytest.approx(want)


def test_labels_are_the_same_when_computed_another_way(universe):
    got = labels.labels(universe)
    assert audit.mismatches(got, universe).count() == 0
    assert {r.violations for r in audit.invariants(got).collect()} == {0}
    assert {r.pending for r in audit.pending_tail(got).collect()} == {5}


def test_a_missing_price_on_the_path_makes_the_label_unknown(spark):
    one = series("A", 40, 2)
    one.loc[20, "high"] = np.nan
    got = labels.labels(bars(spark, [one])).toPandas().sort_values("session", ignore_index=True)
    assert got.label_tp_before_sl_5p3[15:20].isna().all() and got.label_tp_before_sl_5p3[:15].notna().all()


def test_panel_is_causal_and_complete(universe):
    built = panel.build(universe, config()).toPandas()
    ranks = built[[f"X_rank_{c}" for c in FEW]]
    assert ((ranks.dropna() > 0) & (ranks.dropna() <= 1)).all().all()
    day_ = built[built.session == built.session.max()]
    want = day_.D_ret_1d_pct.rank(pct=True)
    np.testing.assert_allclose(day_.X_rank_D_ret_1d_pct, want)
    z = ((day_.D_ret_1d_pct - day_.D_ret_1d_pct.mean()) / day_.D_ret_1d_pct.std()).clip(-5, 5)
    np.testing.assert_allclose(day_.X_z_D_ret_1d_pct, z, rtol=1e-9)
    late = built[built.symbol == "LATE"]
    assert late.session.min() > day("2021-06-01")  # its own warm-up


def test_liquidity_floor_is_point_in_time(spark):
    dying, rising = series("DYING", 520, 1), series("RISING", 520, 2)
    dying["volume"] = np.where(np.arange(520) < 450, 2e6, 1e3)
    rising["volume"] = np.where(np.arange(520) < 450, 1e3, 2e6)
    built = panel.build(bars(spark, [dying, rising]), config(floor=5e7, least=1)).toPandas()
    last = {s: g.session.max() for s, g in built.groupby("symbol")}
    assert last["DYING"] < max(dying.session) and last["RISING"] == max(rising.session)
    assert built[built.symbol == "RISING"].session.min() > built[built.symbol == "DYING"].session.min()


def test_incremental_equals_full(spark, universe, tmp_path):
    full = panel.build(universe, config())
    since = sorted(r.session for r in universe.select("session").distinct().collect())[-15]
    old = panel.build(universe.filter(F.col("session") < F.lit(since)), config())
    merged = panel.upsert(old, full, since)
    path = f"{tmp_path}/panel"
    files.write_panel(merged, path)
    again = files.read_panel(spark, path)
    key = ["symbol", "session"]
    stable = [*key, *FEW, "X_rank_D_ret_1d_pct", "X_universe_size"]
    a, b = (x.select(stable).toPandas().sort_values(key, ignore_index=True) for x in (full, again))
    pd.testing.assert_frame_equal(a, b, check_exact=True)
    recent = files.read_panel(spark, path, since=since)
    assert recent.agg(F.min("session")).first()[0] >= since
    files.write_panel(full.filter(F.col("session") >= F.lit(since)), path, dynamic=True)
    assert files.read_panel(spark, path).agg(F.min("session")).first()[0] < since


def test_signature_and_universe_hash(universe):
    h = panel.universe_hash(universe).first()[0]
    assert panel.signature(config(), h) == panel.signature(config(), h) != panel.signature(config(floor=1.0), h)
    assert panel.universe_hash(universe.filter("symbol <> 'S1'")).first()[0] != h


def test_exogenous_never_comes_from_the_same_session(spark):
    days = spark.createDataFrame([(day(f"2024-01-0{d}"),) for d in (1, 2, 3, 4, 5, 8, 9)], "session date")
    crude = spark.createDataFrame([(day("2024-01-02"), 10.0), (day("2024-01-04"), 12.0)], "session date, close double")
    got = panel.align(crude, days, "CRUDE", lag=1).orderBy("session").toPandas()
    assert got.CRUDE_close.tolist()[2:] == [10.0, 10.0, 12.0, 12.0, 12.0] and got.CRUDE_close[:2].isna().all()
    assert got.CRUDE_stale.tolist() == [0, 1, 0, 1, 0, 1, 2]


def test_market_relative(spark, universe):
    market = bars(spark, [series("M", 460, 77)])
    got = panel.build(universe, config(), market=market).toPandas()
    assert np.allclose(got.X_excess_ret_1d.dropna(), (got.D_ret_1d_pct - got.MKT_D_ret_1d_pct).dropna())
    assert "label_touch" not in panel.panel_columns(spark.createDataFrame(got.head(1)[["symbol", "D_ret_1d_pct", "label_touch"]]))


def test_folds(universe):
    f = splits.walk_forward(universe).toPandas()
    assert len(f) == 5 and (f.train_end < f.test_start).all()
    with pytest.raises(ValueError):
        splits.walk_forward(universe, embargo=4)
    with pytest.raises(ValueError):
        splits.walk_forward(universe.limit(20))
    idx = {r.session: r.idx for r in splits.session_index(universe).collect()}
    assert all(idx[a] - idx[b] > 5 for a, b in zip(f.test_start, f.train_end, strict=True))
    splits.verify(splits.walk_forward(universe), universe)
    inner = splits.inner_split(universe, splits.walk_forward(universe)).toPandas()
    assert all(idx[c] - idx[a] == 5 for c, a in zip(inner.cal_start, inner.fit_end, strict=True))


def test_metrics_by_hand(spark):
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"symbol": np.arange(200), "session": [day(f"2024-01-{1 + i % 10:02d}") for i in range(200)], "score": rng.integers(0, 20, 200) / 20, "y": rng.integers(0, 2, 200)})
    rows = spark.createDataFrame(df)
    pos, neg = df[df.y == 1].score.to_numpy(), df[df.y == 0].score.to_numpy()
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert metrics.auc(rows, []).first().auc == pytest.approx(want)
    assert metrics.auc(rows.filter("y = 1"), []).first().auc is None
    top = {r.top_n: r for r in metrics.top_n(rows).collect()}
    best = df.sort_values(["session", "score", "symbol"], ascending=[True, False, True]).groupby("session").head(3)
    assert top[3].realised == pytest.approx(best.y.mean()) and top[3].signals == len(best)
    ic = metrics.session_ic(rows).toPandas().set_index("session").ic
    g = df[df.session == day("2024-01-03")]
    assert ic[day("2024-01-03")] == pytest.approx(g.score.rank().corr(g.y.rank()))
    p = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5)], "y int, p_cal double")
    got = metrics.losses(p, []).first()
    assert got.brier == pytest.approx((1e-12 + 1e-12 + 0.25) / 3) and got.logloss == pytest.approx(-(2 * np.log(1 - 1e-6) + np.log(0.5)) / 3)


def test_panel_contract_is_checked(spark, universe):
    ok = universe.select("symbol", "session", F.col("close").alias("f"), F.lit(1).alias("t"))
    files.check_panel(ok, ["f"], ["t"])
    for bad, features_, targets in ((ok.union(ok), ["f"], ["t"]), (ok, ["g"], ["t"]), (ok.withColumn("t", F.lit(2)), ["f"], ["t"]), (ok.withColumn("f", F.lit("x")), ["f"], ["t"])):
        with pytest.raises(ValueError):
            files.check_panel(bad, features_, targets)


def test_refresh_is_incremental_until_something_changes(spark, universe, tmp_path):
    path = f"{tmp_path}/refreshed"
    cut = sorted(r.session for r in universe.select("session").distinct().collect())[-10]
    assert panel.refresh(universe.filter(F.col("session") < F.lit(cut)), path, config()) == "full"
    assert panel.refresh(universe, path, config()) == "incremental"
    want = panel.build(universe, config())
    key = ["symbol", "session"]
    a, b = (x.select(*key, *FEW, "X_rank_D_ret_1d_pct", "label_tp_before_sl").toPandas().sort_values(key, ignore_index=True) for x in (want, files.read_panel(spark, path)))
    pd.testing.assert_frame_equal(a, b, check_exact=True)
    assert panel.refresh(universe, path, config(floor=1.0)) == "full"
    assert panel.refresh(universe.filter("symbol <> 'S1'"), path, config(floor=1.0)) == "full"
    assert files.read_panel(spark, path).filter("symbol = 'S1'").count() == 0


def test_small_file_helpers(spark, tmp_path):
    assert files.read_json(spark, f"{tmp_path}/none") is None
    files.write_json(spark, {"a": 1}, f"{tmp_path}/one")
    assert files.read_json(spark, f"{tmp_path}/one") == {"a": 1}
    start, end, notes = files.normalise_range(day("2024-03-01"), day("2024-01-01"), day("2024-02-01"))
    assert (start, end, len(notes)) == (day("2024-01-01"), day("2024-02-01"), 2)
    (tmp_path / "x").write_text("abc")
    assert files.file_sha256(spark, f"{tmp_path}/x").first().sha256.startswith("ba7816bf")


def test_outcome_percentiles_are_exact_and_held_by_no_single_task(spark):
    rng = np.random.default_rng(4)
    points = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
    for values in ([], [0.5], [0.1, 0.2], [0.05] * 700 + [-0.03] * 301, list(rng.normal(size=5_003)) + [0.25] * 3_000):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)] * 3, "label_exit_ret double").repartition(7)
        got = labels.outcome_percentiles(df, points)
        assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
        got = {r.point: r.value for r in got.collect()}
        assert set(got) == set(points)
        for p in points:
            assert got[p] is None if not values else got[p] == pytest.approx(np.quantile(values, p), abs=1e-12), (len(values), p)
