"""Calendars, absences, gates, repairs and text inputs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import calendar, gate, repair, report
from candlewick.sources import files, text
from tests.make import bars, day, series


def days_of(spark, n=60):
    return spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2020-01-01", periods=n)], "session date")


def holes(frame, gone):
    return frame.drop(index=list(gone)).reset_index(drop=True)


def test_absences_are_classified(spark):
    frames = [series(f"S{i}", 60, i) for i in range(6)]
    frames = [holes(f, {10} | ({20, 21, 22, 23, 24, 25} if i == 0 else {30, 40} if i == 1 else set())) for i, f in enumerate(frames)]
    got = calendar.classify(bars(spark, frames), days_of(spark)).toPandas()
    assert (got["class"] == "market_wide").sum() == 6
    assert set(got[got["class"] == "suspension"].symbol) == {"S0"} and (got["class"] == "suspension").sum() == 6
    assert (got["class"] == "isolated").sum() == 2 and set(got[got["class"] == "isolated"].symbol) == {"S1"}
    runs = calendar.date_runs(calendar.missing(bars(spark, frames), days_of(spark)))
    assert {(r.symbol, r.n) for r in runs.collect() if r.symbol == "S0"} == {("S0", 1), ("S0", 6)}
    summary = {r.symbol: r for r in calendar.gap_summary(runs, shown=1).collect()}
    assert summary["S1"].summary.endswith("+2 more")


def test_bars_off_the_calendar_bound_a_span_only(spark):
    one = series("A", 10, 1)
    days = days_of(spark, 10).filter(~F.col("session").isin(one.session[0], one.session[9], one.session[5]))
    got = calendar.missing(bars(spark, [holes(one, {3})]), days).collect()
    assert [r.session for r in got] == [one.session[3]]


def test_consensus_counts_the_living(spark):
    frames = [series(f"S{i}", 60, i) for i in range(10)] + [series("NEW", 10, 99, start="2020-03-10")]
    frames[0] = holes(frames[0], range(1, 59))
    got = calendar.consensus(bars(spark, frames)).toPandas().sort_values("session", ignore_index=True)
    assert len(got) == 60 and got.live.iloc[0] == 10 and got.live.iloc[55] == 11 and got.present.iloc[5] == 9
    assert calendar.consensus(bars(spark, frames[:9])).count() == 0
    best, about = calendar.build_calendar(bars(spark, frames), authoritative=days_of(spark))
    assert about["source"] == "consensus" and about["trusted"] and about["disagreements"] == {"consensus/authoritative": 0} and best.count() == 60
    _, alone = calendar.build_calendar(bars(spark, frames[:3]), reference=days_of(spark))
    assert alone["source"] == "reference" and not alone["trusted"] and alone["notes"]


def test_gate(spark):
    good, gappy, stale, broken = (series(x, 60, i) for i, x in enumerate(("GOOD", "GAPPY", "STALE", "BROKEN")))
    gappy, stale = holes(gappy, {5, 15, 25, 35}), stale.head(50)
    broken.loc[3, "close"], broken.loc[4, "low"], broken.loc[5, "volume"] = -1.0, 1e9, -5.0
    b, d = bars(spark, [good, gappy, stale, broken]), days_of(spark)
    got = {r.symbol: r for r in gate.gate(b, d, calendar.classify(b, d)).collect()}
    assert got["GOOD"].status == "PASS_UNVERIFIED" and got["GOOD"].reasons == []
    assert not got["GAPPY"].complete and got["GAPPY"].valid and "4 sessions missing" in got["GAPPY"].reasons[0]
    assert "10 sessions behind" in got["STALE"].reasons[0]
    assert not got["BROKEN"].valid and len(got["BROKEN"].reasons) >= 3
    assert not gate.complete(b, d, trusted=False).filter("complete").count()
    with pytest.raises(ValueError):
        gate.assert_ready(gate.gate(b, d))
    assert [r.symbol for r in gate.assert_ready(gate.gate(b, d), allow_partial=True).collect()] == ["GOOD"]
    meta = spark.createDataFrame([("GOOD", 60, "v2"), ("GAPPY", 60, "v2"), ("STALE", 50, "v1")], "symbol string, rows long, schema_version string")
    v = {r.symbol: r.verified for r in gate.verified(b, meta, "v2").collect()}
    assert v == {"GOOD": True, "GAPPY": False, "STALE": False, "BROKEN": False}
    c = {r.symbol: r.consistent for r in gate.consistent(b.union(b.filter("symbol = 'STALE'"))).collect()}
    assert c["GOOD"] and not c["STALE"]
    rows = report.collect(spark, gate.gate(b, d), spark.createDataFrame([(1, 1, "a", "b", 1, 0)], "rows int, symbols int, first_session string, last_session string, labels_resolved int, labels_pending int"), [])
    assert report.overall(rows) == "FAIL" and "<table>" in report.to_html(rows)


def test_splits_are_told_from_moves(spark):
    split, crash, spike = (series(x, 40, 7, flat=0) for x in ("SPLIT", "CRASH", "SPIKE"))
    for c in ("open", "high", "low", "close"):
        split.loc[20:, c] /= 5
        crash.loc[20:, c] *= 0.53  # near no common ratio
        spike.loc[20, c] /= 5  # one bar only
    split.loc[20, "volume"] = split.volume[19] * 5
    got = repair.discontinuities(bars(spark, [split, crash, spike])).toPandas()
    # a bar that stands alone is no split; the way back from it lasts, and is reported
    assert set(zip(got.symbol, got.session, strict=True)) == {("SPLIT", split.session[20]), ("SPIKE", spike.session[21])}
    sure = got[got.symbol == "SPLIT"].iloc[0]
    assert sure.nearest_split == 5 and sure.confidence == "high"


def test_splits_right_at_the_tolerance_are_those_of_the_sql(spark, tmp_path):
    """Prices up by 2.08, 1.92, 2.6 and 1.44: the reciprocal of the ratio is a step off and falls on the other side."""
    import duckdb

    from candlewick.plans import quality_queries

    rows, order = [], 0
    for symbol, (times, k) in enumerate((t, k) for t in (208, 192, 260, 144) for k in range(1, 41)):
        for d, cents in enumerate([100 * k] * 3 + [times * k] * 8):
            rows.append((order, 1, symbol, 1, 1.0, cents / 100, pd.Timestamp("2020-01-01") + pd.Timedelta(days=d)))
            order += 1
    # prices that no split explains, as both are below zero
    rows += [(order + d, 1, 900, 1, 1.0, price, pd.Timestamp("2020-01-01") + pd.Timedelta(days=d)) for d, price in enumerate([-1.0] * 3 + [-2.0] * 8)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(quality_queries.ORACLE_SQL["split_detect"]).fetchall()
    got = quality_queries.split_detect(spark, str(tmp_path))
    assert 0 < len(want) < 161 and sorted(map(tuple, got.collect())) == sorted(want)


def test_orphans_and_rolls(spark):
    old, new = series("A", 3, 1, start="2010-01-01"), series("A", 260, 2, start="2015-01-01")
    b = bars(spark, [old, new, series("B", 3, 3, start="2010-01-01"), series("B", 20, 4, start="2015-01-01")])
    kept = repair.trim_orphans(b).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in kept} == {"A": 260, "B": 23}
    one = series("F", 30, 1)
    e = spark.createDataFrame([(one.session[9],), (one.session[19],), (day("2020-01-19"),)], "expiry date")
    got = repair.roll_marks(bars(spark, [one]), e).orderBy("session").toPandas()
    rolls = [i for i, x in enumerate(got.D_roll) if x == 1]
    assert got.D_roll[:9].isna().all() and rolls[0] == 10 and 20 in rolls and got.D_roll[9] == 0


def test_merging_and_plans(spark):
    a = bars(spark, [series("A", 30, 1), series("B", 30, 2)])
    fixed = a.filter("symbol = 'A'").limit(3).withColumn("close", F.lit(1.0))
    merged = repair.merge_tail(a, fixed)
    assert merged.count() == 60 and merged.filter("close = 1").count() == 3
    assert repair.same_bars(a, a.repartition(3)) and not repair.same_bars(a, merged)
    wanted = spark.createDataFrame([("A", day("2020-01-01"), day("2020-06-01")), ("B", day("2019-01-01"), day("2020-01-10")), ("C", day("2020-01-01"), day("2020-02-01"))], "symbol string, first date, last date")
    got = {r.symbol: r for r in repair.refetch_plan(a, wanted).collect()}
    assert (got["A"].action, got["B"].action, got["C"].action) == ("tail", "backfill", "full") and got["A"].fetch_from < max(series("A", 30, 1).session)


def test_text_inputs(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Symbol\nABC, abc\tX-EQ\n﻿ZED\nnan;a/b\n")
    got = [r.symbol for r in text.read_symbols(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()]
    assert sorted(got) == ["ABC", "X-EQ", "ZED", "a_b"]
    (tmp_path / "h.csv").write_text("2024-01-26\nnot a date\n2024-03-25\n")
    assert text.read_holidays(spark, str(tmp_path / "h.csv")).count() == 2
    assert calendar.business_days(spark, "2024-01-22", "2024-01-28", text.read_holidays(spark, str(tmp_path / "h.csv"))).count() == 4
    s = spark.createDataFrame([(x,) for x in ("RELIANCE", "INFOSYS", "ZZZ")], "symbol string")
    i = spark.createDataFrame([("RELIANCE-EQ", 1), ("INFOSYSX", 2)], "tradingsymbol string, token long")
    assert {r.symbol: r.token for r in text.resolve(s, i).collect()} == {"RELIANCE": 1, "INFOSYS": None, "ZZZ": None}
    near = text.suggestions(s, i).collect()
    assert ("INFOSYS", "INFOSYSX") in {(r.symbol, r.suggestion) for r in near}


def test_series_files(spark, tmp_path):
    for name, n in (("ABC", 5), ("DEF", 7)):
        f = series(name, n, 1)
        pd.DataFrame({"timestamp": pd.to_datetime(f.session), **{c: f[c] for c in ("open", "high", "low", "close", "volume")}}).astype({"volume": "float64"}).assign(
            volume=lambda d: np.where(np.arange(len(d)) == 1, np.inf, d.volume)
        ).to_parquet(tmp_path / f"{name}_daily.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        (tmp_path / f"{name}_daily.ok.json").write_text(json.dumps({"rows": n, "schema_version": "v2", "series_kind": "equity"}, indent=1))
    got = files.read_series(spark, str(tmp_path))
    assert {r.symbol: r["count"] for r in got.groupBy("symbol").count().collect()} == {"ABC": 5, "DEF": 7}
    assert got.filter("volume IS NULL").count() == 2
    meta = files.read_sidecars(spark, str(tmp_path))
    assert {r.symbol: r.verified for r in gate.verified(got, meta, "v2").collect()} == {"ABC": True, "DEF": True}
    assert files.fetch_chunks(spark, "2010-01-01", "2020-12-31").count() == 3
    assert files.json_hash({"b": 1, "a": 2}) == files.json_hash({"a": 2, "b": 1})


def test_suggestions_come_from_all_names(spark):
    import difflib

    wanted = ["INFOSYS", "XRELIANCE", "AB", "ABC", "TATASTEL", "ZZZ"]
    names = ["INFOSYS-EQ", "INFSYS", "RELIANCE", "TATASTEEL", "BA", "ABD", "B", "TATA", "AXBXC"]
    frame = lambda x, c: spark.createDataFrame([(n,) for n in x], f"{c} string")
    got = {(r.symbol, r.suggestion) for r in text.suggestions(frame(wanted, "symbol"), frame(names, "tradingsymbol"), top=99).collect()}
    plain = lambda n: n.removesuffix("-EQ")
    assert got == {(w, n) for w in wanted for n in names if difflib.SequenceMatcher(None, w, plain(n)).ratio() >= 0.77}
    assert ("XRELIANCE", "RELIANCE") in got


def test_symbols_of_the_first_csv_column(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Symbol,Weight\nAAA,1\n\"B B\",2\naaa,3\n")
    assert [r.symbol for r in text.read_symbols(spark, str(tmp_path / "s.csv")).orderBy("pos").collect()] == ["AAA", "B_B"]
