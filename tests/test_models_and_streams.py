"""Models, streams and the driver's entry points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import models
from candlewick.streaming import ingest


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    rows = []
    for d in pd.bdate_range("2020-01-01", periods=110):
        for s in range(12):
            z = rng.normal()
            rows.append((f"S{s:02d}", d.date(), z + rng.normal(0, 0.2) if rng.random() > 0.05 else None, float(rng.normal()), int(z + rng.normal(0, 0.8) > 0)))
    return spark.createDataFrame(rows, "symbol string, session date, f1 double, f2 double, label_tp_before_sl int").cache()


def test_a_tournament_learns_resumes_and_reports(spark, panel, tmp_path):
    experiments = [models.Experiment("base", "logistic", ("f1", "f2"), "label_tp_before_sl"), models.Experiment("noise", "logistic", ("f2",), "label_tp_before_sl")]
    assert models.preflight(panel, experiments[0]) == [] and models.preflight(panel, models.Experiment("x", "logistic", ("g",), "label_tp_before_sl")) == ["missing column g"]
    out = f"{tmp_path}/predictions"
    done = models.tournament(panel, experiments[:1], out, n_splits=3)
    again = models.tournament(panel, experiments, out, n_splits=3, done={("base", f) for f in (1, 2, 3)})
    got = models.fold_metrics(again).toPandas()
    assert len(got[got.experiment == "base"]) == len(got[got.experiment == "noise"]) > 0
    assert got[got.experiment == "base"].auc.min() > 0.7 > got[got.experiment == "noise"].auc.max()
    assert done.filter("p_cal < 0 OR p_cal > 1").count() == 0
    assert experiments[0].signature("a") != experiments[0].signature("b")
    # the stored state resumes a run by itself, and refuses changed settings
    before = {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    models.tournament(panel, experiments, out, n_splits=3)
    assert {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")} == before
    with pytest.raises(ValueError, match="base"):
        models.tournament(panel, [models.Experiment("base", "logistic", ("f1",), "label_tp_before_sl")], out, n_splits=3)


def test_calibration_of_one_class_clips(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, raw_score double")
    rows = spark.createDataFrame([(1, 1.7), (0, -0.3)], "y int, raw_score double")
    assert sorted(r.p_cal for r in models.calibrate(one, rows).collect()) == [0.0, 1.0]


def test_stream_of_corrections_keeps_what_came_last(spark, tmp_path):
    schema = "symbol string, session date, close double"
    source, store, check = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/check"
    for rows in ([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0)], [("A", "2024-01-02", 2.5), ("B", "2024-01-02", 9.0)]):
        spark.createDataFrame(rows, "symbol string, d string, close double").selectExpr("symbol", "DATE(d) AS session", "close").coalesce(1).write.mode("append").parquet(source)
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(source), store, check).awaitTermination()
    assert sorted((r.symbol, str(r.session), r.close) for r in ingest.read_store(spark, store).collect()) == [("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.5), ("B", "2024-01-02", 9.0)]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 120
    assert e.entry(spark).columns == ["symbol", "session", "D_ret_1d_pct", "X_rank", "place"]
    assert e.entry(spark).filter(F.col("place") == 1).count() > 500
