"""Queries of models, audits, contracts and streams: most have no SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators import audit, calendar, contract, gate, labels, models, panel, recursive, report
from candlewick.operators.catalogue import feature_names
from candlewick.operators.features import features
from candlewick.plans.feature_queries import BARS_SQL, rounded
from candlewick.plans.panel_queries import _PRIMARY_SQL, _scored
from candlewick.sources.bars import lineitem_bars, table
from candlewick.sources.stage import shared_dir, staged
from candlewick.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_FEATURES = ("D_ret_1d_pct", "D_rsi14", "D_donch_pos_20", "D_dvol_z20")


def _small_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = lineitem_bars(spark, sf_dir)
    frame = features(bars, list(_FEATURES), keep=("symbol", "session"))
    return frame.join(labels.labels(bars).select("symbol", "session", "label_tp_before_sl"), ["symbol", "session"])


def _folds(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Every fold of the walk-forward, with the operator's defaults."""
    rows = staged(_small_panel(spark, sf_dir))
    predicted = staged(models.tournament(rows, [models.Experiment(family, family, _FEATURES, "label_tp_before_sl")]))
    return rounded(models.fold_metrics(predicted), keep=("experiment", "fold", "n", "clears"))


@query("model_logistic_fold")
def model_logistic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir, "logistic")


@query("model_boosted_fold")
def model_boosted_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir, "boosted")


@query("isotonic_calibration")
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the four folds, calibrated on the one before it."""
    rows = staged(_scored(spark, sf_dir).select("symbol", "session", "y", F.col("p_cal").alias("raw_score"), "fold"))
    every = [models.calibrate(rows.filter(f"fold = {(k + 3) % 4}"), rows.filter(f"fold = {k}")) for k in range(4)]
    return rounded(reduce(DataFrame.unionByName, every))


_PROBES = "close_fwd x_lookahead ret_1d_close_pct ret_3d_close_pct D_close_next days_ahead mfe5 Target_up future_close FWD_ret close forward next_ ahead".split()
_NAMES = [*feature_names(), *labels.label_names(), *_PROBES]


@query("forward_names", f"""SELECT name, contains(l, '_fwd') OR contains(l, 'fwd_') OR contains(l, 'future_') OR contains(l, '_ahead') OR contains(l, 'lookahead') OR contains(l, 'mfe') OR contains(l, 'mae') OR
  contains(l, 'target_') OR contains(l, 'label_') OR contains(l, '_next') OR contains(l, 'ret_1d_close_pct') OR contains(l, 'ret_3d_close_pct') OR contains(l, 'ret_5d_close_pct') AS is_forward
FROM (SELECT name, lower(name) AS l FROM (VALUES {", ".join(f"('{n}')" for n in _NAMES)}) t(name))""")  # fmt: skip
def forward_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", contract.forward_name("name").alias("is_forward"))


@query("feature_contract")
def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.contract(spark)


@query("leak_canary", "SELECT * FROM (VALUES ('D_sma20'), ('D_rsi14'), ('D_donch_pos_20'), ('D_weekly_trend'), ('D_compress_state'), ('D_WQ_29'), ('W_ret_4w')) t(\"column\") CROSS JOIN (SELECT 0 AS changed)")
def leak_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.canary(lineitem_bars(spark, sf_dir), ["D_sma20", "D_rsi14", "D_donch_pos_20", "D_weekly_trend", "D_compress_state", "D_WQ_29", "W_ret_4w"])


@query("null_census", f"WITH {_PRIMARY_SQL} SELECT 'label_first_touch' AS \"column\", count(*) - count(label_first_touch) AS nulls FROM primary_labels UNION ALL SELECT 'label_days_to_tp', count(*) - count(label_days_to_tp) FROM primary_labels")
def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.null_census(labels.labels(lineitem_bars(spark, sf_dir)), ["label_first_touch", "label_days_to_tp"])


@query("label_audit", "SELECT CAST(NULL AS BIGINT) AS symbol, CAST(NULL AS DATE) AS session, CAST(NULL AS DOUBLE) AS stored, CAST(NULL AS DOUBLE) AS recomputed WHERE false")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = lineitem_bars(spark, sf_dir)
    return audit.mismatches(labels.labels(bars), bars)


@query("label_invariants", """SELECT * FROM (VALUES ('tp_before_sl is first_touch > 0'), ('days to tp are known exactly where tp is touched'), ('an ambiguous session counts as a stop'),
  ('neither barrier means the return is inside both'), ('the best is not below the worst'), ('the end is between the worst and the best')) t("check") CROSS JOIN (SELECT 0 AS violations)""")  # fmt: skip
def label_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.invariants(labels.labels(lineitem_bars(spark, sf_dir)))


@query("pending_tail", f"WITH {BARS_SQL} SELECT symbol, least(count(*), 5) AS pending FROM bars GROUP BY 1")
def pending_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pending_tail(labels.labels(lineitem_bars(spark, sf_dir)))


@query("audit_sample", f"""WITH {BARS_SQL}, s AS (SELECT symbol, count(*) AS k FROM bars GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY k, symbol) AS low, row_number() OVER (ORDER BY k DESC, symbol) AS high FROM s),
h AS (SELECT symbol, row_number() OVER (ORDER BY md5('42:' || CAST(symbol AS VARCHAR)), symbol) AS place FROM r WHERE low > 5 AND high > 5)
SELECT symbol, 'smallest' AS why FROM r WHERE low <= 5 UNION ALL SELECT symbol, 'largest' FROM r WHERE high <= 5 UNION ALL SELECT symbol, 'random' FROM h WHERE place <= 10""")  # fmt: skip
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sample_symbols(lineitem_bars(spark, sf_dir))


@query("daily_report")
def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = lineitem_bars(spark, sf_dir)
    bars = staged(bars)
    days = staged(bars.select("session").distinct())
    gated = gate.gate(bars, days, calendar.classify(bars, days, 0.85))
    return report.collect(spark, gated, panel.panel_meta(labels.labels(bars)), contract.static_leaks() + contract.kernel_leaks(recursive))


@query(
    "stream_bars",
    """SELECT symbol, start, open, high, low, close, volume FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS start, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, CAST(count(value) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)""",
)
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a streaming query, complete mode: every hour's bar after the last batch."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq")
    )
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw.write.parquet(f"{base}/trades")
    bars = ingest.stream_bars(spark.readStream.schema(raw.schema).parquet(f"{base}/trades"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/bars-{number}")  # complete mode: all bars so far

    q = bars.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{base}/bars-{q.lastProgress['batchId']}").withColumn("start", F.col("start").cast("timestamp_ntz"))
