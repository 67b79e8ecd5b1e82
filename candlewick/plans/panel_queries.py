"""Queries of bars, labels, panel, folds and metrics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.config import LABEL_VARIANTS, PRIMARY_VARIANT, PanelConfig
from candlewick.operators import contract, labels, metrics, panel, splits
from candlewick.operators.features import features, finalise, point_of_control
from candlewick.plans.feature_queries import BARS_SQL, duck_round, feature_ctes, rounded
from candlewick.sources.bars import event_bars, lineitem_bars, market_bars, table

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


def near(*names: str) -> str:
    return ", ".join(map(duck_round, names))


BARS = ("open", "high", "low", "close", "volume")


@query("bars_ohlcv", f"WITH {BARS_SQL} SELECT symbol, session, {near(*BARS)} FROM bars")
def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lineitem_bars(spark, sf_dir))


@query(
    "hourly_bars",
    f"""SELECT symbol, session, {near(*BARS)} FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS session, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, ROW(ts, event_id)) AS close, count(value) AS volume FROM events GROUP BY 1, 2)""",
)
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_bars(spark, sf_dir), keep=("symbol", "session"))


@query(
    "weekly_bars",
    f"""WITH {BARS_SQL} SELECT symbol, week_end, {near("close", "high", "low", "volume")} FROM (
  SELECT symbol, CAST(session + CAST((12 - isodow(session)) % 7 AS INTEGER) AS DATE) AS week_end, arg_max(close, session) AS close, max(high) AS high,
    min(low) AS low, sum(volume) AS volume FROM bars GROUP BY 1, 2)""",
)
def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lineitem_bars(spark, sf_dir).withColumn("week_end", F.expr("date_add(session, (11 - weekday(session)) % 7)"))
    out = b.groupBy("symbol", "week_end").agg(F.max_by("close", "session").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return rounded(out, keep=("symbol", "week_end"))


@query(
    "vpoc_month",
    f"""WITH {BARS_SQL}, p AS (SELECT symbol, CAST(date_trunc('month', session) AS DATE) AS month, (high + low + close) / 3 AS p, volume FROM bars),
s AS (SELECT symbol, month, min(p) AS lo, max(p) AS hi FROM p GROUP BY 1, 2),
b AS (SELECT symbol, month, lo, hi, CASE WHEN hi > lo THEN least(floor((p - lo) / (hi - lo) * 50), 49) ELSE 0 END AS b, volume FROM p JOIN s USING (symbol, month)),
v AS (SELECT symbol, month, lo, hi, b, sum(volume) AS v FROM b GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT symbol, month, lo, hi, arg_max(b, ROW(v, -b)) AS b FROM v GROUP BY 1, 2, 3, 4)
SELECT symbol, month, {near("vpoc")} FROM (SELECT symbol, month, CASE WHEN hi - lo <= 1e-9 * greatest(abs(lo), abs(hi)) THEN lo ELSE lo + (b + 0.5) * (hi - lo) / 50 END AS vpoc FROM m)""",
)
def vpoc_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lineitem_bars(spark, sf_dir).withColumn("month", F.trunc("session", "MM"))
    return rounded(point_of_control(b, ["symbol", "month"]), keep=("symbol", "month"))


def _final_sql() -> str:
    names = ["D_inside_day", "D_vol_surge_20", "D_sma5", "D_nr_day"]
    ctes, last = feature_ctes(names)
    return f"WITH {ctes} SELECT symbol, session, {near(*names)} FROM {last}"


@query("finalised", _final_sql())
def finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features(lineitem_bars(spark, sf_dir), ["D_inside_day", "D_vol_surge_20", "D_sma5", "D_nr_day", "D_hh", "D_day_type"], keep=("symbol", "session"))
    return rounded(finalise(frame))


# labels

_PATH_SQL = f"""{BARS_SQL},
p0 AS (SELECT *, lag(close) OVER w AS pc, count(*) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead,
  {", ".join(f"lead(high, {k}) OVER w / close - 1 AS u{k}, lead(low, {k}) OVER w / close - 1 AS d{k}" for k in range(1, 6))}, lead(close, 5) OVER w / close - 1 AS fin
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)),
p1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p0),
path AS (SELECT *, CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w END / nullif(close, 0) AS atr FROM p1
  WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


def _first(column: str, condition: str) -> str:
    return "CASE " + " ".join(f"WHEN {column}{k} {condition} THEN {k}" for k in range(1, 6)) + " ELSE 0 END"


def barrier_sql(name: str) -> str:
    """CTE `v_<name>` with the outcome of a variant, by nested cases over the path."""
    v = next(x for x in LABEL_VARIANTS if x.name == name)
    unit = "atr" if v.atr else "1.0::DOUBLE"
    return f"""l_{name} AS (SELECT *, {v.take_profit}::DOUBLE * {unit} AS tp, {v.stop_loss}::DOUBLE * {unit} AS sl FROM path),
k_{name} AS (SELECT *, {_first("u", ">= tp")} AS ku, {_first("d", "<= -sl")} AS kd, ahead = 5 AND tp IS NOT NULL AS ok FROM l_{name}),
v_{name} AS (SELECT symbol, session, fin, ku, kd, ok, tp, sl, CASE WHEN NOT ok THEN NULL WHEN ku > 0 AND (kd = 0 OR ku < kd) THEN 1.0 WHEN kd > 0 THEN -1.0 ELSE 0.0 END AS first FROM k_{name})"""


def _barrier(name: str) -> None:
    columns = [f"label_{x}_{name}" for x in ("tp_before_sl", "days_to_tp", "same_day_ambiguous", "touch", "exit_ret")]
    sql = f"""WITH {_PATH_SQL}, {barrier_sql(name)}
SELECT symbol, session, {near(*columns)} FROM (SELECT symbol, session, CASE WHEN ok THEN CAST(first > 0 AS INT) END AS label_tp_before_sl_{name},
  CASE WHEN ok AND ku > 0 THEN ku END AS label_days_to_tp_{name}, CASE WHEN ok THEN CAST(ku > 0 AND ku = kd AS INT) END AS label_same_day_ambiguous_{name},
  CASE WHEN ok THEN CAST(ku > 0 AS INT) END AS label_touch_{name}, CASE WHEN ok THEN CASE first WHEN 1 THEN tp WHEN -1 THEN -sl ELSE fin END END AS label_exit_ret_{name} FROM v_{name})"""
    query(f"barrier_{name}", sql)(lambda spark, sf_dir: rounded(labels.labels(lineitem_bars(spark, sf_dir)).select("symbol", "session", *columns)))


for _v in LABEL_VARIANTS:
    _barrier(_v.name)


@query(
    "labels_mfe_mae",
    f"""WITH {_PATH_SQL} SELECT symbol, session, {near("label_mfe_5d", "label_mae_5d", "label_fwd_ret_5d", "label_touch")} FROM (SELECT symbol, session,
  CASE WHEN ahead = 5 THEN greatest(u1, u2, u3, u4, u5) END AS label_mfe_5d, CASE WHEN ahead = 5 THEN least(d1, d2, d3, d4, d5) END AS label_mae_5d,
  CASE WHEN ahead = 5 THEN fin END AS label_fwd_ret_5d, CASE WHEN ahead = 5 THEN CAST(greatest(u1, u2, u3, u4, u5) >= 0.05 AS INT) END AS label_touch FROM path)""",
)
def labels_mfe_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.labels(lineitem_bars(spark, sf_dir)).select("symbol", "session", "label_mfe_5d", "label_mae_5d", "label_fwd_ret_5d", "label_touch"))


_PRIMARY_SQL = f"""{_PATH_SQL}, {barrier_sql(PRIMARY_VARIANT)},
primary_labels AS (SELECT symbol, session, first AS label_first_touch, CASE WHEN ok THEN CAST(first > 0 AS INT) END AS label_tp_before_sl,
  CASE WHEN ok AND ku > 0 THEN ku END AS label_days_to_tp, CASE WHEN ok AND kd > 0 THEN kd END AS label_days_to_sl,
  CASE WHEN ok THEN CAST(ku > 0 AND ku = kd AS INT) END AS label_same_day_ambiguous,
  CASE WHEN ok THEN CASE first WHEN 1 THEN tp WHEN -1 THEN -sl ELSE fin END END AS label_exit_ret FROM v_{PRIMARY_VARIANT})"""
_PRIMARY = ("label_first_touch", "label_tp_before_sl", "label_days_to_tp", "label_days_to_sl", "label_same_day_ambiguous", "label_exit_ret")


@query("label_primary", f"WITH {_PRIMARY_SQL} SELECT symbol, session, {near(*_PRIMARY)} FROM primary_labels")
def label_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.labels(lineitem_bars(spark, sf_dir)).select("symbol", "session", *_PRIMARY))


@query(
    "label_mix",
    f"""WITH {_PRIMARY_SQL} SELECT {near("resolved", "tp_share", "sl_share", "neither_share", "ambiguous_share")} FROM (SELECT count(*) AS resolved,
  avg(CAST(label_first_touch = 1 AS INT)) AS tp_share, avg(CAST(label_first_touch = -1 AS INT)) AS sl_share, avg(CAST(label_first_touch = 0 AS INT)) AS neither_share,
  avg(label_same_day_ambiguous) AS ambiguous_share FROM primary_labels WHERE label_first_touch IS NOT NULL)""",
)
def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.outcome_mix(labels.labels(lineitem_bars(spark, sf_dir))))


@query(
    "outcome_percentiles",
    f"""WITH {_PRIMARY_SQL} SELECT {near("point", "value")} FROM (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS point,
  unnest(quantile_cont(label_exit_ret, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS value FROM primary_labels)""",
)
def outcome_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.outcome_percentiles(labels.labels(lineitem_bars(spark, sf_dir))))


# panel

_TURNOVER_SQL = f"""{BARS_SQL},
turnover AS (SELECT symbol, session, close * volume AS dv, CASE WHEN count(close * volume) OVER w >= 40 THEN quantile_cont(close * volume, 0.5) OVER w END AS med
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
FLOOR = 40_000.0


@query("liquidity_floor", f"WITH {_TURNOVER_SQL} SELECT symbol, session, {duck_round('X_turnover_med')} FROM (SELECT *, med AS X_turnover_med FROM turnover) WHERE med >= {FLOOR}")
def liquidity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features(lineitem_bars(spark, sf_dir), ["D_dollar_vol"], keep=("symbol", "session"))
    return rounded(panel.liquidity_floor(frame, FLOOR).select("symbol", "session", "X_turnover_med"))


_RANKED = ("D_ret_1d_pct", "D_dvol_z20", "D_donch_pos_20", "D_gap_pct")


def _rank_sql(c: str) -> str:
    low = f"rank() OVER (PARTITION BY session ORDER BY {c} ASC NULLS LAST)"
    return f"CASE WHEN {c} IS NOT NULL THEN ({low} + (count(*) OVER (PARTITION BY session, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY session) END AS X_rank_{c}"


def _z_sql(c: str) -> str:
    s = "OVER (PARTITION BY session)"
    return f"CASE WHEN {c} IS NOT NULL AND stddev_samp({c}) {s} > 0 THEN greatest(least(({c} - avg({c}) {s}) / stddev_samp({c}) {s}, 5.0), -5.0) END AS X_z_{c}"


def _cross_sql(made: str, names: list[str]) -> str:
    ctes, last = feature_ctes(list(_RANKED))
    return f"WITH {ctes} SELECT symbol, session, {near(*names)} FROM (SELECT symbol, session, {made} FROM {last})"


@query("cs_rank", _cross_sql(", ".join(map(_rank_sql, _RANKED)), [f"X_rank_{c}" for c in _RANKED]))
def cs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features(lineitem_bars(spark, sf_dir), list(_RANKED), keep=("symbol", "session"))
    return rounded(frame.select("symbol", "session", *(panel.rank_pct(c).alias(f"X_rank_{c}") for c in _RANKED)))


@query("cs_zscore", _cross_sql(", ".join(map(_z_sql, _RANKED)), [f"X_z_{c}" for c in _RANKED]))
def cs_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features(lineitem_bars(spark, sf_dir), list(_RANKED), keep=("symbol", "session"))
    return rounded(frame.select("symbol", "session", *(panel.z_in_session(c).alias(f"X_z_{c}") for c in _RANKED)))


@query("universe_size", f"WITH {BARS_SQL} SELECT session, count(*) AS X_universe_size FROM bars GROUP BY 1 HAVING count(*) >= 20")
def universe_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = panel.cross_section(lineitem_bars(spark, sf_dir).select("symbol", "session"), [])
    return panel.thin_sessions(sized, 20).select("session", "X_universe_size").distinct()


_MARKET_BARS_SQL = """bars AS (
  SELECT CAST(l_shipdate AS DATE) AS session, 0 AS symbol, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS k FROM lineitem) GROUP BY 1)"""


def _market_sql() -> str:
    own, last = feature_ctes(["D_ret_1d_pct", "D_realvol_20"])
    mkt, mlast = feature_ctes([*panel.MARKET, "D_is_warmup"], _MARKET_BARS_SQL)
    names = [*(f"MKT_{c}" for c in panel.MARKET), "X_excess_ret_1d", "X_relvol_20"]
    return f"""SELECT symbol, session, {near(*names)} FROM (SELECT o.symbol, o.session, {", ".join(f"m.{c} AS MKT_{c}" for c in panel.MARKET)},
  o.D_ret_1d_pct - m.D_ret_1d_pct AS X_excess_ret_1d, o.D_realvol_20 / nullif(m.D_realvol_20, 0) AS X_relvol_20
  FROM (WITH {own} SELECT * FROM {last}) o LEFT JOIN (WITH {mkt} SELECT * FROM {mlast} WHERE D_is_warmup = 0) m USING (session))"""


@query("market_relative", _market_sql())
def market_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features(lineitem_bars(spark, sf_dir), ["D_ret_1d_pct", "D_realvol_20"], keep=("symbol", "session"))
    return rounded(panel.market_relative(frame, market_bars(spark, sf_dir)).drop("D_ret_1d_pct", "D_realvol_20"))


_EXO_SQL = """WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem),
series AS (SELECT CAST(o_orderdate AS DATE) AS session, max(o_totalprice) AS v FROM orders GROUP BY 1),
filled AS (SELECT session, last_value(v IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS c, v IS NOT NULL AS f FROM days LEFT JOIN series USING (session)),
lagged AS (SELECT session, lag(c) OVER (ORDER BY session) AS c, CAST(coalesce(lag(f) OVER (ORDER BY session), false) AS INT) AS f FROM filled),
grouped AS (SELECT *, sum(f) OVER (ORDER BY session) AS g FROM lagged)"""


@query(
    "exogenous_asof",
    f"""{_EXO_SQL} SELECT session, {near("orders_close", "orders_stale", "orders_ret_1d")} FROM (SELECT session, c AS orders_close,
  row_number() OVER (PARTITION BY g ORDER BY session) - 1 AS orders_stale, c / nullif(lag(c) OVER (ORDER BY session), 0) - 1 AS orders_ret_1d FROM grouped)""",
)
def exogenous_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("session"), F.col("o_totalprice").alias("close"))
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("session"))
    return rounded(panel.align(series, days, "orders", lag=1), keep=("session",))


def _panel_sql() -> str:
    names = ["D_ret_1d_pct", "D_dvol_z20", "D_donch_pos_20", "D_gap_pct"]
    ctes, last = feature_ctes([*names, "D_dollar_vol", "D_is_warmup"])
    out = [*names, "label_tp_before_sl", "X_turnover_med", *(f"X_rank_{c}" for c in names), "X_universe_size"]
    path = _PRIMARY_SQL.replace(BARS_SQL + ",", "")
    return f"""WITH {ctes}, {path},
long_enough AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 317),
joined AS (SELECT f.*, label_tp_before_sl, CASE WHEN count(D_dollar_vol) OVER w >= 40 THEN quantile_cont(D_dollar_vol, 0.5) OVER w END AS X_turnover_med
  FROM {last} f JOIN long_enough USING (symbol) LEFT JOIN primary_labels USING (symbol, session) WHERE D_is_warmup = 0
  WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, {", ".join(map(_rank_sql, names))}, count(*) OVER (PARTITION BY session) AS X_universe_size FROM joined WHERE X_turnover_med >= {FLOOR})
SELECT symbol, session, {near(*out)} FROM ranked WHERE X_universe_size >= 3"""


@query("panel_build", _panel_sql())
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = PanelConfig(liquidity_floor=FLOOR, min_universe=3, features=_RANKED, cross_sectional=_RANKED)
    built = panel.build(lineitem_bars(spark, sf_dir), config)
    return rounded(built.select("symbol", "session", *_RANKED, "label_tp_before_sl", "X_turnover_med", *(f"X_rank_{c}" for c in _RANKED), "X_universe_size"))


@query("panel_meta", f"""WITH {_PRIMARY_SQL} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT session) AS sessions, min(session) AS first_session,
  max(session) AS last_session, count(label_tp_before_sl) AS labels_resolved, count(*) - count(label_tp_before_sl) AS labels_pending,
  floor(avg(label_tp_before_sl) * 1e6 + 0.4837) / 1e6 AS label_positive_rate FROM primary_labels""")  # fmt: skip
def panel_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = panel.panel_meta(labels.labels(lineitem_bars(spark, sf_dir)))
    return rounded(meta, keep=tuple(c for c in meta.columns if c != "label_positive_rate"))


@query("warmup_drop", f"""WITH {BARS_SQL} SELECT symbol, session FROM (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n <= 312 OR rn > 312""")  # fmt: skip
def warmup_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.drop_warmup(features(lineitem_bars(spark, sf_dir), ["D_is_warmup"], keep=("symbol", "session")))


@query("min_history", f"WITH {BARS_SQL} SELECT symbol, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 317")
def min_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.min_history(lineitem_bars(spark, sf_dir).select("symbol", "session")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("universe_semi", f"""WITH {BARS_SQL} SELECT symbol, session FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def universe_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    return lineitem_bars(spark, sf_dir).select("symbol", "session").join(allowed, "symbol", "left_semi")


@query("universe_hash", "SELECT substr(sha256(string_agg(s, '|' ORDER BY s)), 1, 16) AS universe_hash FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS s FROM lineitem)")
def universe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.universe_hash(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol")).distinct())


@query("upsert_panel", f"""WITH {BARS_SQL} SELECT symbol, session, {near("close")} FROM (
  SELECT symbol, session, close FROM bars WHERE session < DATE '2000-01-01' AND symbol % 2 = 0 UNION ALL SELECT symbol, session, close * 2 FROM bars WHERE session >= DATE '2000-01-01')""")  # fmt: skip
def upsert_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    stored = lineitem_bars(spark, sf_dir).select("symbol", "session", "close")
    fresh = stored.withColumn("close", F.col("close") * 2)
    allowed = stored.select("symbol").filter("symbol % 2 = 0")
    return rounded(panel.upsert(stored, fresh, datetime.date(2000, 1, 1), allowed))


@query("prevalence", """WITH v AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_quantity']) AS "column",
    unnest([l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR)]) AS value FROM lineitem),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT "column", CAST(sum(n) AS BIGINT) AS n_rows, count(value) AS n_unique, arg_max(value, ROW(n, value)) FILTER (WHERE value IS NOT NULL) AS modal_value,
  floor(max(n) * 1.0 / sum(n) * 1e6 + 0.4837) / 1e6 AS modal_share, 0.0 AS null_share FROM c GROUP BY 1""")  # fmt: skip
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("l_quantity"))
    return rounded(contract.prevalence(rows, rows.columns), keep=("column", "n_rows", "n_unique", "modal_value"))


# folds

_DAYS_SQL = "days AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx, ntile(6) OVER (ORDER BY session) AS part FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem))"
_FOLDS_SQL = f"""{_DAYS_SQL},
parts AS (SELECT part, min(session) AS a, max(session) AS b, max(idx) AS i FROM days GROUP BY 1),
folds AS (SELECT CAST(t.part - 1 AS INTEGER) AS fold, (SELECT min(session) FROM days) AS train_start, d.session AS train_end, 5 AS embargo_sessions, t.a AS test_start, t.b AS test_end
  FROM parts t JOIN parts p ON p.part = t.part - 1 JOIN days d ON d.idx = greatest(0, p.i - 5))"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("session"), F.col("l_suppkey").alias("symbol"))


@query("walk_forward", f"WITH {_FOLDS_SQL} SELECT * FROM folds")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.walk_forward(_sessions(spark, sf_dir))


@query("inner_split", f"""WITH {_FOLDS_SQL},
n AS (SELECT fold, count(*) AS sessions, min(idx) AS base FROM folds JOIN days ON session BETWEEN train_start AND train_end GROUP BY 1),
c AS (SELECT *, CAST(greatest(1, least(floor(sessions * 0.75), sessions - 6)) AS BIGINT) AS cut FROM n WHERE sessions >= 40)
SELECT fold, sessions, f.session AS fit_end, k.session AS cal_start FROM c JOIN days f ON f.idx = base + cut - 1 JOIN days k ON k.idx = base + cut + 4""")  # fmt: skip
def inner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir)
    return splits.inner_split(rows, splits.walk_forward(rows))


@query("fold_join", f"""WITH {_FOLDS_SQL} SELECT fold, part_name AS part, count(*) AS n FROM (SELECT fold,
  CASE WHEN s BETWEEN test_start AND test_end THEN 'test' WHEN s BETWEEN train_start AND train_end THEN 'train' END AS part_name
  FROM (SELECT CAST(l_shipdate AS DATE) AS s FROM lineitem) JOIN folds ON s BETWEEN train_start AND test_end) WHERE part_name IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def fold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir)
    return splits.assign(rows, splits.walk_forward(rows)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("dense_groups", "SELECT session, CAST(dense_rank() OVER (ORDER BY session) - 1 AS INTEGER) AS qid, n FROM (SELECT CAST(l_shipdate AS DATE) AS session, count(*) AS n FROM lineitem GROUP BY 1)")
def dense_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.dense_groups(_sessions(spark, sf_dir)).groupBy("session", "qid").agg(F.count(F.lit(1)).alias("n"))


# metrics: whether the next close is higher, scored by volume

_SCORED_SQL = f"""{BARS_SQL},
scored AS (SELECT symbol, session, volume AS score, volume / (volume + 30.0) AS p_cal, nxt > close AS up, CAST(nxt > close AS INT) AS y, symbol % 4 AS fold
  FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY session) AS nxt FROM bars) WHERE nxt IS NOT NULL)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("session")
    b = lineitem_bars(spark, sf_dir).withColumn("nxt", F.lead("close").over(w)).filter("nxt IS NOT NULL")
    return b.select(
        "symbol", "session", F.col("volume").alias("score"), (F.col("volume") / (F.col("volume") + 30)).alias("p_cal"), (F.col("nxt") > F.col("close")).cast("int").alias("y"),
        (F.col("symbol") % 4).alias("fold"),
    )


_AUC_SQL = """r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM scored),
a AS (SELECT fold, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY 1)"""


@query("auc", f"WITH {_SCORED_SQL}, {_AUC_SQL} SELECT fold, {near('auc')} FROM a")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_scored(spark, sf_dir), ["fold"]), keep=("fold",))


@query("brier_logloss", f"""WITH {_SCORED_SQL} SELECT fold, n, {near("base_rate", "mean_score", "brier", "logloss")} FROM (SELECT fold, count(*) AS n, avg(y) AS base_rate,
  avg(p_cal) AS mean_score, avg((y - q) * (y - q)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS logloss
  FROM (SELECT *, greatest(least(p_cal, 1 - 1e-6), 1e-6) AS q FROM scored) GROUP BY 1)""")  # fmt: skip
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.losses(_scored(spark, sf_dir), ["fold"]), keep=("fold", "n"))


@query("topn_daily", f"""WITH {_SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS rk FROM scored),
t AS (SELECT top_n, count(*) AS signals, avg(y) AS realised FROM ranked JOIN (SELECT unnest([1, 3, 5, 10]) AS top_n) ON rk <= top_n GROUP BY 1),
s AS (SELECT *, 2 * sqrt(realised * (1 - realised) / signals) AS se2 FROM t)
SELECT top_n, signals, {near("realised", "se2", "lower_2se")}, clears FROM (SELECT *, realised - se2 AS lower_2se, realised - se2 > 0.5 AS clears FROM s)""")  # fmt: skip
def topn_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.top_n(_scored(spark, sf_dir)), keep=("top_n", "signals", "clears"))


_IC_SQL = """i AS (SELECT session, score, y, rank() OVER (PARTITION BY session ORDER BY score) + (count(*) OVER (PARTITION BY session, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY session ORDER BY y) + (count(*) OVER (PARTITION BY session, y) - 1) / 2.0 AS b FROM scored),
ic AS (SELECT session, CASE WHEN min(a) < max(a) THEN corr(a, b) END AS ic FROM i GROUP BY 1 HAVING count(*) >= 3 AND min(y) < max(y))"""


@query("daily_ic", f"WITH {_SCORED_SQL}, {_IC_SQL} SELECT session, {near('ic')} FROM ic")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.session_ic(_scored(spark, sf_dir)), keep=("session",))


@query("ic_summary", f"WITH {_SCORED_SQL}, {_IC_SQL} SELECT count(ic) AS sessions, {near('mean_daily_spearman', 'median_daily_spearman')} FROM (SELECT ic, avg(ic) OVER () AS mean_daily_spearman, quantile_cont(ic, 0.5) OVER () AS median_daily_spearman FROM ic) GROUP BY mean_daily_spearman, median_daily_spearman")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ic_summary(metrics.session_ic(_scored(spark, sf_dir))), keep=("sessions",))


@query("experiment_summary", f"""WITH {_SCORED_SQL}, {_AUC_SQL} SELECT experiment, count(*) AS folds, floor(avg(auc) * 1e6 + 0.4837) / 1e6 AS mean,
  floor(quantile_cont(auc, 0.5) * 1e6 + 0.4837) / 1e6 AS median, floor(min(auc) * 1e6 + 0.4837) / 1e6 AS worst, bool_and(auc > 0.5) AS all_clear
  FROM (SELECT fold % 2 AS experiment, auc FROM a) GROUP BY 1""")  # fmt: skip
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = metrics.auc(_scored(spark, sf_dir), ["fold"]).select((F.col("fold") % 2).alias("experiment"), "auc", (F.col("auc") > 0.5).alias("clears"))
    return rounded(metrics.experiment_summary(folds), keep=("experiment", "folds", "all_clear"))


@query("momentum_top5", f"""WITH {feature_ctes(["D_sma20", "D_ret_1d_pct"])[0]} SELECT symbol, session, {near("D_ret_1d_pct", "X_rank")}, place FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY D_ret_1d_pct DESC, symbol) AS place FROM (
    SELECT symbol, session, D_ret_1d_pct, (rank() OVER (PARTITION BY session ORDER BY D_ret_1d_pct ASC NULLS LAST) + (count(*) OVER (PARTITION BY session, D_ret_1d_pct) - 1) / 2.0)
      / count(D_ret_1d_pct) OVER (PARTITION BY session) AS X_rank, close > D_sma20 AS above FROM {feature_ctes(["D_sma20", "D_ret_1d_pct"])[1]}) WHERE above AND D_ret_1d_pct IS NOT NULL) WHERE place <= 5""")  # fmt: skip
def momentum_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, features, cross-section and top five per session, end to end."""
    frame = features(lineitem_bars(spark, sf_dir), ["D_sma20", "D_ret_1d_pct"], keep=("symbol", "session", "close"))
    ranked = frame.withColumn("X_rank", panel.rank_pct("D_ret_1d_pct")).filter("close > D_sma20 AND D_ret_1d_pct IS NOT NULL")
    best = metrics.ranked(ranked, "D_ret_1d_pct").filter("rank <= 5").withColumnRenamed("rank", "place")
    return rounded(best.select("symbol", "session", "D_ret_1d_pct", "X_rank", "place"), keep=("symbol", "session", "place"))
