"""Queries of calendars, absences, gates, repairs and text inputs, with their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.config import SPLIT_RATIOS
from candlewick.operators import calendar, gate, repair
from candlewick.plans.feature_queries import BARS_SQL, duck_round, rounded
from candlewick.sources import text
from candlewick.sources.bars import lineitem_bars, table
from candlewick.sources.stage import staged

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


#: Suppliers trade on a part of the sessions only, so votes need a lower share here than on an exchange.
SHARE, WIDE = 0.22, 0.85

_SPANS_SQL = f"""{BARS_SQL}, spans AS (SELECT symbol, min(session) AS lo, max(session) AS hi, count(DISTINCT session) AS n FROM bars GROUP BY 1),
days AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM (SELECT DISTINCT session FROM bars)),
grid AS (SELECT symbol, session, idx FROM spans JOIN days ON session BETWEEN lo AND hi),
absent AS (SELECT g.* FROM grid g ANTI JOIN bars b USING (symbol, session)),
alive AS (SELECT session, count(*) AS live FROM grid GROUP BY 1),
wide AS (SELECT session FROM (SELECT session, count(*) AS k FROM absent GROUP BY 1) JOIN alive USING (session) WHERE k / live >= {WIDE}),
own AS (SELECT *, idx - row_number() OVER (PARTITION BY symbol ORDER BY idx) AS g FROM absent WHERE session NOT IN (SELECT session FROM wide)),
classified AS (SELECT symbol, session, idx, CASE WHEN count(*) OVER (PARTITION BY symbol, g) >= 5 THEN 'suspension' ELSE 'isolated' END AS class FROM own
  UNION ALL SELECT symbol, session, idx, 'market_wide' FROM absent WHERE session IN (SELECT session FROM wide))"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("session")).distinct()


@query("consensus_calendar", f"""WITH {_SPANS_SQL} SELECT session, present, live FROM (SELECT session, count(DISTINCT symbol) AS present FROM bars GROUP BY 1) JOIN alive USING (session)
  WHERE present / live >= {SHARE}""")  # fmt: skip
def consensus_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.consensus(_bars(spark, sf_dir), SHARE, voters=5)


@query("session_gaps", f"WITH {_SPANS_SQL} SELECT symbol, count(*) AS missing, min(session) AS first_missing, max(session) AS last_missing FROM absent GROUP BY 1")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calendar.missing(staged(_bars(spark, sf_dir).select("symbol", "session")), staged(_days(spark, sf_dir)))
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"), F.min("session").alias("first_missing"), F.max("session").alias("last_missing"))


@query("absences", f"WITH {_SPANS_SQL} SELECT symbol, session, CAST(idx AS INTEGER) AS idx, class FROM classified")
def absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.classify(_bars(spark, sf_dir), _days(spark, sf_dir), WIDE)


@query("absence_counts", f"""WITH {_SPANS_SQL} SELECT symbol, count(*) FILTER (WHERE class = 'market_wide') AS market_wide, count(*) FILTER (WHERE class = 'suspension') AS suspension,
  count(*) FILTER (WHERE class = 'isolated') AS isolated FROM classified GROUP BY 1""")  # fmt: skip
def absence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.absence_counts(calendar.classify(_bars(spark, sf_dir), _days(spark, sf_dir), WIDE))


@query("gap_runs", f"""WITH {_SPANS_SQL}, m AS (SELECT symbol, session, coalesce(date_diff('day', lag(session) OVER w, session) > 4, true) AS fresh FROM absent WINDOW w AS (PARTITION BY symbol ORDER BY session)),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY symbol ORDER BY session) AS g FROM m)
SELECT symbol, min(session) AS first, max(session) AS last, count(*) AS n FROM g GROUP BY symbol, g""")  # fmt: skip
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.date_runs(calendar.missing(staged(_bars(spark, sf_dir).select("symbol", "session")), staged(_days(spark, sf_dir))))


@query("gap_summary", f"""WITH {_SPANS_SQL}, m AS (SELECT symbol, session, coalesce(date_diff('day', lag(session) OVER w, session) > 4, true) AS fresh FROM absent WINDOW w AS (PARTITION BY symbol ORDER BY session)),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY symbol ORDER BY session) AS g FROM m),
r AS (SELECT symbol, min(session) AS a, max(session) AS b FROM g GROUP BY symbol, g),
t AS (SELECT symbol, count(*) AS n_gaps, list(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '..' || CAST(b AS VARCHAR) END ORDER BY a) AS x FROM r GROUP BY 1)
SELECT symbol, n_gaps, array_to_string(x[1:5], ', ') || CASE WHEN n_gaps > 5 THEN ' +' || CAST(n_gaps - 5 AS VARCHAR) || ' more' ELSE '' END AS summary FROM t""")  # fmt: skip
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.gap_summary(calendar.date_runs(calendar.missing(staged(_bars(spark, sf_dir).select("symbol", "session")), staged(_days(spark, sf_dir)))))


@query("peer_sessions", f"""WITH {BARS_SQL}, x AS (SELECT s_nationkey AS exchange, symbol, session FROM bars JOIN supplier ON s_suppkey = symbol)
SELECT DISTINCT exchange, session FROM x WHERE exchange IN (SELECT exchange FROM x GROUP BY 1 HAVING count(DISTINCT symbol) >= 2)""")  # fmt: skip
def peer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("exchange"))
    return calendar.peer_sessions(_bars(spark, sf_dir).select("symbol", "session").join(where, "symbol"))


@query("business_days", """SELECT CAST(d AS DATE) AS session FROM generate_series(DATE '1995-01-02', DATE '1996-12-31', INTERVAL 1 DAY) t(d)
WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P')""")  # fmt: skip
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("session"))
    return calendar.business_days(spark, "1995-01-02", "1996-12-31", closed)


@query("calendar_disagreements", """WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders),
s AS (SELECT greatest((SELECT min(session) FROM a), (SELECT min(session) FROM b)) AS lo, least((SELECT max(session) FROM a), (SELECT max(session) FROM b)) AS hi)
SELECT session, only_in FROM (SELECT session, 'a' AS only_in FROM a ANTI JOIN b USING (session) UNION ALL SELECT session, 'b' FROM b ANTI JOIN a USING (session)), s WHERE session BETWEEN lo AND hi""")  # fmt: skip
def calendar_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("session"))
    return calendar.disagreements(_days(spark, sf_dir), orders)


# gates

_MANIFEST = "rows first last null_open null_high null_low null_close null_volume rows_with_null_price nonpositive ohlc_violations zero_volume_days negative_volume with_volume".split()
#: Bars with planted defects: some nulls, prices out of order and negative volumes.
_SPOILT_SQL = f"""{BARS_SQL}, spoilt AS (SELECT symbol, session, CASE WHEN symbol % 7 = 0 AND day(session) = 1 THEN NULL ELSE open END AS open, high,
  CASE WHEN symbol % 5 = 0 AND day(session) = 2 THEN high + 1 ELSE low END AS low, CASE WHEN symbol % 11 = 0 AND day(session) = 3 THEN -close ELSE close END AS close,
  CASE WHEN symbol % 13 = 0 AND day(session) = 4 THEN -volume WHEN symbol = 3 THEN NULL ELSE volume END AS volume FROM bars)"""
_MANIFEST_SQL = f"""{_SPOILT_SQL}, m AS (SELECT symbol, count(*) AS rows, min(session) AS first, max(session) AS last, count(*) - count(open) AS null_open, count(*) - count(high) AS null_high,
  count(*) - count(low) AS null_low, count(*) - count(close) AS null_close, count(*) - count(volume) AS null_volume,
  count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS rows_with_null_price, count(*) FILTER (WHERE close <= 0) AS nonpositive,
  count(*) FILTER (WHERE high < low OR close > high + 1e-9 OR close < low - 1e-9 OR open > high + 1e-9 OR open < low - 1e-9) AS ohlc_violations,
  count(*) FILTER (WHERE volume = 0) AS zero_volume_days, count(*) FILTER (WHERE volume < 0) AS negative_volume, count(volume) AS with_volume FROM spoilt GROUP BY 1)"""


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("session")
    s = F.col("symbol")
    return _bars(spark, sf_dir).select(
        "symbol", "session", F.when(~((s % 7 == 0) & (day == 1)), F.col("open")).alias("open"), "high",
        F.when((s % 5 == 0) & (day == 2), F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when((s % 11 == 0) & (day == 3), -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when((s % 13 == 0) & (day == 4), -F.col("volume")).when(s != 3, F.col("volume")).alias("volume"),
    )


@query("manifest", f"WITH {_MANIFEST_SQL} SELECT symbol, {', '.join(_MANIFEST)} FROM m")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.manifest(_spoilt(spark, sf_dir))


@query("gate_valid", f"""WITH {_MANIFEST_SQL} SELECT symbol, rows_with_null_price = 0 AND nonpositive = 0 AND ohlc_violations = 0 AND with_volume > 0 AND negative_volume = 0 AS valid,
  concat_ws('; ', CASE WHEN rows_with_null_price > 0 THEN rows_with_null_price || ' rows with null prices' END, CASE WHEN nonpositive > 0 THEN nonpositive || ' rows with close <= 0' END,
    CASE WHEN ohlc_violations > 0 THEN ohlc_violations || ' rows violate price arithmetic' END, CASE WHEN with_volume = 0 THEN 'volume required but absent' END,
    CASE WHEN negative_volume > 0 AND with_volume > 0 THEN negative_volume || ' rows with negative volume' END) AS reasons FROM m""")  # fmt: skip
def gate_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.valid(_spoilt(spark, sf_dir)).select("symbol", "valid", F.concat_ws("; ", "reasons").alias("reasons"))


_COMPLETE_SQL = f"""{_SPANS_SQL}, c AS (SELECT symbol, lo AS first, hi AS last, n AS rows, (SELECT count(*) FROM absent a WHERE a.symbol = s.symbol) AS missing_sessions,
  (SELECT count(*) FROM days d WHERE d.session > s.hi) AS stale_sessions, (SELECT count(*) FROM classified k WHERE k.symbol = s.symbol AND class = 'isolated') AS defects FROM spans s)"""


@query("gate_complete", f"WITH {_COMPLETE_SQL} SELECT symbol, first, last, rows, missing_sessions, stale_sessions, defects, stale_sessions <= 1 AND defects <= 3 AS complete FROM c")
def gate_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = staged(_bars(spark, sf_dir)), staged(_days(spark, sf_dir))
    return gate.complete(b, d, calendar.classify(b, d, WIDE)).drop("reasons")


_SPLIT_SQL = f"""splits AS (SELECT symbol, session, prev_close, close, prev_close / close AS ratio, (SELECT min_by(r, i) FROM (SELECT unnest({list(SPLIT_RATIOS)}) AS r, unnest(range({len(SPLIT_RATIOS)})) AS i)
    WHERE abs(greatest(prev_close / close, close / prev_close) - r) / r <= 0.04) AS nearest_split, move * 100 AS move_pct,
  CASE WHEN pv IS NULL OR volume IS NULL OR pv <= 0 THEN true WHEN close < prev_close THEN volume / pv > 1.3 ELSE volume / pv < 0.77 END AS volume_consistent, high, low, move, after, n
  FROM (SELECT *, lag(close) OVER w AS prev_close, lag(volume) OVER w AS pv, abs(close / lag(close) OVER w - 1) AS move, count(*) OVER (PARTITION BY symbol) AS n,
    quantile_cont(close, 0.5) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session))
  WHERE n >= 3 AND move >= 0.3 AND close > 0 AND prev_close > 0),
suspects AS (SELECT * FROM splits WHERE nearest_split IS NOT NULL AND (high - low) / close <= 0.5 * move AND abs(after / close - 1) <= 0.5 * move)"""


@query("split_detect", f"""WITH {BARS_SQL}, {_SPLIT_SQL} SELECT symbol, session, {", ".join(map(duck_round, ("prev_close", "close", "ratio", "nearest_split", "move_pct")))}, volume_consistent,
  CASE WHEN volume_consistent THEN 'high' ELSE 'medium' END AS confidence FROM suspects""")  # fmt: skip
def split_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(repair.discontinuities(_bars(spark, sf_dir)))


@query("gate_status", f"""WITH {_COMPLETE_SQL}, {_SPLIT_SQL}, g AS (SELECT symbol, stale_sessions <= 1 AND defects <= 3 AS complete, symbol NOT IN (SELECT symbol FROM suspects) AS consistent FROM c)
SELECT symbol, complete, true AS valid, consistent, CASE WHEN complete AND consistent THEN 'PASS_UNVERIFIED' ELSE 'QUARANTINE' END AS status FROM g""")  # fmt: skip
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = staged(_bars(spark, sf_dir)), staged(_days(spark, sf_dir))
    return gate.gate(b, d, calendar.classify(b, d, WIDE)).drop("reasons", "verified")


@query("gate_verified", f"""WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1),
m AS (SELECT symbol, n + CAST(symbol % 3 = 0 AS INT) AS rows, CASE WHEN symbol % 5 = 0 THEN 'v1' ELSE 'v2' END AS v FROM n WHERE symbol % 2 = 0)
SELECT symbol, m.rows IS NOT NULL AND m.rows = n AND v = 'v2' AS verified FROM n LEFT JOIN m USING (symbol)""")  # fmt: skip
def gate_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("symbol", "session")
    n = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("symbol % 2 = 0")
    meta = n.select("symbol", F.expr("n + CAST(symbol % 3 = 0 AS INT)").alias("rows"), F.expr("CASE WHEN symbol % 5 = 0 THEN 'v1' ELSE 'v2' END").alias("schema_version"))
    return gate.verified(b, meta, "v2").drop("reasons")


@query("coverage", f"WITH {BARS_SQL}, l AS (SELECT symbol, max(session) AS last FROM bars GROUP BY 1) SELECT symbol, last, (SELECT max(last) FROM l) AS expected_last, last < (SELECT max(last) FROM l) AS stale FROM l")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.coverage(_bars(spark, sf_dir))


# repair

@query("orphan_trim", f"""WITH {BARS_SQL}, g AS (SELECT symbol, session, date_diff('day', lag(session) OVER w, session) AS gap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)), s AS (SELECT symbol, max(session) AS start FROM g WHERE gap >= 20 AND n - rn + 1 >= 252 GROUP BY 1)
SELECT symbol, session FROM bars LEFT JOIN s USING (symbol) WHERE start IS NULL OR session >= start""")  # fmt: skip
def orphan_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.trim_orphans(_bars(spark, sf_dir).select("symbol", "session"), gap_days=20)


_EXPIRY_SQL = "e AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS expiry FROM orders WHERE o_orderdate >= '1996-01-01')"


@query("roll_marks", f"""WITH {BARS_SQL}, {_EXPIRY_SQL}, first_after AS (SELECT DISTINCT symbol, min(session) AS session FROM e JOIN bars ON session > expiry GROUP BY symbol, expiry)
SELECT symbol, session, CASE WHEN session < (SELECT min(expiry) FROM e) THEN NULL WHEN (symbol, session) IN (SELECT (symbol, session) FROM first_after) THEN 1 ELSE 0 END AS D_roll FROM bars""")  # fmt: skip
def roll_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").filter("o_orderdate >= '1996-01-01'").select(F.last_day(F.col("o_orderdate").cast("date")).alias("expiry"))
    return repair.roll_marks(_bars(spark, sf_dir).select("symbol", "session"), e)


@query("roll_calendar", """SELECT last_day(CAST(o_orderdate AS DATE)) AS expiry, arg_min(CAST(o_orderkey AS VARCHAR), ROW(o_orderdate, o_orderkey)) AS tradingsymbol FROM orders GROUP BY 1""")
def roll_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(
        F.last_day(F.col("o_orderdate").cast("date")).alias("expiry"), F.col("o_orderkey").cast("string").alias("tradingsymbol"), F.struct("o_orderdate", "o_orderkey").alias("observed_on")
    )
    return repair.roll_calendar(seen).drop("observed_on")


@query("front_month", """SELECT o_orderpriority AS underlying, arg_min(CAST(o_orderkey AS VARCHAR), ROW(CAST(o_orderdate AS DATE), CAST(o_orderkey AS VARCHAR))) AS tradingsymbol, min(CAST(o_orderdate AS DATE)) AS expiry
FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= '1998-06-15' GROUP BY 1""")  # fmt: skip
def front_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("tradingsymbol"), F.col("o_orderdate").cast("date").alias("expiry"),
        F.when(F.col("o_orderstatus") == "O", "FUT").otherwise("EQ").alias("instrument_type"),
    )
    return repair.front_month(o, datetime.date(1998, 6, 15))


@query("dedup_latest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.dedup(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("merge_tail", f"""WITH {BARS_SQL} SELECT symbol, session, {duck_round("close")} FROM (
  SELECT symbol, session, CASE WHEN session >= DATE '2001-01-01' THEN close + 1 ELSE close END AS close FROM bars WHERE session < DATE '2001-06-01' OR symbol % 2 = 0)""")  # fmt: skip
def merge_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("symbol", "session", "close")
    stored = b.filter("session < DATE'2001-06-01'")
    fetched = b.filter("session >= DATE'2001-01-01' AND (session < DATE'2001-06-01' OR symbol % 2 = 0)").withColumn("close", F.col("close") + 1)
    return rounded(repair.merge_tail(stored, fetched))


@query("refetch_plan", f"""WITH {BARS_SQL}, {_SPLIT_SQL}, h AS (SELECT symbol, min(session) AS lo, max(session) AS hi FROM bars GROUP BY 1),
w AS (SELECT CAST(s_suppkey AS BIGINT) + CASE WHEN s_suppkey % 10 = 0 THEN 1000000 ELSE 0 END AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1990-01-01' ELSE DATE '1999-01-01' END AS first,
  CASE WHEN s_suppkey % 2 = 0 THEN DATE '2010-01-01' ELSE DATE '2000-01-01' END AS last FROM supplier),
a AS (SELECT w.*, hi, CASE WHEN lo IS NULL OR w.symbol IN (SELECT symbol FROM suspects) THEN 'full' WHEN lo > first THEN 'backfill' WHEN hi < last THEN 'tail' ELSE 'skip' END AS action FROM w LEFT JOIN h USING (symbol))
SELECT symbol, action, CASE action WHEN 'tail' THEN CAST(hi - 7 AS DATE) WHEN 'skip' THEN NULL ELSE first END AS fetch_from, CASE WHEN action <> 'skip' THEN last END AS fetch_to FROM a""")  # fmt: skip
def refetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select(
        F.expr("CAST(s_suppkey AS BIGINT) + CASE WHEN s_suppkey % 10 = 0 THEN 1000000 ELSE 0 END").alias("symbol"),
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN DATE'1990-01-01' ELSE DATE'1999-01-01' END").alias("first"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN DATE'2010-01-01' ELSE DATE'2000-01-01' END").alias("last"),
    )
    return repair.refetch_plan(_bars(spark, sf_dir), wanted)


# text

@query("symbol_sanitise", """SELECT p_partkey, CASE WHEN length(x) > 0 AND lower(x) NOT IN ('symbol', 'symbols', 'ticker', 'tickers', 'tradingsymbol', 'name', 'nan', 'none', 'null') THEN x END AS symbol
FROM (SELECT p_partkey, regexp_replace(regexp_replace(' ' || p_name || ':' || p_type || '?', '[<>:"/\\\\|?*\\s]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM part)""")  # fmt: skip
def symbol_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(":"), "p_type", F.lit("?")).alias("raw"))
    return raw.select("p_partkey", text.sanitise("raw").alias("symbol"))


@query("ticker_normalise", "SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS ticker FROM customer")
def ticker_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "-eq").otherwise(".NS")).alias("raw"))
    return raw.select("c_custkey", text.normalise("raw").alias("ticker"))


@query("date_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 3 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
  ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")  # fmt: skip
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read as day and month, or as month and day, is read as the former."""
    o = table(spark, sf_dir, "orders")
    written = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy')
        WHEN 3 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 4 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE 'soon' END""")
    return o.select("o_orderkey", written.alias("raw")).select("o_orderkey", text.parse_date("raw").alias("d"))


@query("symbol_resolve", """WITH w AS (SELECT s_suppkey AS k, s_name AS symbol FROM supplier)
SELECT symbol, CASE k % 4 WHEN 3 THEN NULL ELSE k END AS token, CASE k % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'eq' WHEN 2 THEN 'normalised' END AS rule FROM w""")  # fmt: skip
def symbol_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("token"), F.col("s_name").alias("symbol"))
    traded = F.expr("CASE token % 4 WHEN 0 THEN symbol WHEN 1 THEN symbol || '-EQ' WHEN 2 THEN lower(symbol) || '.NS' END")
    return text.resolve(s, s.select("token", traded.alias("tradingsymbol")).filter("tradingsymbol IS NOT NULL"))


@query("symbol_list", """WITH t AS (SELECT n_nationkey AS pos, unnest(string_split(n_name || ',' || lower(n_name) || ',' || r_name, ',')) AS s FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT pos, regexp_replace(s, '\\s+', '_', 'g') AS s FROM t)
SELECT arg_min(s, pos) AS symbol, min(pos) AS pos FROM (SELECT pos, s FROM c WHERE s <> lower(s)) GROUP BY lower(s)""")  # fmt: skip
def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.select(F.col("n_nationkey").alias("pos"), F.concat_ws(",", "n_name", F.lower("n_name"), "r_name").alias("value"))
    return text.symbols(lines)
