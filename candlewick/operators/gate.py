"""The quality gate: is a series complete, valid, consistent and verified; all symbols in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.config import MAX_MISSING_SESSIONS, MAX_STALE_SESSIONS
from candlewick.operators import calendar, repair
from candlewick.sources.stage import staged

_NEAR = 1e-9


def _reasons(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), text) for c, text in pairs]))


def _text(n: str, what: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.lit(what))


def violates() -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return F.coalesce(h < l, F.lit(False)) | F.coalesce((c > h + _NEAR) | (c < l - _NEAR), F.lit(False)) | F.coalesce((o > h + _NEAR) | (o < l - _NEAR), F.lit(False))


def manifest(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, span, nulls by column, rows with a null price, rows that break price arithmetic, days without volume."""
    prices = ("open", "high", "low", "close")
    any_null = F.col("open").isNull()
    for x in prices[1:]:
        any_null = any_null | F.col(x).isNull()
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("session").alias("first"),
        F.max("session").alias("last"),
        *(F.count_if(F.col(x).isNull()).alias(f"null_{x}") for x in (*prices, "volume")),
        F.count_if(any_null).alias("rows_with_null_price"),
        F.count_if(F.col("close") <= 0).alias("nonpositive"),
        F.count_if(violates()).alias("ohlc_violations"),
        F.count_if(F.col("volume") == 0).alias("zero_volume_days"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count("volume").alias("with_volume"),
    )


def valid(bars: DataFrame, volume_required: bool = True) -> DataFrame:
    """(symbol, valid, reasons, ...): prices present, positive and in order, volume there if it has to be."""
    m = manifest(bars)
    no_volume = (F.col("with_volume") == 0) & F.lit(volume_required)
    why = _reasons(
        (F.col("rows_with_null_price") > 0, _text("rows_with_null_price", " rows with null prices")),
        (F.col("nonpositive") > 0, _text("nonpositive", " rows with close <= 0")),
        (F.col("ohlc_violations") > 0, _text("ohlc_violations", " rows violate price arithmetic")),
        (no_volume, F.lit("volume required but absent")),
        ((F.col("negative_volume") > 0) & ~no_volume & F.lit(volume_required), _text("negative_volume", " rows with negative volume")),
    )
    return m.withColumn("reasons", why).withColumn("valid", F.size("reasons") == 0)


def complete(bars: DataFrame, sessions: DataFrame, classified: DataFrame | None = None, trusted: bool = True) -> DataFrame:
    """(symbol, complete, reasons, first, last, rows, missing_sessions, stale_sessions).

    With classified absences only isolated ones count; without them all missing sessions do.
    """
    s = calendar.spans(bars)
    days = sessions.select("session").distinct()
    # sessions after a symbol's last: all sessions minus those up to it
    line = calendar.session_index(days)
    total = line.agg((F.max("idx") + 1).alias("_total"), F.min("session").alias("_first"))
    by_last = s.select(F.col("last").alias("session")).distinct().withColumn("_q", F.lit(1)).unionByName(line.select("session").withColumn("_q", F.lit(0)))
    upto = Window.partitionBy(F.lit(0)).orderBy("session", "_q").rowsBetween(Window.unboundedPreceding, 0)
    passed = by_last.withColumn("_upto", F.sum(1 - F.col("_q")).over(upto)).filter("_q = 1").select(F.col("session").alias("last"), "_upto")
    absent = calendar.missing(bars, sessions).groupBy("symbol").agg(F.count(F.lit(1)).alias("missing_sessions"))
    out = s.join(passed, "last").join(F.broadcast(total), how="left").join(absent, "symbol", "left").fillna(0, ["missing_sessions"])
    out = out.withColumn("stale_sessions", F.col("_total") - F.col("_upto"))
    if classified is None:
        out = out.withColumn("defects", F.col("missing_sessions"))
    else:
        out = out.join(calendar.absence_counts(classified).select("symbol", F.col("isolated").alias("defects")), "symbol", "left").fillna(0, ["defects"])
    why = _reasons(
        (F.lit(not trusted), F.lit("calendar is single-sourced; completeness cannot be verified")),
        (F.lit(trusted) & (F.col("stale_sessions") > MAX_STALE_SESSIONS), _text("stale_sessions", " sessions behind the exchange")),
        (F.lit(trusted) & (F.col("defects") > MAX_MISSING_SESSIONS), _text("defects", " sessions missing without explanation")),
    )
    return out.withColumn("reasons", why).select(
        "symbol", (F.size("reasons") == 0).alias("complete"), "reasons", "first", "last", F.col("n").alias("rows"), "missing_sessions", "stale_sessions", "defects"
    )


def consistent(bars: DataFrame, ordinal: str | None = None, kind: str = "equity") -> DataFrame:
    """(symbol, consistent, reasons): sorted as ingested, no session twice, no split left, roll marks where they belong."""
    dup = bars.groupBy("symbol").agg((F.count(F.lit(1)) - F.count_distinct("session")).alias("duplicates"), F.count_if(F.col("session").isNull()).alias("unparseable"))
    splits = repair.discontinuities(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("suspects"))
    out = dup.join(splits, "symbol", "left").fillna(0, ["suspects"])
    checks = [
        (F.col("unparseable") > 0, F.lit("unparseable timestamps")),
        ((F.col("unparseable") == 0) & (F.col("duplicates") > 0), _text("duplicates", " duplicate sessions")),
        (F.col("suspects") > 0, _text("suspects", " unresolved split-shaped discontinuities")),
    ]
    if ordinal:
        w = Window.partitionBy("symbol").orderBy(ordinal)
        back = bars.withColumn("_back", F.col("session") < F.lag("session").over(w)).groupBy("symbol").agg(F.count_if("_back").alias("backward"))
        out = out.join(back, "symbol")
        checks.append((F.col("backward") > 0, F.lit("timestamps not sorted")))
    if "D_roll" in bars.columns:
        unknown = bars.groupBy("symbol").agg(F.count_if(F.col("D_roll").isNull()).alias("unknown_rolls"))
        out = out.join(unknown, "symbol")
        checks.append((F.lit(kind != "futures"), F.lit("roll marks on a series that is no future")) if kind != "futures" else (F.col("unknown_rolls") > 0, _text("unknown_rolls", " rows predate the roll calendar")))
    return out.withColumn("reasons", _reasons(*checks)).withColumn("consistent", F.size("reasons") == 0)


def verified(bars: DataFrame, meta: DataFrame, schema_version: str | None = None) -> DataFrame:
    """(symbol, verified, reasons): the metadata exists, counts the same rows, and is of the schema and age it should be.

    `meta` has (symbol, rows, schema_version) and may have data_modified and meta_modified timestamps.
    """
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    m = meta.withColumn("_has", F.lit(True))
    out = n.join(m, "symbol", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    checks = [
        (~has, F.lit("no metadata: the build never completed")),
        (has & (F.col("rows") != F.col("_n")), F.concat(F.lit("metadata claims "), F.col("rows").cast("string"), F.lit(" rows, there are "), F.col("_n").cast("string"))),
    ]
    if schema_version is not None:
        checks.append((has & ~F.col("schema_version").eqNullSafe(schema_version), F.lit("schema differs from what is expected")))
    if {"data_modified", "meta_modified"} <= set(meta.columns):
        checks.append((F.col("meta_modified") < F.col("data_modified") - F.expr("INTERVAL 1 SECOND"), F.lit("data modified after its metadata")))
    return out.withColumn("reasons", _reasons(*checks)).select("symbol", (F.size("reasons") == 0).alias("verified"), "reasons")


def gate(bars: DataFrame, sessions: DataFrame, classified: DataFrame | None = None, meta: DataFrame | None = None, trusted: bool = True) -> DataFrame:
    """(symbol, complete, valid, consistent, verified, status, reasons) for every symbol."""
    bars, sessions = staged(bars), staged(sessions.select("session").distinct())
    a = complete(bars, sessions, classified, trusted).select("symbol", "complete", F.col("reasons").alias("r1"))
    b = valid(bars).select("symbol", "valid", F.col("reasons").alias("r2"))
    c = consistent(bars).select("symbol", "consistent", F.col("reasons").alias("r3"))
    out = a.join(b, "symbol").join(c, "symbol")
    if meta is None:
        out = out.withColumn("verified", F.lit(None).cast("boolean")).withColumn("r4", F.array().cast("array<string>"))
    else:
        out = out.join(verified(bars, meta).select("symbol", "verified", F.col("reasons").alias("r4")), "symbol")
    good = F.col("complete") & F.col("valid") & F.col("consistent") & F.coalesce(F.col("verified"), F.lit(True))
    status = F.when(good & F.col("verified").isNull(), "PASS_UNVERIFIED").when(good, "PASS").otherwise("QUARANTINE")
    return out.select("symbol", "complete", "valid", "consistent", "verified", status.alias("status"), F.concat("r1", "r2", "r3", "r4").alias("reasons"))


def assert_ready(gated: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Symbols that passed; raises if any did not, unless that is allowed."""
    bad = gated.filter("status = 'QUARANTINE'")
    if not allow_partial:
        first = bad.select("symbol").limit(5).collect()
        if first:
            raise ValueError(f"{bad.count()} symbols are quarantined, among them {[r.symbol for r in first]}")
    return gated.filter("status <> 'QUARANTINE'").select("symbol")


def coverage(bars: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(symbol, last, expected_last, stale): against the latest session of any equity, or of any series without kinds."""
    last = bars.groupBy("symbol").agg(F.max("session").alias("last"))
    voters = last if kinds is None else last.join(kinds.filter("kind = 'equity'").select("symbol"), "symbol", "left_semi")
    expected = voters.agg(F.max("last").alias("expected_last"))
    return last.join(F.broadcast(expected), how="left").withColumn("stale", F.col("last") < F.col("expected_last"))
