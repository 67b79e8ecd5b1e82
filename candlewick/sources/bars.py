"""Bars from trades: one row per symbol and session, with the first, highest, lowest and last price and the volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol bigint, session date, open double, high double, low double, close double, volume double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(c: Column) -> Column:
    """A number, or null for what is none: text that is not numeric, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def trades_to_bars(trades: DataFrame, keys: list[str], price: str, size: str, order: list[str]) -> DataFrame:
    """One aggregation; `order` must put a group's trades in one order."""
    first = F.struct(*order)
    return trades.groupBy(*keys).agg(
        F.min_by(price, first).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, first).alias("close"),
        F.sum(size).alias("volume"),
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of suppliers by ship date; the price is that of one unit."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("session"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("q"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )
    return trades_to_bars(rows, ["symbol", "session"], "px", "q", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event types."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("session"), "value", "ts", "event_id",
        F.lit(1.0).alias("one"),
    )
    return trades_to_bars(rows, ["symbol", "session"], "value", "one", ["ts", "event_id"])


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's own bars: all trades of a session."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("session"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("q"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_suppkey",
    )
    return trades_to_bars(rows, ["session"], "px", "q", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]).select(
        F.lit(0).cast("bigint").alias("symbol"), "session", "open", "high", "low", "close", "volume"
    )
