"""Trades as they arrive: bars that close with the watermark, and a store that late corrections win over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.repair import merge_tail


def stream_bars(trades: DataFrame, every: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(symbol, start, open, high, low, close, volume) from a stream of (symbol, ts, price, size, seq).

    A bar is final once the watermark has passed its end: it is provisional before and unchanged after.
    """
    order = F.struct("ts", "seq")
    g = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    bars = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def final_only(bars: DataFrame, completed_until) -> DataFrame:
    """Bars of sessions that have ended."""
    return bars.filter(F.col("session") <= F.lit(completed_until))


def upsert_stream(bars: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "session"), **trigger) -> StreamingQuery:
    """Keeps a parquet store in which, per key, the row that arrived last counts.

    Every batch writes a version of its own, and the pointer moves when the version is whole, so a batch that is
    repeated after a failure gives the same store.
    """
    spark = bars.sparkSession

    def batch(fresh: DataFrame, epoch: int) -> None:
        latest = fresh.withColumn("_i", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*fresh.columns), "_i").alias("r")).select("r.*")
        versions = _versions(spark, path)
        older = [v for v in versions if v < epoch]
        merged = merge_tail(spark.read.parquet(f"{path}/v={older[-1]}"), latest, keys) if older else latest
        merged.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _versions(spark, path: str) -> list[int]:
    """Versions whose write was completed."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = []
    for s in fs.listStatus(base):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def read_store(spark, path: str) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v={versions[-1]}")
