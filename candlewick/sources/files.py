"""Where series, metadata and panels come from and go to.  Spark's commit protocol makes every write all or nothing."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.sources.bars import number

_PRICES = ("open", "high", "low", "close", "volume")


def read_series(spark: SparkSession, path: str, suffix: str = "_daily.parquet") -> DataFrame:
    """Bars of all `<SYMBOL>_daily.parquet` files under a folder: the symbol comes from the file's name, the session from
    `timestamp`; a series without a volume column gets nulls."""
    raw = spark.read.option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/*{suffix}")
    named = raw.withColumn("symbol", F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$", ""))
    have = {c.lower(): c for c in raw.columns}
    prices = [number(F.col(have[c])).alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in _PRICES]
    roll = [F.col(have["d_roll"]).cast("tinyint").alias("D_roll")] if "d_roll" in have else []
    return named.select("symbol", F.col(have["timestamp"]).cast("date").alias("session"), *prices, *roll)


def read_sidecars(spark: SparkSession, path: str, suffix: str = "_daily.ok.json") -> DataFrame:
    """Series' metadata, one row per file, with the time at which each was written."""
    raw = spark.read.option("multiLine", "true").json(f"{path.rstrip('/')}/*{suffix}")
    return raw.withColumn("symbol", F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$", "")).withColumn("meta_modified", F.col("_metadata.file_modification_time"))


def write_panel(panel: DataFrame, path: str, dynamic: bool = False) -> None:
    """A panel by month; `dynamic` replaces the months that are in it and leaves the others."""
    by_month = panel.withColumn("month", F.date_format("session", "yyyy-MM"))
    writer = by_month.repartition("month").sortWithinPartitions("session", "symbol").write.partitionBy("month").mode("overwrite").option("compression", "snappy")
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None, since=None) -> DataFrame:
    """The panel, from the months that can hold sessions from `since` on."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter((F.col("month") >= F.date_format(F.lit(since), "yyyy-MM")) & (F.col("session") >= F.lit(since)))
    return df.select(*columns) if columns else df.drop("month")


def check_panel(panel: DataFrame, features: list[str], targets: list[str]) -> None:
    """Raises unless the panel has the columns, numeric features, keys without null or repeat, and targets of 0, 1 and null."""
    kinds = dict(panel.dtypes)
    lacking = [c for c in ("symbol", "session", *features, *targets) if c not in kinds]
    if lacking:
        raise ValueError(f"the panel lacks {', '.join(lacking)}")
    text = [c for c in features if kinds[c] in ("string", "date", "boolean")]
    if text:
        raise ValueError(f"features are not numeric: {', '.join(text)}")
    odd = [F.count_if(F.col(t).isNotNull() & ~F.col(t).isin(0, 1)).alias(f"_{t}") for t in targets]
    got = panel.agg(F.count_if(F.col("symbol").isNull() | F.col("session").isNull()).alias("nulls"), *odd).first()
    if got["nulls"]:
        raise ValueError(f"{got['nulls']} rows have a null key")
    if bad := [t for t in targets if got[f"_{t}"]]:
        raise ValueError(f"targets are not binary: {', '.join(bad)}")
    if panel.groupBy("symbol", "session").count().filter("count > 1").limit(1).count():
        raise ValueError("symbol and session are not unique")


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions by experiment and fold; writing a fold again replaces it and nothing else."""
    predictions.write.partitionBy("experiment", "fold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def cached_span(spark: SparkSession, path: str) -> DataFrame:
    """(first, last) of stored bars, from the files' statistics where those suffice."""
    return spark.read.parquet(path).agg(F.min("session").alias("first"), F.max("session").alias("last"))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object; the commit protocol makes it all or nothing."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What `write_json` wrote; None where there is nothing."""
    try:
        lines = [r.value for r in spark.read.text(path).collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads("\n".join(lines)) if lines else None


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, of at most 2 GB each."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def normalise_range(start: datetime.date, end: datetime.date, today: datetime.date) -> tuple[datetime.date, datetime.date, list[str]]:
    """A date range in order and not beyond today, and what was changed about it."""
    notes = []
    if start > end:
        start, end = end, start
        notes.append("start and end were swapped")
    if end > today:
        end = today
        notes.append("the end was set to today")
    if start > end:
        start = end
        notes.append("the start was set to the end")
    return start, end, notes


def json_hash(value) -> str:
    """The first 16 hex digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def fetch_chunks(spark: SparkSession, first: str, last: str, days: int = 2000) -> DataFrame:
    """(start, end) of the ranges in which a vendor is asked for a long history."""
    s = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', make_interval(0, 0, 0, {days}))) AS start")
    return s.withColumn("end", F.least(F.date_add("start", days - 1), F.lit(last).cast("date")))
