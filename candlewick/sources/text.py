"""Text inputs: symbol lists, holiday lists, tickers, dates, sidecar metadata."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header words that are no symbols, suffixes that a ticker loses in this order, date formats in order of trial.
HEADER_WORDS = "symbol symbols ticker tickers tradingsymbol name nan none null".split()
TICKER_SUFFIXES = ("-EQ", "-BE", "-BZ", "-SM", "-ST", ".NS", ".BO")
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def sanitise(c: str) -> Column:
    """A usable symbol, or null: no NUL, BOM or white space around it, no characters that files forbid, no header word."""
    x = F.regexp_replace(F.regexp_replace(F.col(c), "[\\x00\\x{FEFF}]", ""), "[<>:\"/\\\\|?*\\s]+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when((F.length(x) > 0) & ~F.lower(x).isin(HEADER_WORDS), x)


def normalise(c: str) -> Column:
    """Upper case, exchange suffixes off, letters and digits only."""
    x = F.upper(F.trim(F.col(c)))
    for s in TICKER_SUFFIXES:
        x = F.regexp_replace(x, re.escape(s) + "$", "")
    return F.regexp_replace(x, "[^A-Z0-9]", "")


def parse_date(c: str) -> Column:
    """The first of the formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)).cast("date") for f in DATE_FORMATS])


def symbols(lines: DataFrame, c: str = "value", position: str = "pos") -> DataFrame:
    """(symbol, pos): tokens of lines with a position, sanitised; of symbols that differ in case only the first counts."""
    tokens = lines.select(F.col(position).alias("_line"), F.posexplode(F.split(c, "[,\\t\\n;]")).alias("_k", "token"))
    clean = tokens.withColumn("symbol", sanitise("token")).filter("symbol IS NOT NULL")
    w = Window.partitionBy(F.lower("symbol")).orderBy("_line", "_k")
    return clean.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("symbol", F.col("_line").alias("pos"))


def resolve(wanted: DataFrame, instruments: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(symbol, token, rule): by override, else by exact trading symbol, else with -EQ, else by normalised name.

    `wanted` has symbol, `instruments` tradingsymbol and token, `overrides` symbol and token.  Three equality joins; among
    instruments of one normalised name the shortest trading symbol wins.
    """
    exact = instruments.groupBy("tradingsymbol").agg(F.min("token").alias("token"))
    by_name = instruments.withColumn("_n", normalise("tradingsymbol")).groupBy("_n").agg(F.min_by("token", F.struct(F.length("tradingsymbol"), F.col("tradingsymbol"))).alias("_t3"))
    w = wanted.select("symbol").distinct()
    j = w.join(exact.select(F.col("tradingsymbol").alias("symbol"), F.col("token").alias("_t1")), "symbol", "left")
    eq = exact.filter(F.endswith("tradingsymbol", F.lit("-EQ"))).select(F.expr("substring(tradingsymbol, 1, length(tradingsymbol) - 3)").alias("symbol"), F.col("token").alias("_t2"))
    j = j.join(eq, "symbol", "left").withColumn("_n", normalise("symbol")).join(by_name, "_n", "left")
    j = j.join(overrides.select("symbol", F.col("token").alias("_t0")), "symbol", "left") if overrides is not None else j.withColumn("_t0", F.lit(None).cast("long"))
    rule = F.when(F.col("_t0").isNotNull(), "override").when(F.col("_t1").isNotNull(), "exact").when(F.col("_t2").isNotNull(), "eq").when(F.col("_t3").isNotNull(), "normalised")
    return j.select("symbol", F.coalesce("_t0", "_t1", "_t2", "_t3").alias("token"), rule.alias("rule"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _grams(c: str) -> Column:
    """Pairs of neighbouring letters, and single letters of names of up to three."""
    n = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2)))
    return F.array_distinct(F.concat(pairs, F.when(n <= 3, F.split(c, "")).otherwise(F.array().cast("array<string>"))))


def suggestions(unresolved: DataFrame, instruments: DataFrame, top: int = 3, cutoff: float = 0.77) -> DataFrame:
    """(symbol, suggestion, similarity): the closest of all names by the ratio of their matching parts.

    Names of which at least 0.77 matches share two neighbouring letters: between k letters that match one by one there
    are k - 1 others, more than 0.6 k if k is above two.  So they meet by these, and by single letters if they are short.
    """
    if cutoff < 0.77:
        raise ValueError("below 0.77 names may match without sharing two letters in a row")
    a = unresolved.select("symbol", normalise("symbol").alias("_a")).filter("_a <> ''").distinct().withColumn("_k", F.explode(_grams("_a")))
    b = instruments.select(F.col("tradingsymbol").alias("suggestion"), normalise("tradingsymbol").alias("_b")).filter("_b <> ''").distinct().withColumn("_k", F.explode(_grams("_b")))
    # 2 * the shorter one's length over both is the most that the ratio can be
    possible = 2 * F.least(F.length("_a"), F.length("_b")) >= cutoff * (F.length("_a") + F.length("_b"))
    met = a.join(b, "_k").filter(possible).select("symbol", "suggestion", "_a", "_b").distinct()
    pairs = met.withColumn("similarity", _ratio("_a", "_b")).filter(F.col("similarity") >= cutoff)
    w = Window.partitionBy("symbol").orderBy(F.desc("similarity"), "suggestion")
    return pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).select("symbol", "suggestion", "similarity")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols from a file: of a CSV the first column, of other text one or more per line."""
    if path.lower().endswith((".csv", ".csv.gz")):
        lines = spark.read.option("header", "false").csv(path).select(F.col("_c0").alias("value"))
    else:
        lines = spark.read.text(path)
    lines = lines.withColumn("pos", F.monotonically_increasing_id())
    return symbols(lines)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """(session) from a file with one ISO date per line, no header."""
    return spark.read.schema("d string").csv(path).select(parse_date("d").alias("session")).filter("session IS NOT NULL")
