"""What each feature promises, and checks that none of them looks ahead."""

from __future__ import annotations

import ast
import inspect
import re
from functools import reduce
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.dialects import Spark
from candlewick.operators.catalogue import BAR, MONTHLY, RECURSIVE, WEEKLY, feature_names, formulas
from candlewick.operators.features import features, layers

# Parts of names that only forward-looking columns have, in any case.
FORWARD_PARTS = "_fwd fwd_ future_ _ahead lookahead mfe mae target_ label_ _next ret_1d_close_pct ret_3d_close_pct ret_5d_close_pct".split()

# What families of columns are meant to capture, by the longest prefix that fits.
HYPOTHESES = {
    "D_": "price and volume history", "D_ema": "trend", "D_sma": "trend", "D_rsi": "momentum", "D_macd": "momentum", "D_adx": "trend strength",
    "D_atr": "volatility", "D_vol_": "volatility", "D_realvol": "volatility", "D_dvol": "unusual turnover", "D_amihud": "illiquidity", "D_WQ": "short-term alpha",
    "D_nr": "compression", "D_compress": "compression", "D_breakout": "breakout", "D_donch": "channel position", "D_cpr": "pivot levels", "W_": "weekly momentum",
    "DOW_": "day of the week", "Comb_": "combined condition", "X_": "standing among peers", "MKT_": "state of the market",
}


def is_forward_name(name: str) -> bool:
    return any(p in name.lower() for p in FORWARD_PARTS)


def forward_name(c: str) -> Column:
    """The same rule for a column of names."""
    return reduce(Column.__or__, (F.contains(F.lower(c), F.lit(p)) for p in FORWARD_PARTS))


def assert_no_forward(columns: list[str]) -> None:
    ahead = [c for c in columns if is_forward_name(c)]
    if ahead:
        raise ValueError(f"columns look ahead: {', '.join(ahead)}")


def hypothesis(name: str) -> str:
    fits = [p for p in HYPOTHESES if name.startswith(p)]
    return HYPOTHESES[max(fits, key=len)] if fits else ""


def lookback(name: str) -> int:
    """Bars that a value depends on, as far as its frames say; recursive columns depend on all."""
    if name in RECURSIVE:
        return -1
    text = formulas(Spark())
    plan, used = layers([name], text, {*BAR, "rn", *RECURSIVE, *WEEKLY, *MONTHLY})
    if used & set(RECURSIVE):
        return -1
    total = 0
    for layer in plan:
        total += max((max((int(n) for n in re.findall(r"BETWEEN (\d+) PRECEDING", text[c])), default=max((int(n) for n in re.findall(r"lag\([^()]*, (\d+)\)", text[c])), default=0)) for c in layer), default=0)
    return total


def contract(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """One row per feature: when it is known, when it may be used, how far it looks back, and why it exists."""
    rows = [(n, "session close", "next session open", lookback(n), False, n.startswith("X_"), not is_forward_name(n), hypothesis(n)) for n in names or feature_names()]
    return spark.createDataFrame(
        rows, "column string, resolved_at string, usable_from string, lookback int, uses_future boolean, cross_sectional boolean, in_x boolean, hypothesis string"
    )


def assert_complete(contract_: DataFrame, columns: list[str]) -> None:
    known = {r["column"] for r in contract_.select("column").collect()}
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"columns without a contract: {', '.join(missing)}")


def static_leaks(text: dict[str, str] | None = None) -> list[str]:
    """Feature formulas that read rows ahead, or a whole series at once: frames that follow, leads, windows without order."""
    text = formulas(Spark()) if text is None else text
    bad = []
    for name, sql in text.items():
        ahead = re.search(r"FOLLOWING|\blead\(", sql)
        whole = re.search(r"OVER \(PARTITION BY \w+\)", sql) and name != "D_is_warmup"
        bare = re.search(r"\b(avg|sum|max|min|stddev_samp|percentile)\((?:[^()]|\([^()]*\))*\)(?! OVER)", sql) if "aggregate(" not in sql else None
        if (ahead or whole or bare) and not is_forward_name(name):
            bad.append(name)
    return bad


def kernel_leaks(module: ModuleType) -> list[str]:
    """Functions of a module of pandas kernels that read rows ahead, or a whole series at once: negative shifts, filling
    backwards, centred windows, reversed series, and aggregates that are not over a window."""
    windows, ahead = ("rolling", "expanding", "ewm"), ("bfill", "backfill", "interpolate")
    whole = ("mean", "std", "var", "max", "min", "sum", "median", "quantile", "rank", "skew", "kurt")

    def negative(x: ast.expr) -> bool:
        return isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub)

    def over_window(x: ast.expr) -> bool:
        return isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in windows

    def leaks(x: ast.AST, frames: set[str]) -> bool:
        if isinstance(x, ast.Slice):
            return x.step is not None and negative(x.step)
        if not isinstance(x, ast.Call) or not isinstance(x.func, ast.Attribute):
            return False
        name, on = x.func.attr, x.func.value
        given = {k.arg: k.value for k in x.keywords}
        if name in ahead or name in ("shift", "diff", "pct_change") and any(map(negative, [*x.args[:1], *(v for k, v in given.items() if k == "periods")])):
            return True
        if any(k in given and isinstance(given[k], ast.Constant) and given[k].value in (True, "bfill", "backward") for k in ("center", "method", "limit_direction")):
            return True
        windowed = over_window(on) or isinstance(on, ast.Name) and on.id in frames
        return name in whole and not windowed and "axis" not in given and not (isinstance(on, ast.Name) and on.id == "np")

    found = []
    for f in ast.walk(ast.parse(inspect.getsource(module))):
        if isinstance(f, ast.FunctionDef):
            frames = {t.id for x in ast.walk(f) if isinstance(x, ast.Assign) and over_window(x.value) for t in x.targets if isinstance(t, ast.Name)}
            if any(leaks(x, frames) for x in ast.walk(f)):
                found.append(f.name)
    return found


def canary(bars: DataFrame, names: list[str] | None = None, tail: int = 12, tolerance: float = 1e-7) -> DataFrame:
    """(column, changed): how many earlier values change when the last `tail` bars of each symbol are tampered with."""
    names = [n for n in (names or feature_names()) if n != "D_is_warmup"]
    ordinal = F.expr("row_number() OVER (PARTITION BY symbol ORDER BY session DESC)")
    marked = bars.withColumn("_back", ordinal)
    factor = 0.5 + (F.abs(F.xxhash64("symbol", "session")) % 1500) / F.lit(1000.0)
    late = F.col("_back") <= tail
    spoiled = marked.select("symbol", "session", *(F.when(late, F.col(c) * factor).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")))
    early = marked.filter(~late).select("symbol", "session")
    a = features(bars, names, keep=("symbol", "session")).join(early, ["symbol", "session"], "left_semi")
    b = features(spoiled, names, keep=("symbol", "session")).select("symbol", "session", *(F.col(n).alias(f"_{n}") for n in names))
    both = a.join(b, ["symbol", "session"])
    kinds = dict(a.dtypes)

    def differs(n: str):
        x, y = F.col(n), F.col(f"_{n}")
        if kinds[n] == "string":
            return ~x.eqNullSafe(y)
        return (x.isNull() != y.isNull()) | (F.coalesce(F.abs(x - y), F.lit(0.0)) > tolerance)

    counted = both.agg(*(F.count_if(differs(n)).alias(n) for n in names))
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return counted.select(F.expr(f"stack({len(names)}, {pairs}) AS (column, changed)"))


def prevalence(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, distinct values, the most frequent value with its share, and the share of nulls."""
    long = frame.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    known = F.col("value").isNotNull()
    return counted.groupBy("column").agg(
        total.alias("n_rows"),
        F.count_if(known).alias("n_unique"),
        F.max_by("value", F.when(known, F.struct(F.col("n"), F.col("value")))).alias("modal_value"),
        (F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)) / total).alias("modal_share"),
        (F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / total).alias("null_share"),
    )


def assert_unknowns_kept(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("D_roll",)) -> None:
    """Refuses a step that has turned unknown values into known ones: fewer nulls after it than before."""
    own = [c for c in columns if c in before.columns and c in after.columns]
    was, now = ({r["column"]: r.nulls for r in null_census(x, own).collect()} if own else {} for x in (before, after))
    if filled := [f"{c}: {was[c] - now[c]}" for c in own if now[c] < was[c]]:
        raise ValueError(f"unknown values were filled: {', '.join(filled)}")


def null_census(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls): for checking that unknown values stay unknown from one step to the next."""
    counted = frame.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counted.select(F.expr(f"stack({len(columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, `{c}`' for c in columns)}) AS (column, nulls)"))
