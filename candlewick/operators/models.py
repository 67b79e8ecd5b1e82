"""Walk-forward evaluation of model families with Spark ML: fit, calibrate, score, and keep what is done.

Families: logistic regression, gradient-boosted trees, and random forests for randomised trees.  Ranking objectives have
no counterpart in Spark ML; a ranking experiment scores with pointwise trees and is judged by each session's order.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.config import SEED
from candlewick.operators import metrics, splits
from candlewick.sources.files import json_hash, read_json, save_predictions, write_json


@dataclass(frozen=True)
class Experiment:
    name: str
    family: str  # logistic, boosted, forest, ranked
    features: tuple[str, ...]
    target: str
    max_depth: int = 3
    trees: int = 20

    def signature(self, panel: str = "") -> str:
        return json_hash({**self.__dict__, "panel": panel})


def preprocess(features: tuple[str, ...], linear: bool) -> list:
    """Medians of the fitted rows for missing values; trees also see what was missing, linear models see unit scales."""
    filled = [f"{f}__filled" for f in features]
    stages: list = [Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.001)]
    inputs = filled if linear else [*filled, *(f"{f}__missing" for f in features)]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_vector", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True) if linear else VectorAssembler(inputCols=["raw_vector"], outputCol="vector"))
    return stages


def prepare(rows: DataFrame, features: tuple[str, ...], target: str) -> DataFrame:
    """Rows with a known target, infinities as nulls, and a mark for every missing value.

    A feature without any value in the fitted rows would have no median; it counts as 0.
    """
    known = rows.filter(F.col(target).isNotNull())
    clean = {f: F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")) for f in features}
    return known.select(
        "symbol", "session", F.col(target).cast("double").alias("y"), *(c.alias(f) for f, c in clean.items()), *(c.isNull().cast("double").alias(f"{f}__missing") for f, c in clean.items())
    )


def fit(rows: DataFrame, e: Experiment) -> PipelineModel:
    linear = e.family == "logistic"
    common = {"featuresCol": "vector", "labelCol": "y"}
    model = {
        "logistic": lambda: LogisticRegression(**common, maxIter=50, regParam=0.01),
        "forest": lambda: RandomForestClassifier(**common, numTrees=e.trees, maxDepth=e.max_depth, seed=SEED),
        "boosted": lambda: GBTClassifier(**common, maxIter=e.trees, maxDepth=e.max_depth, seed=SEED),
        "ranked": lambda: GBTClassifier(**common, maxIter=e.trees, maxDepth=e.max_depth, seed=SEED),
    }[e.family]()
    usable = rows.agg(*(F.count(f).alias(f) for f in e.features)).first()
    features = tuple(f for f in e.features if usable[f])
    if not features:
        raise ValueError("no feature has a value in the fitted rows")
    return Pipeline(stages=[*preprocess(features, linear), model]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(symbol, session, y, raw_score): the probability of 1."""
    return model.transform(rows).select("symbol", "session", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("raw_score"))


def calibrate(fitted_on: DataFrame, rows: DataFrame) -> DataFrame:
    """`p_cal` from an isotonic fit of y on raw_score; beyond the fitted range it stays at the ends.

    With one class only, the raw score is clipped instead.
    """
    if fitted_on.select("y").distinct().limit(2).count() < 2:
        return rows.withColumn("p_cal", F.greatest(F.least(F.col("raw_score"), F.lit(1.0)), F.lit(0.0)))
    iso = IsotonicRegression(featuresCol="raw_score", labelCol="y", predictionCol="p_cal").fit(fitted_on.select("raw_score", F.col("y").cast("double").alias("y")))
    return iso.transform(rows)


def run_fold(panel: DataFrame, e: Experiment, fold: dict, inner: dict) -> DataFrame:
    """Predictions of one fold's test window, calibrated on the tail of its training window."""
    rows = prepare(panel, e.features, e.target)
    s = F.col("session")
    model = fit(rows.filter((s >= F.lit(fold["train_start"])) & (s <= F.lit(inner["fit_end"]))), e)
    held = score(model, rows.filter((s >= F.lit(inner["cal_start"])) & (s <= F.lit(fold["train_end"]))))
    test = score(model, rows.filter((s >= F.lit(fold["test_start"])) & (s <= F.lit(fold["test_end"]))))
    return calibrate(held, test).withColumn("fold", F.lit(int(fold["fold"]))).withColumn("experiment", F.lit(e.name))


def fold_metrics(predictions: DataFrame, hurdle: float = 0.5) -> DataFrame:
    """(experiment, fold, n, base_rate, mean_score, brier, logloss, auc, clears) with the best row of each session against the hurdle."""
    by = ["experiment", "fold"]
    first = predictions.withColumn("_k", F.struct(*by))
    best = (
        metrics.ranked(first.withColumn("session", F.struct("_k", "session")), "p_cal")
        .filter("rank = 1").groupBy(*by).agg(F.avg(F.col("y").cast("double")).alias("r"), F.count(F.lit(1)).alias("m"))
        .select(*by, (F.col("r") - 2 * F.sqrt(F.col("r") * (1 - F.col("r")) / F.col("m")) > hurdle).alias("clears"))
    )
    return metrics.losses(predictions, by).join(metrics.auc(predictions, by, score="p_cal"), by).join(best, by)


def tournament(panel: DataFrame, experiments: Iterable[Experiment], out: str | None = None, n_splits: int = 5, budget_s: float | None = None, done: set[tuple[str, int]] = frozenset(), panel_signature: str = "") -> DataFrame:
    """Predictions of all experiments over all folds, in the order given, until the time budget is spent.

    Finished folds in `done` are skipped.  With `out`, each fold is written as it ends and noted beside it, so that the
    next run with the same `out` goes on where this one stopped; an experiment that is noted there with another signature
    (its settings, the number of folds, or `panel_signature`) is refused.
    """
    spark = panel.sparkSession
    experiments = list(experiments)
    state = (read_json(spark, f"{out}_state") if out else None) or {"signatures": {}, "done": []}
    signs = {e.name: e.signature(f"{panel_signature}/{n_splits}") for e in experiments}
    if changed := [n for n, s in signs.items() if state["signatures"].get(n, s) != s]:
        raise ValueError(f"stored with other settings: {', '.join(changed)}")
    state["signatures"].update(signs)
    done = {*done, *((n, f) for n, f in state["done"])}
    folds = splits.walk_forward(panel, n_splits).orderBy("fold").collect()
    frame = panel.sparkSession.createDataFrame(folds)
    inner = {r.fold: r.asDict() for r in splits.inner_split(panel, frame).collect()}
    began, every = time.monotonic(), None
    for e in experiments:
        for f in folds:
            if (e.name, f.fold) in done or f.fold not in inner:
                continue
            if budget_s is not None and time.monotonic() - began > budget_s:
                break
            got = run_fold(panel, e, f.asDict(), inner[f.fold])
            if out:
                save_predictions(got, out)
                state["done"].append([e.name, f.fold])
                write_json(spark, state, f"{out}_state")
            else:
                every = got if every is None else every.unionByName(got)
    if out:
        return panel.sparkSession.read.parquet(out)
    if every is None:
        raise ValueError("nothing was left to run")
    return every


def preflight(panel: DataFrame, e: Experiment, least_rows: int = 1_000) -> list[str]:
    """What stands against running an experiment."""
    lacking = [c for c in (*e.features, e.target) if c not in panel.columns]
    if lacking:
        return [f"missing column {c}" for c in lacking]
    n = panel.filter(F.col(e.target).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(e.target).alias("k")).first()
    return [f"only {n.n} labelled rows"] * (n.n < least_rows) + ["one class only"] * (n.k < 2)
