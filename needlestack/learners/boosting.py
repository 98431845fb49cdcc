"""Histories of boosted models and early stopping by patience."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..inflight import in_flight
from ..operators.history import patience_rule
from ..operators.metrics import f1_loss
from .staged import Leaves, StagedMetrics, with_leaves

REFIT_FACTOR = 1.25
#: Metrics of a round, and whether more is better.
METRICS = {"logloss": False, "error": False, "f1": False, "deviance": False, "auc": True, "map": True}
AREAS = {"auc", "map"}


def staged_scores(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row and boosting round: keep..., iteration, p after that many trees."""
    held = df.sparkSession.sparkContext.broadcast(Leaves(model))

    @F.pandas_udf("array<double>")
    def staged(leaf: pd.Series) -> pd.Series:
        if not len(leaf):
            return pd.Series([], dtype=object)
        return pd.Series(list(held.value.scores(np.array(leaf.tolist()).astype(np.int64))))

    return with_leaves(model, df, keep).select(*keep, F.posexplode(staged("__leaf"))).select(
        *keep, (F.col("pos") + 1).alias("iteration"), F.col("col").alias("p"))


def round_metric(model, df: DataFrame, label: str, metric: str | Callable, by: list[str] | None = None) -> DataFrame:
    """(by..., iteration, value) of one metric; named ones merge per round, a user's aggregate sees rows x rounds."""
    by = list(by or [])
    metric = "f1" if metric is f1_loss else metric
    if callable(metric):
        staged = staged_scores(model, df, [*by, label])
        return staged.groupBy(*by, "iteration").agg(metric(F.col(label), F.col("p")).alias("value"))
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return StagedMetrics(model, df, label, by, areas=metric in AREAS).metric(metric)


def _together(datasets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The named frames as one, with their name in `dataset`."""
    return reduce(DataFrame.unionByName, [df.select(*[c for c in columns if c in df.columns], F.lit(name).alias("dataset"))
                                          for name, df in datasets.items()])


def _columns(model, label: str, datasets: dict[str, DataFrame]) -> list[str]:
    weight = [model.getWeightCol()] if model.isDefined(model.weightCol) else []
    held = all(c in df.columns for df in datasets.values() for c in weight)
    return list(dict.fromkeys([label, model.getFeaturesCol(), *(weight if held else [])]))


def training_history(model, datasets: dict[str, DataFrame], label: str,
                     metrics=("error", "auc", "logloss")) -> DataFrame:
    """(dataset, metric, iteration, value) for every round of a boosted model; one scan for all named metrics."""
    df = _together(datasets, _columns(model, label, datasets))
    named = ["f1" if m is f1_loss else m for m in metrics]
    kept = StagedMetrics(model, df, label, ["dataset"], areas=bool(AREAS.intersection(m for m in named if isinstance(m, str))))
    parts = []
    for m, title in zip(named, metrics):
        value = round_metric(model, df, label, m, ["dataset"]) if callable(m) else kept.metric(m)
        title = title if isinstance(title, str) else title.__name__
        parts.append(value.select("dataset", F.lit(title).alias("metric"), "iteration", "value"))
    return reduce(DataFrame.unionByName, parts)


def staged_deviance(model, datasets: dict[str, DataFrame], label: str) -> DataFrame:
    """(dataset, iteration, value): weighted mean loss per number of trees, twice the log loss; one scan."""
    df = _together(datasets, _columns(model, label, datasets))
    return StagedMetrics(model, df, label, ["dataset"]).metric("deviance")


def truncated(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The first n trees of a boosted model: what a fit with n rounds and the same seed would have made."""
    n = min(n, model.getNumTrees)
    if n < 1:
        raise ValueError("a boosted model has a tree at least")
    java, gateway = model._java_obj, SparkSession.builder.getOrCreate().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], float(model.treeWeights[i])
    cut = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        model.uid, trees, weights, model.numFeatures, model.numClasses))
    return model._copyValues(cut)._set(maxIter=n)


class EarlyStoppedGBT(Estimator):
    """Boosting that keeps the best round on held-out rows.

    Fits up to the learner's maxIter on rows where `valid` is false, reads the metric
    of every round on the other rows, applies the patience rule, and keeps that many
    trees. The model carries `best_n` and `history`.

    metric: logloss, error, f1 (as 1 - F1), deviance, auc, map, or a function of the label
    and score columns that returns an aggregate loss.
    """

    validCol = Param(Params._dummy(), "validCol", "held-out marker", TypeConverters.toString)
    patience = Param(Params._dummy(), "patience", "rounds without gain", TypeConverters.toInt)

    def __init__(self, learner=None, validCol: str = "valid", patience: int = 50,
                 metric: str | Callable[[Column, Column], Column] = "logloss"):
        super().__init__()
        self.learner, self.metric = learner, metric
        self._set(validCol=validCol, patience=patience)

    def _fit(self, dataset: DataFrame):
        valid = F.col(self.getOrDefault(self.validCol))
        train, held = dataset.where(~valid), dataset.where(valid)
        full = self.learner.fit(train)
        history = round_metric(full, held, self.learner.getLabelCol(), self.metric)
        rows = history.collect()                    # one row per round
        history = dataset.sparkSession.createDataFrame(rows, history.schema)
        best = patience_rule(history, self.getOrDefault(self.patience), larger_is_better=_larger(self.metric)).first()
        model = truncated(full, int(best["best_iteration"]))
        model.best_n, model.history = int(best["best_iteration"]), history
        return model


def _larger(metric) -> bool:
    return METRICS.get(metric, False) if isinstance(metric, str) else False


def refit(learner, df: DataFrame, best_n: int, factor: float = REFIT_FACTOR):
    """Fit on all rows with int(factor * best_n) rounds."""
    return learner.copy().setMaxIter(max(1, int(factor * best_n))).fit(df)


def boosting_cv(learner, df: DataFrame, fold: str, k: int, patience: int,
                metric: str | Callable = "map") -> tuple[DataFrame, DataFrame]:
    """Per-round metric of every fold, and the patience rule on its mean over folds."""
    label = learner.getLabelCol()

    def one(f):
        model = learner.fit(df.where(F.col(fold) != f))
        h = round_metric(model, df.where(F.col(fold) == f), label, metric)
        return h.select(F.lit(f).alias("fold"), "iteration", "value")

    parts = reduce(DataFrame.unionByName, in_flight(one, range(k)))
    history = df.sparkSession.createDataFrame(parts.collect(), parts.schema)   # k rows per round
    mean = history.groupBy("iteration").agg(F.avg("value").alias("value"))
    return history, patience_rule(mean, patience, larger_is_better=_larger(metric))


def fold_rounds(history: DataFrame, patience: int, metric: str | Callable = "map", fold: str = "fold") -> DataFrame:
    """(fold, best_iteration, best_value, last_iteration, stopped): the patience rule on each fold's history.

    The largest best_iteration is the round count of a refit on all rows."""
    return patience_rule(history, patience, [fold], larger_is_better=_larger(metric))
