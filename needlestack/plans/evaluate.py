"""Cross-validated scores, out-of-fold tables and learning curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..inflight import PARALLELISM, in_flight
from ..learners.scores import score
from ..operators import metrics
from ..operators.curves import average_precision, roc_auc
from ..operators.split import stratified_split, train_subsets
from ..sources.scratch import materialize


def oof_predict(estimator, df: DataFrame, fold: str, k: int, label: str,
                keep: Sequence[str] = (), parallelism: int = PARALLELISM) -> DataFrame:
    """(keep..., fold, label, p): every row scored by the model that did not see its fold.

    The union of the fold scores is written once, so metrics never run a model again.
    """
    def one(f):
        model = estimator.copy().fit(df.where(F.col(fold) != f))
        return score(model, df.where(F.col(fold) == f), "p").select(*keep, fold, label, "p")

    return materialize(reduce(DataFrame.unionByName, in_flight(one, range(k), parallelism)), "oof")


def metric_value(df: DataFrame, metric: str | Callable, label: str, p: str = "p",
                 by: Sequence[str] = (), t: float = 0.5) -> DataFrame:
    """`value` of f1, f1_weighted, accuracy, roc_auc, ap, logloss or a user aggregate."""
    if callable(metric):
        return metrics.custom_metric(df, metric, label, p, by)
    z = df.withColumn("__z", (F.col(p) > t).cast("int"))
    if metric == "f1":
        return metrics.prf(metrics.confusion(z, label, "__z", by)).select(
            *by, F.coalesce("f1", F.lit(0.0)).alias("value"))
    table = {
        "f1_weighted": (lambda: metrics.weighted_f1(z, label, "__z", by), "weighted_f1"),
        "accuracy": (lambda: metrics.accuracy(z, label, "__z", by), "accuracy"),
        "roc_auc": (lambda: roc_auc(df, label, p, by), "roc_auc"),
        "ap": (lambda: average_precision(df, label, p, by), "average_precision"),
        "logloss": (lambda: metrics.log_loss(df, label, p, by), "log_loss"),
    }
    make, name = table[metric]
    return make().select(*by, F.col(name).alias("value"))


def cv_score(estimator, df: DataFrame, fold: str, k: int, label: str, metric="f1",
             how: str = "pool") -> DataFrame:
    """One row (value, std, n). pool: one metric over all out-of-fold rows. mean: per fold."""
    oof = oof_predict(estimator, df, fold, k, label)
    if how == "pool":
        return metric_value(oof, metric, label).select(
            "value", F.lit(0.0).alias("std"), F.lit(1).cast("long").alias("n"))
    per = metric_value(oof, metric, label, by=[fold])
    return metrics.summarise_scores(per, "value").withColumnRenamed("mean", "value")


def fold_scores(estimator, df: DataFrame, fold: str, k: int, label: str, metric="f1") -> DataFrame:
    """(fold, value)."""
    return metric_value(oof_predict(estimator, df, fold, k, label), metric, label, by=[fold])


def learning_curve(estimator, df: DataFrame, label: str, id_col: str,
                   fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), reps: int = 5,
                   test_size: float = 0.25, metric="f1", seed: int = 1,
                   parallelism: int = PARALLELISM) -> DataFrame:
    """(fraction, train_mean, train_std, test_mean, test_std) over repeated splits.

    Train subsets of one repetition are nested prefixes of the same order.
    """
    def ordered(r):
        halves = stratified_split(df, label, id_col, test_size, seed + r).drop("seed")
        train = train_subsets(halves.where(F.col("split") == "train"), label, id_col, fractions, seed + r)
        test = halves.where(F.col("split") == "test")
        return materialize(train.unionByName(test, allowMissingColumns=True), "curve_rows")

    rows = in_flight(ordered, range(reps), parallelism)

    def one(job):
        r, f = job
        subset = rows[r].where(F.col("min_fraction") <= f)
        model = estimator.copy().fit(subset)
        # Test rows are in no subset, so one pass scores both parts.
        both = rows[r].where((F.col("split") == "test") | (F.col("min_fraction") <= f))
        return score(model, both, "p").select(
            F.lit(float(f)).alias("fraction"), F.lit(r).alias("rep"), F.col("split").alias("part"),
            F.col(label), "p")

    jobs = [(r, f) for r in range(reps) for f in fractions]
    parts = reduce(DataFrame.unionByName, in_flight(one, jobs, parallelism))
    scored = materialize(parts, "learning")
    per = metric_value(scored, metric, label, by=["fraction", "rep", "part"])
    pick = lambda part, agg: agg(F.when(F.col("part") == part, F.col("value")))
    return per.groupBy("fraction").agg(
        pick("train", F.avg).alias("train_mean"), pick("train", F.stddev_pop).alias("train_std"),
        pick("test", F.avg).alias("test_mean"), pick("test", F.stddev_pop).alias("test_std"))


def compare_models(scored: DataFrame, label: str, model: str = "model", p: str = "p",
                   t: float = 0.5) -> DataFrame:
    """(model, accuracy, precision, recall, f1, roc_auc, average_precision) side by side."""
    z = scored.withColumn("__z", (F.col(p) > t).cast("int"))
    by = [model]
    out = metrics.prf(metrics.confusion(z, label, "__z", by)).select(model, "precision", "recall", "f1")
    for other in (metrics.accuracy(z, label, "__z", by).select(model, "accuracy"),
                  roc_auc(scored, label, p, by), average_precision(scored, label, p, by)):
        out = out.join(other, model)
    return out


def importance_sweep(make, train: DataFrame, test: DataFrame, importances: DataFrame,
                     label: str) -> DataFrame:
    """(threshold, n, accuracy, f1): refit on the features at or above each importance.

    `make(cols)` builds an estimator over those columns. One fit per distinct importance.
    """
    imp = importances.orderBy("importance", "feature").collect()      # one row per feature

    def one(t):
        cols = [r["feature"] for r in imp if r["importance"] >= t]
        z = score(make(cols).fit(train), test, "p")
        acc = metric_value(z, "accuracy", label).first()["value"]
        f1 = metric_value(z, "f1", label).first()["value"]
        return float(t), len(cols), float(acc), float(f1)

    rows = in_flight(one, sorted({r["importance"] for r in imp}))
    return train.sparkSession.createDataFrame(rows, "threshold double, n int, accuracy double, f1 double")


def select_by_importance(df: DataFrame, importances: DataFrame, t: float, *keep: str) -> DataFrame:
    """The kept columns and the features whose importance reaches t."""
    cols = [r["feature"] for r in importances.where(F.col("importance") >= t).collect()]
    return df.select(*keep, *[c for c in df.columns if c in set(cols)])
