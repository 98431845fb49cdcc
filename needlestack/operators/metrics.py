"""Scores as DataFrames. Each is one aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

CELLS = ["tn", "fp", "fn", "tp"]


def _agg(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts tn, fp, fn, tp of 0/1 labels and predictions."""
    y, z = F.col(label) == 1, F.col(pred) == 1
    return _agg(df, by, F.count_if(~y & ~z).alias("tn"), F.count_if(~y & z).alias("fp"),
                F.count_if(y & ~z).alias("fn"), F.count_if(y & z).alias("tp"))


def pooled(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of confusion matrices over folds."""
    return _agg(cm, by, *[F.sum(c).alias(c) for c in CELLS])


def precision(tp="tp", fp="fp") -> Column:
    return F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fn))


def f_beta(beta: float = 1.0, tp="tp", fp="fp", fn="fn") -> Column:
    b2 = F.lit(float(beta) ** 2)
    hit = (1.0 + b2) * F.col(tp)
    return F.try_divide(hit, hit + b2 * F.col(fn) + F.col(fp))


def prf(cm: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; NULL where a denominator is zero."""
    return cm.withColumns({"precision": precision(), "recall": recall(), "f1": f_beta()})


def fbeta(df: DataFrame, label: str, pred: str, beta: float, by: Sequence[str] = ()) -> DataFrame:
    return confusion(df, label, pred, by).select(*by, f_beta(beta).alias("fbeta"))


def accuracy(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    hit = F.avg((F.col(label) == F.col(pred)).cast("double"))
    return _agg(df, by, hit.alias("accuracy"), (1.0 - hit).alias("error"))


def weighted_f1(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 of each class weighted by its number of rows."""
    cm = confusion(df, label, pred, by)
    one = F.coalesce(f_beta(), F.lit(0.0))
    zero = F.coalesce(f_beta(1.0, "tn", "fn", "fp"), F.lit(0.0))
    n1, n0 = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return cm.select(*by, F.try_divide(one * n1 + zero * n0, n1 + n0).alias("weighted_f1"))


def log_loss(df: DataFrame, label: str, p: str, by: Sequence[str] = (),
             eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood with the score clipped to [eps, 1 - eps]."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(p)))
    y = F.col(label)
    return _agg(df, by, F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))


def summarise_scores(scores: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of fold scores."""
    return _agg(scores, by, F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                F.count(value).alias("n"))


def custom_metric(df: DataFrame, metric: Callable[[Column, Column], Column], label: str, p: str,
                  by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """A user metric written as an aggregate expression of label and score."""
    return _agg(df, by, metric(F.col(label), F.col(p)).alias(name))


def f1_loss(label: Column, p: Column, t: float = 0.5) -> Column:
    """1 - F1 of the score cut at t, as an aggregate expression."""
    y, z = label == 1, p > t
    tp = F.count_if(y & z)
    wrong = F.count_if(y & ~z) + F.count_if(~y & z)
    return 1.0 - F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))
