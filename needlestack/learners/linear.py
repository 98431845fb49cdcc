"""Penalised logistic regression with class weights."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


def total_weight(df: DataFrame, weight: str | None) -> float:
    """Sum of weights, or the row count without a weight column."""
    return float(df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0])


class PenalisedLogistic(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """L2 logistic regression with penalty strength 1/C on the sum of weighted losses.

    Spark averages losses over the weights, so regParam is 1 / (C * sum of weights).
    The intercept is not penalised. Fitting is one distributed pass per iteration.
    """

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "tolerance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=1.0, featuresCol="features", labelCol="label", weightCol=None,
                 maxIter=300, tol=1e-5):
        super().__init__()
        given = dict(C=float(C), featuresCol=featuresCol, labelCol=labelCol, maxIter=maxIter,
                     tol=float(tol))
        if weightCol:
            given["weightCol"] = weightCol
        self._set(**given)

    def _fit(self, dataset: DataFrame):
        get = lambda p: self.getOrDefault(getattr(self, p))
        weight = get("weightCol") if self.isSet(self.weightCol) else None
        lr = LogisticRegression(
            featuresCol=get("featuresCol"), labelCol=get("labelCol"), standardization=False,
            regParam=1.0 / (get("C") * total_weight(dataset, weight)), elasticNetParam=0.0,
            maxIter=get("maxIter"), tol=get("tol"), family="binomial")
        if weight:
            lr = lr.setWeightCol(weight)
        return lr.fit(dataset)
