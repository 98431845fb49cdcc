"""Radial-basis support vectors at scale: random Fourier features and a linear machine.

Follows Rahimi & Recht, "Random Features for Large-Scale Kernel Machines", 2007. It
approximates the kernel machine and never equals it exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from .linear import total_weight


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """z = sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma), so z.z' estimates exp(-gamma |x-x'|^2)."""

    inputCol = Param(Params._dummy(), "inputCol", "input", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features D", TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "number of inputs", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="fourier", gamma=0.1, size=128, dim=1, seed=1):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=float(gamma), size=size, dim=dim,
                  seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = lambda p: self.getOrDefault(getattr(self, p))
        size, rng = get("size"), np.random.default_rng(get("seed"))
        w = rng.normal(0.0, np.sqrt(2.0 * get("gamma")), (get("dim"), size))
        b = rng.uniform(0.0, 2.0 * np.pi, size)

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(np.array(x.tolist()) @ w + b)))

        lifted = lift(vector_to_array(get("inputCol")))
        return dataset.withColumn(get("outputCol"), array_to_vector(lifted))


class RbfSVC(Estimator):
    """Weighted radial-basis classifier: Fourier features, then a linear hinge machine.

    The penalty follows the same 1 / (C * sum of weights) rule as the logistic learner.
    """

    @keyword_only
    def __init__(self, *, C=1.0, gamma=0.1, size=128, featuresCol="features", labelCol="label",
                 weightCol=None, maxIter=100, seed=1):
        super().__init__()
        self.args = dict(C=C, gamma=gamma, size=size, featuresCol=featuresCol, labelCol=labelCol,
                         weightCol=weightCol, maxIter=maxIter, seed=seed)

    def copy(self, extra=None):
        return RbfSVC(**self.args)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        a = self.args
        dim = len(dataset.select(a["featuresCol"]).first()[0])
        lift = FourierFeatures(inputCol=a["featuresCol"], gamma=a["gamma"], size=a["size"], dim=dim,
                               seed=a["seed"])
        svc = LinearSVC(featuresCol="fourier", labelCol=a["labelCol"], maxIter=a["maxIter"],
                        standardization=False,
                        regParam=1.0 / (a["C"] * total_weight(dataset, a["weightCol"])))
        if a["weightCol"]:
            svc = svc.setWeightCol(a["weightCol"])
        return PipelineModel([lift, svc.fit(lift.transform(dataset))])
