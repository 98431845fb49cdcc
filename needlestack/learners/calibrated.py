"""Sigmoid calibration of scores, alone and with k-fold clones of a classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..inflight import in_flight
from ..operators.split import stratified_folds
from ..sources.scratch import materialize
from .scores import score
from .stored import StoredModel, read_part, write_part


def sigmoid_fit(df: DataFrame, label: str, p: str, max_iter: int = 100,
                tol: float = 1e-9) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve of label on score.

    Targets are softened to (n1 + 1)/(n1 + 2) and 1/(n0 + 2) (Platt, 1999): every row
    stands as a positive and a negative with those shares as weights.
    """
    rows = df.where(F.col(p).isNotNull()).select(
        F.col(p).cast("double").alias("s"), (F.col(label) == 1).alias("y"))
    n = rows.agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0")).first()
    target = F.when(F.col("y"), F.lit((n["n1"] + 1.0) / (n["n1"] + 2.0))).otherwise(
        F.lit(1.0 / (n["n0"] + 2.0)))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), (1.0 - target).alias("weight"))))
    pairs = rows.select("s", both.alias("t")).select("s", "t.label", "t.weight")
    # Equal scores collapse before the fit: its passes then read distinct scores only.
    pairs = pairs.groupBy("s", "label").agg(F.sum("weight").alias("weight"))
    data = VectorAssembler(inputCols=["s"], outputCol="features").transform(pairs)
    m = LogisticRegression(weightCol="weight", maxIter=max_iter, tol=tol, regParam=0.0).fit(data)
    return float(m.coefficients[0]), float(m.intercept)


def sigmoid_apply(p: Column, slope: float, intercept: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * p + F.lit(intercept))))


class SigmoidCalibrated(Estimator):
    """k clones of a classifier, each calibrated on the fold it did not see; scores average."""

    def __init__(self, classifier=None, label: str = "label", id_col: str = "row_id", k: int = 3,
                 seed: int = 1):
        super().__init__()
        self.classifier, self.label, self.id_col, self.k, self.seed = classifier, label, id_col, k, seed

    def copy(self, extra=None):
        return SigmoidCalibrated(self.classifier.copy(), self.label, self.id_col, self.k, self.seed)

    def _fit(self, dataset: DataFrame) -> "SigmoidCalibratedModel":
        folds = materialize(stratified_folds(dataset.drop("seed", "fold"), self.label, self.id_col,
                                             self.k, [self.seed]), "calibration")

        def one(f):
            model = self.classifier.copy().fit(folds.where(F.col("fold") != f))
            held = score(model, folds.where(F.col("fold") == f), "__p").select(self.label, "__p")
            return model, *sigmoid_fit(held, self.label, "__p")

        return SigmoidCalibratedModel(in_flight(one, range(self.k)))


class SigmoidCalibratedModel(Model, StoredModel):
    def __init__(self, members=()):
        super().__init__()
        self.members = list(members)

    def _store(self, spark, path: str) -> None:
        curves = [(i, slope, intercept) for i, (_, slope, intercept) in enumerate(self.members)]
        spark.createDataFrame(curves, "member int, slope double, intercept double").coalesce(1).write.parquet(f"{path}/curves")
        for i, (model, _, _) in enumerate(self.members):
            write_part(spark, model, f"{path}/member_{i}")

    @classmethod
    def _restore(cls, spark, path: str, settings: dict) -> "SigmoidCalibratedModel":
        curves = spark.read.parquet(f"{path}/curves").orderBy("member").collect()
        return cls([(read_part(spark, f"{path}/member_{r['member']}"), r["slope"], r["intercept"]) for r in curves])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, (model, slope, intercept) in enumerate(self.members):
            out = score(model, out, f"__c{i}").withColumn(
                f"__c{i}", sigmoid_apply(F.col(f"__c{i}"), slope, intercept))
        parts = [F.col(f"__c{i}") for i in range(len(self.members))]
        mean = reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts)))
        return (out.withColumn("__p", mean)
                .withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p"))))
                .withColumn("prediction", (F.col("__p") > 0.5).cast("double"))
                .drop("__p", *[f"__c{i}" for i in range(len(parts))]))
