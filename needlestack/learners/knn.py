"""Nearest-neighbour classifier over a distributed training table."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.neighbor_index import NeighborIndex
from ..operators.neighbors import inverse_distance
from .stored import StoredModel


class KNNClassifier(Estimator):
    """Inverse-distance vote of the k nearest training rows; distance 0 decides alone.

    Fitting writes a neighbour index; scoring is an exact search in it, which runs nothing of
    the training side again, and an equi-join back on the id. `index.path` reopens a model.
    """

    def __init__(self, k: int = 5, featuresCol: str = "features", labelCol: str = "label",
                 idCol: str = "row_id"):
        super().__init__()
        self.k, self.featuresCol, self.labelCol, self.idCol = k, featuresCol, labelCol, idCol

    def _fit(self, dataset: DataFrame) -> "KNNClassificationModel":
        train = dataset.select(
            F.col(self.idCol).alias("id"), vector_to_array(self.featuresCol).alias("vec"),
            F.col(self.labelCol).cast("double").alias("y"))
        index = NeighborIndex.build(train, "vec", "id", ["y"])
        return KNNClassificationModel(index, self.k, self.featuresCol, self.idCol)


class KNNClassificationModel(Model, StoredModel):
    """Scores from the index; a written model holds a copy of it and reads that copy."""

    def __init__(self, index: NeighborIndex | None = None, k: int = 5, featuresCol: str = "features",
                 idCol: str = "row_id"):
        super().__init__()
        self.index, self.k, self.featuresCol, self.idCol = index, k, featuresCol, idCol

    def _settings(self) -> dict:
        return {"k": self.k, "featuresCol": self.featuresCol, "idCol": self.idCol}

    def _store(self, spark, path: str) -> None:
        self.index.copy_to(f"{path}/index")

    @classmethod
    def _restore(cls, spark, path: str, settings: dict) -> "KNNClassificationModel":
        return cls(NeighborIndex(spark, f"{path}/index"), **settings)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        query = dataset.select(F.col(self.idCol).alias("id"),
                               vector_to_array(self.featuresCol).alias("vec"))
        near = self.index.search(query, self.k, "vec", "id", payload=["y"])
        votes = inverse_distance(near, "y", "__p").withColumnRenamed("query_id", self.idCol)
        return (dataset.join(votes, self.idCol)
                .withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p"))))
                .withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p"))
