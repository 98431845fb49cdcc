"""Stacking: base scores join the original features of a meta learner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F

from ..inflight import in_flight
from ..operators.split import stratified_split
from ..sources.scratch import materialize
from .scores import score
from .stored import StoredModel, read_part, write_part


class Stacking(Estimator):
    """Fits base pipelines on half the rows and the meta learner on the other half.

    `meta` is a pipeline over named columns: the original features plus one score per
    base, as `stacked_columns` lists them. Base scores are written once, so the frame
    from `fit_bases` feeds any number of meta trials without refitting bases.
    """

    def __init__(self, bases: Sequence = (), meta=None, label: str = "label", id_col: str = "row_id", share: float = 0.5, seed: int = 1):
        super().__init__()
        self.bases, self.meta = list(bases), meta
        self.label, self.id_col, self.share, self.seed = label, id_col, share, seed

    def copy(self, extra=None):
        return Stacking([b.copy() for b in self.bases], self.meta.copy(), self.label, self.id_col,
                        self.share, self.seed)

    def fit_bases(self, dataset: DataFrame) -> tuple[list, DataFrame]:
        """Fitted bases and the scored second half, written once."""
        halves = materialize(stratified_split(dataset.drop("seed", "split"), self.label, self.id_col,
                                              self.share, self.seed), "halves")
        first = halves.where(F.col("split") == "train")
        second = halves.where(F.col("split") == "test").drop("split", "seed")
        models = in_flight(lambda b: b.fit(first), self.bases)
        return models, materialize(_add_scores(models, second), "stacked")

    def _fit(self, dataset: DataFrame) -> "StackingModel":
        models, stacked = self.fit_bases(dataset)
        return StackingModel(models, self.meta.fit(stacked))


def stacked_columns(features: Sequence[str], bases: Sequence) -> list[str]:
    """Columns a meta learner sees."""
    return [*features, *[f"base_{i}" for i in range(len(bases))]]


def _add_scores(models, df: DataFrame) -> DataFrame:
    for i, m in enumerate(models):
        df = score(m, df, f"base_{i}")
    return df


class StackingModel(Model, StoredModel):
    def __init__(self, models=(), meta=None):
        super().__init__()
        self.models, self.meta = list(models), meta

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.meta.transform(_add_scores(self.models, dataset))

    def _settings(self) -> dict:
        return {"bases": len(self.models)}

    def _store(self, spark, path: str) -> None:
        for i, m in enumerate(self.models):
            write_part(spark, m, f"{path}/base_{i}")
        write_part(spark, self.meta, f"{path}/meta")

    @classmethod
    def _restore(cls, spark, path: str, settings: dict) -> "StackingModel":
        bases = [read_part(spark, f"{path}/base_{i}") for i in range(settings["bases"])]
        return cls(bases, read_part(spark, f"{path}/meta"))

    @classmethod
    def load(cls, path: str, n_bases: int | None = None) -> "StackingModel":
        """`n_bases` is written with the model; callers that still name it may."""
        return super().load(path)
