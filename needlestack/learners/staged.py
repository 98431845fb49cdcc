"""Metrics of every boosting round from one scan, as sums that merge.

Each task folds its rows into one set of sums a round (rows, weight, losses, confusion
cells) and, where an area is asked for, into counts of the distinct scores of a round.
Sums of tasks are added by Spark, so what moves has a row per task and round, never a
row per row and round; 1,000 rounds cost one scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.curves import auc_of_steps, precision_of_steps, steps_of_counts
from ..sources.scratch import materialize
from .trees import tree_nodes

CELLS = ["tn", "fp", "fn", "tp"]
SUMS = ["n", "w", "loss", "deviance", *CELLS]
#: Rows times rounds that a task holds at a time.
CHUNK = 4_000_000


class Leaves:
    """Leaf values of all trees in one array, weighted, and where each tree's begin."""

    def __init__(self, model):
        nodes = tree_nodes(model).where(F.col("left").isNull()).select("tree", "node", "prediction")
        rows = nodes.orderBy("tree", "node").toArrow()          # the size of the model, which the driver holds anyway
        tree = rows.column("tree").to_numpy()
        self.values = rows.column("prediction").to_numpy() * np.array(model.treeWeights)[tree]
        self.begin = np.searchsorted(tree, np.arange(len(model.treeWeights)))

    def scores(self, leaf: np.ndarray) -> np.ndarray:
        """Probabilities after each round, rows x rounds, from leaf numbers (rows x trees)."""
        margin = np.cumsum(self.values[self.begin + leaf], axis=1)
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def with_leaves(model, df: DataFrame, keep: Sequence) -> DataFrame:
    """The kept columns and `__leaf`, the leaf of each tree a row falls in."""
    leafy = model.copy().setLeafCol("__leaf").transform(df)
    return leafy.select(*keep, vector_to_array("__leaf").alias("__leaf"))


def _fold(y: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of some rows, a column a round."""
    q = np.clip(p, 1e-15, 1 - 1e-15)
    loss = np.where(y[:, None] == 1, -np.log(q), -np.log1p(-q))
    hit, yes = p > 0.5, (y == 1)[:, None]
    rounds = p.shape[1]
    return np.stack([np.full(rounds, len(y)), np.full(rounds, w.sum()), loss.sum(axis=0), 2 * (w[:, None] * loss).sum(axis=0),
                     (~hit & ~yes).sum(axis=0), (hit & ~yes).sum(axis=0), (~hit & yes).sum(axis=0), (hit & yes).sum(axis=0)])


def _counted(y: np.ndarray, p: np.ndarray) -> Iterator[pd.DataFrame]:
    """Distinct scores of each round with their positives and negatives."""
    for i in range(p.shape[1]):
        value, at = np.unique(p[:, i], return_inverse=True)
        pos = np.bincount(at, weights=y == 1, minlength=len(value)).astype(np.int64)
        yield pd.DataFrame({"iteration": i + 1, "p": value, "pos": pos,
                            "neg": np.bincount(at, minlength=len(value)) - pos})


class StagedMetrics:
    """Metrics of every round of a boosted model over a labelled frame, by group."""

    def __init__(self, model, df: DataFrame, label: str, by: Sequence[str] = (), areas: bool = False):
        self.by, weight = list(by), F.lit(1.0)
        if model.isDefined(model.weightCol) and model.getWeightCol() in df.columns:
            weight = F.col(model.getWeightCol())
        held = df.sparkSession.sparkContext.broadcast(Leaves(model))
        rows = with_leaves(model, df.where(F.col(label).isNotNull()),
                           [*self.by, F.col(label).cast("double").alias("__y"), weight.cast("double").alias("__w")])
        groups = [T.StructField(f.name, f.dataType) for f in df.select(*self.by).schema] if self.by else []
        schema = T.StructType([*groups, *T.StructType.fromDDL(
            "iteration int, p double, pos long, neg long, " + ", ".join(f"{c} double" for c in SUMS))])
        names, columns = self.by, schema.names

        def whole(part: pd.DataFrame, key) -> pd.DataFrame:
            return part.assign(**dict(zip(names, key))).reindex(columns=columns)

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            leaves, sums = held.value, {}
            step = max(1, CHUNK // len(leaves.begin))
            for pdf in batches:
                groups = pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]
                for key, group in groups:
                    key = key if isinstance(key, tuple) else (key,)
                    key = tuple(None if pd.isna(k) else k for k in key)
                    for at in range(0, len(group), step):
                        part = group.iloc[at:at + step]
                        y, w = part["__y"].to_numpy(), part["__w"].to_numpy()
                        # One long array, then rows x trees: numpy takes far longer to stack small arrays.
                        leaf = np.concatenate(part["__leaf"].to_numpy()).reshape(len(part), -1)
                        p = leaves.scores(leaf.astype(np.int64))
                        own = _fold(y, w, p)
                        sums[key] = sums[key] + own if key in sums else own
                        if areas:
                            yield whole(pd.concat(_counted(y, p)), key)
            for key, own in sums.items():
                made = pd.DataFrame(own.T, columns=SUMS)
                made.insert(0, "iteration", np.arange(1, len(made) + 1))
                yield whole(made, key)

        table = rows.mapInPandas(fold, schema)
        # Sums and counts come from the same scan, so it is written where both are read.
        table = materialize(table, "staged") if areas else table
        self.sums = table.where(F.col("p").isNull()).groupBy(*self.by, "iteration").agg(
            *[F.sum(c).alias(c) for c in SUMS])
        self._counts, self._areas = table.where(F.col("p").isNotNull()), areas
        self._steps: DataFrame | None = None

    def _stepped(self) -> DataFrame:
        if not self._areas:
            raise ValueError("areas need the scores counted: StagedMetrics(..., areas=True)")
        if self._steps is None:
            by = [*self.by, "iteration"]
            counts = self._counts.groupBy(*by, F.col("p").alias("threshold")).agg(
                F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            self._steps = steps_of_counts(materialize(counts, "staged_counts"), by)
        return self._steps

    def metric(self, name: str) -> DataFrame:
        """(by..., iteration, value)."""
        by = [*self.by, "iteration"]
        if name == "auc":
            return auc_of_steps(self._stepped(), by).select(*by, F.col("roc_auc").alias("value"))
        if name == "map":
            return precision_of_steps(self._stepped(), by).select(*by, F.col("average_precision").alias("value"))
        wrong, twice = F.col("fp") + F.col("fn"), 2.0 * F.col("tp")
        values = {"logloss": F.try_divide("loss", "n"), "error": F.try_divide(wrong, F.col("n")),
                  "f1": 1.0 - F.coalesce(F.try_divide(twice, twice + wrong), F.lit(0.0)),
                  "deviance": F.try_divide("deviance", "w")}
        if name not in values:
            raise ValueError(f"unknown metric {name!r}")
        return self.sums.select(*by, values[name].alias("value"))

    def cells(self) -> DataFrame:
        """(by..., iteration, tn, fp, fn, tp) of the score cut at 0.5."""
        return self.sums.select(*self.by, "iteration", *[F.col(c).cast("long").alias(c) for c in CELLS])
