"""Trees, forests and boosting behind the parameter names users bring."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, RandomForestClassifier,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import scratch_path

# How outside parameter names map onto Spark's.
TREE_NAMES = {
    "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "criterion": "impurity",
    "min_weight_fraction_leaf": "minWeightFractionPerNode", "seed": "seed", "max_bins": "maxBins",
}
FOREST_NAMES = {**TREE_NAMES, "n_estimators": "numTrees", "subsample": "subsamplingRate"}
BOOST_NAMES = {
    **{k: v for k, v in FOREST_NAMES.items() if k != "criterion"}, "n_estimators": "maxIter",
    "learning_rate": "stepSize", "min_child_weight": "minWeightFractionPerNode",
}
# gamma is a gain of another scale than minInfoGain: copied over, it would leave trees of one node.
NOT_MAPPED = ["gamma", "reg_alpha", "reg_lambda", "max_delta_step", "min_samples_split", "colsample_bytree"]
WEIGHT_NAMES = ["scale_pos_weight", "class_weight"]
MAX_DEPTH = 30
#: Bytes of training rows that a task of a fit holds or reads at a time, and of a row besides its features and tree counts.
TASK_BYTES, ROW_BYTES = 128_000_000, 150


class _BoundedTasks:
    """A tree learner whose training rows are dealt out evenly where a task's share could be large.

    Each level of each tree reads the cached rows, a partition a task; partitions of a scan hold as many rows as
    fit in a file split, however small they are there. `n_rows`, where known, saves a count. A caller that
    has dealt the rows itself turns `deal` off, and `keep` too where it keeps what the fit reads.
    """

    n_rows: int | None = None
    deal = keep = True

    def _fit(self, dataset: DataFrame):
        dealt = self._dealt(dataset) if self.deal else dataset
        if dealt is dataset and (self.deal or not self.keep):
            return super()._fit(dataset)
        dealt.persist(StorageLevel.MEMORY_AND_DISK)         # a fit scans its rows several times
        try:
            return super()._fit(dealt)
        finally:
            dealt.unpersist()

    def _dealt(self, dataset: DataFrame) -> DataFrame:
        features = self.getFeaturesCol()
        names = [features, self.getLabelCol()]
        for param in ("weightCol", "validationIndicatorCol"):
            if self.hasParam(param) and self.isDefined(param):
                names.append(self.getOrDefault(param))
        n = dataset.count() if self.n_rows is None else self.n_rows
        trees = self.getNumTrees() if self.hasParam("numTrees") else 1
        return dealt(dataset, n, _width(dataset, features), trees, names)


def dealt(df: DataFrame, n: int, width: int, trees: int = 1, columns: Sequence[str] = ()) -> DataFrame:
    """The n rows of `df`, cut to `columns` and dealt out evenly where a task would train on too many; else `df` itself."""
    parts = -(-n // task_rows(width, trees))
    if parts <= 1:
        return df
    parts = max(parts, df.sparkSession.sparkContext.defaultParallelism)
    return df.select(*dict.fromkeys(columns or df.columns)).repartition(parts)


def task_rows(width: int, trees: int = 1) -> int:
    """Training rows a task, from the number of features and of trees that are grown together."""
    return max(1, TASK_BYTES // (ROW_BYTES + 4 * (width + trees)))


def _width(dataset: DataFrame, features: str) -> int:
    known = dataset.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known is not None:
        return int(known)
    row = dataset.select(features).where(F.col(features).isNotNull()).first()
    return len(row[0]) if row else 0


class BoundedTree(_BoundedTasks, DecisionTreeClassifier):
    pass


class BoundedForest(_BoundedTasks, RandomForestClassifier):
    pass


class BoundedBoosting(_BoundedTasks, GBTClassifier):
    pass


def _knowing(learner, n_rows: int | None):
    learner.n_rows = n_rows
    return learner


def _translate(params: Mapping, names: Mapping, n_rows: int | None) -> dict:
    out = {}
    for k, v in params.items():
        if k in ("max_features", "colsample_bylevel"):
            # Parameters from a trial table come back as doubles: whole numbers count features.
            whole = isinstance(v, float) and v >= 1 and v.is_integer()
            out["featureSubsetStrategy"] = str(int(v) if whole else v)
        elif k in names:
            out[names[k]] = v
        elif k in NOT_MAPPED:
            warnings.warn(f"{k} has no Spark counterpart and is ignored", stacklevel=3)
        elif k in WEIGHT_NAMES:
            raise ValueError(f"{k}: give class weights as a weight column (class_weights)")
        else:
            raise ValueError(f"unknown or unused parameter {k!r}")
    for k in ("maxDepth", "maxIter", "numTrees", "minInstancesPerNode"):
        if k in out:
            out[k] = int(out[k])
    if out.get("maxDepth", 0) > MAX_DEPTH:
        raise ValueError(f"max_depth {out['maxDepth']}: Spark's trees go down to {MAX_DEPTH}")
    if "min_child_weight" in params and "min_child_weight" in names:
        # A hessian sum per leaf becomes a share of the training weight.
        weight = params["min_child_weight"]
        if weight and not n_rows:
            raise ValueError("min_child_weight needs n_rows, the number of training rows it is a share of")
        share = weight / n_rows if weight else 0.0
        if not 0 <= share < 0.5:
            raise ValueError(f"min_child_weight {weight} is {share:.2f} of the training weight; it must be below 0.5")
        out["minWeightFractionPerNode"] = share
    return out


def decision_tree(params: Mapping | None = None, n_rows: int | None = None, **columns):
    """One tree. With max_features it is a forest of one tree over all rows."""
    p = dict(params or {})
    spark_params = _translate(p, TREE_NAMES, n_rows)
    if "featureSubsetStrategy" in spark_params:
        return _knowing(BoundedForest(numTrees=1, bootstrap=False, **spark_params, **columns), n_rows)
    return _knowing(BoundedTree(**spark_params, **columns), n_rows)


def random_forest(params: Mapping | None = None, n_rows: int | None = None, **columns):
    return _knowing(BoundedForest(**_translate(params or {}, FOREST_NAMES, n_rows), **columns), n_rows)


def boosted_trees(params: Mapping | None = None, n_rows: int | None = None, **columns):
    return _knowing(BoundedBoosting(**_translate(params or {}, BOOST_NAMES, n_rows), **columns), n_rows)


def tree_nodes(model) -> DataFrame:
    """Node table of a tree, forest or boosted model, read back from its saved form.

    (tree, node, feature_index, threshold, left, right, prediction, gain, n); leaves
    have NULL split fields. Nothing but the file goes through the driver.
    """
    spark = SparkSession.builder.getOrCreate()
    path = scratch_path(spark, "model")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    n = "nodeData." if "nodeData" in data.columns else ""
    inner = F.col(f"{n}leftChild") >= 0
    return data.select(
        tree.cast("int").alias("tree"), F.col(f"{n}id").alias("node"),
        F.when(inner, F.col(f"{n}split.featureIndex")).alias("feature_index"),
        F.when(inner, F.get(F.col(f"{n}split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.when(inner, F.col(f"{n}leftChild")).alias("left"),
        F.when(inner, F.col(f"{n}rightChild")).alias("right"),
        F.col(f"{n}prediction").alias("prediction"),
        F.when(inner, F.col(f"{n}gain")).alias("gain"), F.col(f"{n}rawCount").alias("n"),
        F.col(f"{n}impurityStats").alias("class_weights"))


def _name_of(names: Sequence[str]):
    return F.get(F.array(*[F.lit(n) for n in names]), F.col("feature_index"))


def tree_rules(model, names: Sequence[str]) -> DataFrame:
    """Readable rules: rows below or at the threshold go left, the rest right."""
    return tree_nodes(model).select("tree", "node", _name_of(names).alias("feature"), "threshold",
                                    "left", "right", "prediction", "n")


def importances(model, names: Sequence[str], kind: str = "gain") -> DataFrame:
    """(feature, importance). gain: normalised impurity gain. splits: times used in a node."""
    spark = SparkSession.builder.getOrCreate()
    if kind == "gain":
        v = model.featureImportances
        return spark.createDataFrame([(n, float(v[i])) for i, n in enumerate(names)],
                                     "feature string, importance double")
    if kind != "splits":
        raise ValueError(f"unknown kind {kind!r}")
    every = spark.createDataFrame([(n,) for n in names], "feature string")
    used = tree_nodes(model).where(F.col("feature_index").isNotNull()).groupBy(
        _name_of(names).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    return every.join(used, "feature", "left").fillna({"importance": 0.0})
