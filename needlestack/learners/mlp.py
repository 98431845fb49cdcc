"""Data-parallel dense network with dropout, max-norm, momentum and class weights.

Training is synchronous: the ids' hashes deal the rows to the batches of an epoch, all
tasks add up the gradient of one batch over all of its rows, and one step is taken with
the sum. So the model is that of one machine with the same batches, however the rows are
spread, and only arrays of model size reach the driver. A batch is a folder of its own
in the shared scratch folder, so a step reads the rows of its batch and no others; executors
keep in memory and on disk what fits, and one that is lost reads the folder again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, functions as F

from ..operators.summed import array_sum
from ..sources.scratch import scratch_path
from .stored import StoredModel

MAX_STEPS = 64
HELD = -1


def _shapes(layers: Sequence[int]):
    return [((a, b), (b,)) for a, b in zip(layers[:-1], layers[1:])]


def _unpack(flat: np.ndarray, layers):
    out, at = [], 0
    for (a, b), _ in _shapes(layers):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _size(layers) -> int:
    return sum(a * b + b for a, b in zip(layers[:-1], layers[1:]))


def forward(flat: np.ndarray, layers, x: np.ndarray) -> np.ndarray:
    """Sigmoid output of a network of ReLU layers."""
    h = x
    params = _unpack(flat, layers)
    for i, (w, b) in enumerate(params):
        h = h @ w + b
        if i < len(params) - 1:
            h = np.maximum(h, 0.0)
    return 1.0 / (1.0 + np.exp(-np.clip(h[:, 0], -500, 500)))


def _loss(p, y, w) -> float:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float((-w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def _kept(h: np.ndarray, salt: int, units: int, keep: float) -> np.ndarray:
    """Which units of a layer dropout keeps for each row: a function of the row's hash, the step and the layer."""
    z = h.view(np.uint64)[:, None] + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = z ^ np.uint64(salt * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) < int(keep * (1 << 53))


def _gradient(flat, layers, x, y, w, dropout, h=None, salt: int = 0):
    """Gradient of the weighted mean cross-entropy with inverted dropout on hidden layers."""
    params = _unpack(flat, layers)
    inputs, masks, a = [], [], x
    for i, (k, b) in enumerate(params):
        inputs.append(a)
        a = a @ k + b
        if i < len(params) - 1:
            mask = (a > 0).astype(np.float64)
            if dropout[i] > 0:
                mask *= _kept(h, salt * len(params) + i, a.shape[1], 1.0 - dropout[i]) / (1.0 - dropout[i])
            a = a * mask
            masks.append(mask)
    p = 1.0 / (1.0 + np.exp(-np.clip(a[:, 0], -500, 500)))
    delta = ((p - y) * w / w.sum())[:, None]
    parts = []
    for i in range(len(params) - 1, -1, -1):
        parts.append(np.concatenate([(inputs[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ params[i][0].T) * masks[i - 1]
    return np.concatenate(parts[::-1])


def _clip_norms(flat, layers, max_norm):
    """Scales the incoming weights of every hidden unit down to the given length."""
    for (w, _), limit in zip(_unpack(flat, layers), max_norm):
        if limit:
            length = np.sqrt((w ** 2).sum(axis=0))
            w *= np.minimum(1.0, limit / np.maximum(length, 1e-12))


class DenseNetwork(Estimator):
    """Layers of ReLU units and one sigmoid output, trained by synchronous mini-batch gradient descent.

    hidden, dropout, max_norm: one entry per hidden layer. The step size at update u is lr / (1 + decay * u).
    An epoch takes one step for every `batch` rows, at most `max_steps`: with more rows the batches grow, so an
    epoch is at most `max_steps` jobs. `partitions` spreads the rows; the model doesn't depend on it. With
    `validCol` and `patience`, rows marked there are held out, training stops once their loss has not improved
    for that many epochs, and the model carries `best_n`.
    """

    @keyword_only
    def __init__(self, *, hidden=(18, 13), dropout=(0.0, 0.0), max_norm=(0.0, 0.0), lr=0.2,
                 decay=0.0, momentum=0.9, batch=1024, epochs=50, max_steps=MAX_STEPS, partitions=None, seed=1,
                 featuresCol="features", labelCol="label", weightCol=None, idCol="row_id",
                 validCol=None, patience=None):
        super().__init__()
        self.args = dict(hidden=tuple(hidden), dropout=tuple(dropout), max_norm=tuple(max_norm),
                         lr=lr, decay=decay, momentum=momentum, batch=batch, epochs=epochs,
                         max_steps=max_steps, partitions=partitions, seed=seed, featuresCol=featuresCol,
                         labelCol=labelCol, weightCol=weightCol, idCol=idCol, validCol=validCol,
                         patience=patience)

    def copy(self, extra=None):
        return DenseNetwork(**self.args)

    def setMaxIter(self, epochs: int) -> "DenseNetwork":
        self.args["epochs"] = epochs
        return self

    def getLabelCol(self) -> str:
        return self.args["labelCol"]

    def _batches(self, dataset: DataFrame) -> tuple[list[DataFrame], list[int]]:
        """The rows of each step of an epoch, the first with the held-out rows as well, and their tasks."""
        a, spark = self.args, dataset.sparkSession
        weight = F.col(a["weightCol"]) if a["weightCol"] else F.lit(1.0)
        held = F.coalesce(F.col(a["validCol"]), F.lit(False)) if a["validCol"] else F.lit(False)
        n = dataset.where(~held).count()
        if not n:
            raise ValueError("no rows to train on")
        steps = min(a["max_steps"], max(1, round(n / a["batch"])))
        dealt = F.pmod(F.xxhash64(F.col(a["idCol"]), F.lit(a["seed"]), F.lit("step")), F.lit(steps))
        rows = dataset.select(
            F.xxhash64(F.col(a["idCol"]), F.lit(a["seed"])).alias("h"),
            vector_to_array(a["featuresCol"], "float32").alias("x"),
            F.col(a["labelCol"]).cast("float").alias("y"), weight.cast("float").alias("w"),
            F.when(held, F.lit(HELD)).otherwise(dealt.cast("int")).alias("step"))
        if a["partitions"]:
            rows = rows.repartition(a["partitions"], "h")
        path = scratch_path(spark, "network_rows")
        rows.write.partitionBy("step").parquet(path)
        # The step is a folder name here, so a filter on it chooses what is read.
        stored = spark.read.schema(rows.schema).parquet(path)
        parts = [stored.where(F.col("step").isin(0, HELD) if s == 0 else F.col("step") == s).persist()
                 for s in range(steps)]
        return parts, [part.rdd.getNumPartitions() for part in parts]

    def _fit(self, dataset: DataFrame) -> "DenseNetworkModel":
        a = self.args
        batches, parts = self._batches(dataset)
        layers = [len(dataset.select(vector_to_array(a["featuresCol"]).alias("x")).first()["x"]), *a["hidden"], 1]
        rng = np.random.default_rng(a["seed"])
        flat = np.zeros(_size(layers))
        for w, _ in _unpack(flat, layers):
            w[:] = rng.uniform(-1, 1, w.shape) * np.sqrt(6.0 / sum(w.shape))
        velocity = np.zeros_like(flat)
        history, updates, best = [], 0, (np.inf, 0)
        # The held-out loss of an epoch is read by the first job of the next one, so stopping costs no extra
        # pass; the loop runs one round further to read the last.
        for epoch in range(a["epochs"] + (1 if a["validCol"] else 0)):
            loss, seen = 0.0, 0.0
            for step, (rows, tasks) in enumerate(zip(batches, parts)):
                gradient, w, own, held_w, held_loss = self._sums(rows, tasks, layers, flat, updates)
                if not step and epoch and a["validCol"]:
                    history[-1]["valid"] = held_loss / held_w if held_w else np.nan
                    if history[-1]["valid"] < best[0]:
                        best = (history[-1]["valid"], epoch)
                    if a["patience"] and epoch - best[1] >= a["patience"]:
                        break
                if epoch == a["epochs"]:
                    break
                loss, seen = loss + own, seen + w
                if w > 0:
                    velocity = a["momentum"] * velocity - a["lr"] / (1.0 + a["decay"] * updates) * gradient / w
                    flat = flat + velocity
                    _clip_norms(flat, layers, a["max_norm"])
                updates += 1
            else:
                history.append({"train": loss / seen})
                continue
            break
        for rows in batches:
            rows.unpersist()
        model = DenseNetworkModel(layers=layers, weights=flat.tolist(), featuresCol=a["featuresCol"])
        model.history, model.best_n = history, best[1] or len(history)
        return model

    def _sums(self, rows: DataFrame, tasks: int, layers, flat: np.ndarray, update: int):
        """Gradient, weight and loss over one batch, and weight and loss of the held-out rows in it."""
        dropout, size = self.args["dropout"], len(flat)

        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            h, y, w, step = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
            x = batch.column(1).flatten().to_numpy().reshape(len(h), -1).astype(np.float64)
            y, w, held = y.astype(np.float64), w.astype(np.float64), step == HELD
            loss = lambda at: _loss(forward(flat, layers, x[at]), y[at], w[at])
            seen = ~held
            weight, gradient = w[seen].sum(), np.zeros(size)
            if weight > 0:
                gradient = _gradient(flat, layers, x[seen], y[seen], w[seen], dropout, h[seen], update) * weight
            return np.concatenate([gradient, [weight, loss(seen), w[held].sum(), loss(held)]])
        out = array_sum(rows, of_batch, size + 4, tasks)
        return out[:size], *map(float, out[size:])


def network_history(spark, model) -> DataFrame:
    """(dataset, metric, iteration, value) of a fitted network, one row per epoch and part."""
    rows = [(part, "logloss", i + 1, float(v)) for i, h in enumerate(model.history)
            for part, v in h.items()]
    return spark.createDataFrame(rows, "dataset string, metric string, iteration int, value double")


class DenseNetworkModel(Model, StoredModel):
    """A fitted network. The losses of its epochs are written as a table, the weights as a parameter."""

    history: Sequence[dict] = ()
    best_n = 0

    layers = Param(Params._dummy(), "layers", "layer sizes", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "flat weights", TypeConverters.toListFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, layers=(), weights=(), featuresCol="features"):
        super().__init__()
        self._set(layers=list(layers), weights=list(weights), featuresCol=featuresCol)

    def _settings(self) -> dict:
        return {"best_n": self.best_n}

    def _store(self, spark, path: str) -> None:
        network_history(spark, self).coalesce(1).write.parquet(f"{path}/history")

    @classmethod
    def _restore(cls, spark, path: str, settings: dict) -> "DenseNetworkModel":
        model, losses = cls(), {}
        for r in spark.read.parquet(f"{path}/history").orderBy("iteration").collect():
            losses.setdefault(r["iteration"], {})[r["dataset"]] = r["value"]
        model.history, model.best_n = list(losses.values()), settings["best_n"]
        return model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers = self.getOrDefault(self.layers)
        flat = np.array(self.getOrDefault(self.weights))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(forward(flat, layers, np.array(x.tolist())))

        p = score(vector_to_array(self.getOrDefault(self.featuresCol)))
        return (dataset.withColumn("__p", p)
                .withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p"))))
                .withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p"))


def network_from_trial(params, epochs: int = 50, **columns) -> DenseNetwork:
    """The network of a trial row: two hidden layers, a third only if its branch was taken."""
    depth = 3 if "width_3" in params else 2
    pick = lambda stem, cast: tuple(cast(params[f"{stem}_{i}"]) for i in range(1, depth + 1))
    extra = {k: float(params[k]) for k in ("lr", "momentum", "decay") if k in params}
    return DenseNetwork(hidden=pick("width", int), dropout=pick("dropout", float),
                        max_norm=pick("max_norm", float), batch=int(params.get("batch", 1024)),
                        epochs=epochs, **extra, **columns)
