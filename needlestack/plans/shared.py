"""Cross-validation and search on statistics that all trials share.

The rows are written once, a folder a fold, with only the columns that learners need. The
medians and scales of every training set come from the same few passes, and all trials
apply them as literals: no trial fits a preparation, and no row is copied per fold. The
models of a round of trials score the held-out rows together, and what comes back is
confusion cells and a loss a trial; no table of scores is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..inflight import PARALLELISM, in_flight
from ..learners import boosting, trees
from ..learners.scores import score
from ..learners.staged import CELLS, StagedMetrics
from ..operators.prep import FoldSafe, class_weights
from ..sources.scratch import scratch_path
from .search import LARGER_IS_BETTER, any_done, as_trial, trial_table
from .spaces import split_weights
from .trials import TrialLog


FROM_CELLS = ("f1", "accuracy", "f1_weighted", "logloss")
#: Training rows of all boosted fits in flight: each fit keeps its binned rows, some 70 bytes a row, beside the others'.
FIT_ROWS = 100_000_000


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The frame kept by the executors, in memory and beyond that on disk, while the block runs."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


class FoldFrames:
    """Training and held-out rows of every fold, with features prepared by statistics of the training rows alone."""

    def __init__(self, df: DataFrame, cols: Sequence[str], fold: str, k: int, label: str, scale: bool = True,
                 keep: Sequence[str] = ()):
        self.cols, self.fold, self.k, self.label, self.scale = list(cols), fold, k, label, scale
        spark, path = df.sparkSession, scratch_path(df.sparkSession, "folds")
        held = df.select(*dict.fromkeys([*keep, *self.cols, label, fold]))
        held.write.partitionBy(fold).parquet(path)
        self.table = spark.read.schema(held.schema).parquet(path)
        self.stats = FoldSafe.fit(self.table, self.cols, fold, k, scale)
        counts = {r[fold]: r["count"] for r in self.table.groupBy(fold).count().collect()}
        self.n_rows = {f: sum(n for g, n in counts.items() if g != f) for f in range(k)}
        self.n = sum(counts.values())

    def dealt(self) -> DataFrame:
        """The rows of all folds, so that a task of a fit has a bounded number of them; prepared rows stay where these are."""
        return trees.dealt(self.table, self.n, len(self.cols))

    def _ready(self, rows: DataFrame, f: int) -> DataFrame:
        return VectorAssembler(inputCols=self.cols, outputCol="features").transform(self.stats.frame(rows, f))

    def train(self, f: int, rows: DataFrame | None = None) -> DataFrame:
        return self._ready((self.table if rows is None else rows).where(F.col(self.fold) != f), f)

    def held(self, f: int) -> DataFrame:
        return self._ready(self.table.where(F.col(self.fold) == f), f)


def _losses(cells: Mapping[str, float], metric: str) -> float:
    """A loss from confusion cells and a summed log loss."""
    tp, fp, fn, tn = (cells[c] for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    one = 2.0 * tp / (2.0 * tp + fp + fn) if tp + fp + fn else 0.0
    zero = 2.0 * tn / (2.0 * tn + fp + fn) if tn + fp + fn else 0.0
    values = {"f1": one, "accuracy": (tp + tn) / n if n else 0.0,
              "f1_weighted": (one * (tp + fn) + zero * (tn + fp)) / n if n else 0.0,
              "logloss": cells["loss"] / n if n else 0.0}
    return 1.0 - values[metric] if metric in LARGER_IS_BETTER else values[metric]


def score_together(models: Mapping[tuple[int, int], object], frames: FoldFrames, t: float = 0.5) -> dict[int, dict]:
    """Cells and summed log loss of each trial over all folds, from one scan; models come by (trial, fold)."""
    def one(f: int) -> DataFrame:
        held, sums = frames.held(f).select("features", frames.label), []
        for i, model in sorted((i, m) for (i, g), m in models.items() if g == f):
            held = score(model, held, f"p{i}")
            y, z, q = F.col(frames.label) == 1, F.col(f"p{i}") > t, F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), f"p{i}"))
            cells = {"tn": ~y & ~z, "fp": ~y & z, "fn": y & ~z, "tp": y & z}
            sums += [F.count_if(c).cast("double").alias(f"{name}{i}") for name, c in cells.items()]
            sums.append(F.sum(F.when(y, -F.ln(q)).otherwise(-F.ln(1 - q))).alias(f"loss{i}"))
        return held.agg(*sums)
    rows = reduce(DataFrame.unionByName, [one(f) for f in sorted({f for _, f in models})]).collect()   # a row a fold
    return {i: {c: sum(r[f"{c}{i}"] or 0.0 for r in rows) for c in (*CELLS, "loss")} for i in {i for i, _ in models}}


def shared_search(make: Callable[[dict], object], frames: FoldFrames, sets: Sequence[dict], metric: str = "f1",
                  batch: int = 8, parallelism: int = PARALLELISM, log: TrialLog | None = None) -> DataFrame:
    """Trials of parameter sets by cross-validation on shared statistics.

    `make(params)` is a learner that reads `features` and `weight`. `batch` sets are fitted, then scored in one scan."""
    if metric not in FROM_CELLS:
        raise ValueError(f"{metric!r} doesn't follow from confusion cells: {', '.join(FROM_CELLS)} do")
    done: list[dict] = []
    for low in range(0, len(sets), batch):
        part = [dict(p) for p in sets[low:low + batch]]
        todo = [i for i, p in enumerate(part) if not (log and log.find(p))]
        models, wrong = {}, {}

        def fit(job):
            i, f = job
            params, weight = split_weights(part[i])
            try:
                return make(params).fit(class_weights(frames.train(f), frames.label, weight))
            except Exception as e:
                return e
        jobs = [(i, f) for i in todo for f in range(frames.k)]
        for (i, f), model in zip(jobs, in_flight(fit, jobs, parallelism)):
            if isinstance(model, Exception):
                wrong[i] = model
            else:
                models[i, f] = model
        cells = score_together({(i, f): m for (i, f), m in models.items() if i not in wrong}, frames) if set(todo) - set(wrong) else {}

        def objective(i):
            def read(_):
                if i in wrong:
                    raise wrong[i]
                return {"loss": _losses(cells[i], metric), "attachments": {c: int(cells[i][c]) for c in CELLS}}
            return read
        done += [as_trial(objective(i), p, log) for i, p in enumerate(part)]
    return trial_table(frames.table.sparkSession, done)


def _boosted_fold(frames: FoldFrames, f: int, train: DataFrame, params: dict, rounds: int, patience: int, seed: int,
                  metric: str, ready: bool = False) -> dict:
    """Best round of one set of boosting parameters on fold f, and its cells and summed log loss there.

    With `ready` the training rows were dealt to tasks and are kept."""
    learner, weight = split_weights(params)
    gbt = trees.boosted_trees({**learner, "n_estimators": rounds, "seed": seed}, n_rows=frames.n_rows[f],
                              labelCol=frames.label, weightCol="weight")
    gbt.deal = gbt.keep = not ready
    model = gbt.fit(class_weights(train, frames.label, weight))
    staged = StagedMetrics(model, frames.held(f), frames.label)
    rows = staged.sums.collect()                                    # a row a round
    held = frames.table.sparkSession.createDataFrame(rows, staged.sums.schema)
    staged.sums = held
    best = boosting.fold_rounds(staged.metric(metric).withColumn("fold", F.lit(f)), patience, metric).first()
    cells = next(r for r in rows if r["iteration"] == best["best_iteration"])
    return {"best_n": int(best["best_iteration"]), **{c: cells[c] for c in CELLS}, "loss": cells["loss"]}


def _pooled(folds: Sequence[dict]) -> dict:
    """Loss and attachments of a trial from its folds."""
    pooled = {c: sum(r[c] for r in folds) for c in (*CELLS, "loss")}
    return {"loss": _losses(pooled, "f1"), "attachments": {"best_n": max(r["best_n"] for r in folds),
                                                          **{c: int(pooled[c]) for c in CELLS}}}


def boosted_objective(frames: FoldFrames, rounds: int, patience: int, seed: int = 1,
                      metric: str = "f1", parallelism: int = 1) -> Callable[[dict], dict]:
    """Loss of a set of boosting parameters: each fold stops by patience on its held-out rows, the cells of the
    folds' best rounds are pooled, and the loss is 1 - F1 of the pool.

    The largest best round of the folds is attached as best_n. Class weights and the row count behind
    min_child_weight come from the trial and its training set."""
    def objective(params: dict) -> dict:
        return _pooled(in_flight(lambda f: _boosted_fold(frames, f, frames.train(f), params, rounds, patience, seed, metric),
                                 range(frames.k), parallelism))
    return objective


def boosted_search(frames: FoldFrames, sets: Sequence[dict], rounds: int, patience: int, seed: int = 1, metric: str = "f1",
                   parallelism: int = PARALLELISM, log: TrialLog | None = None, rows: DataFrame | None = None) -> list[dict]:
    """Trials of `boosted_objective` on all sets, fold by fold: the training rows of a fold are prepared and kept once
    for the sets in flight, not once a set. Sets go in groups of `parallelism`; those of a group are logged together.

    `rows` are the dealt rows of all folds, where the caller keeps them."""
    if rows is None:
        with kept(frames.dealt()) as rows:
            return boosted_search(frames, sets, rounds, patience, seed, metric, parallelism, log, rows)
    done: list[dict] = []
    for low in range(0, len(sets), parallelism):
        part = [dict(p) for p in sets[low:low + parallelism]]
        wrong: dict[int, Exception] = {}
        folds: dict[int, list[dict]] = {i: [] for i, p in enumerate(part) if not (log and log.find(p))}
        for f in range(frames.k if folds else 0):
            todo = [i for i in folds if i not in wrong]
            if not todo:
                break
            with kept(frames.train(f, rows).select("features", frames.label)) as train:
                def one(i):
                    try:
                        return _boosted_fold(frames, f, train, part[i], rounds, patience, seed, metric, True)
                    except Exception as e:
                        return e
                at_once = max(1, min(parallelism, FIT_ROWS // max(1, frames.n_rows[f])))
                for i, out in zip(todo, in_flight(one, todo, at_once)):
                    if isinstance(out, Exception):
                        wrong[i] = out
                    else:
                        folds[i].append(out)

        def objective(i):
            def read(_):
                if i in wrong:
                    raise wrong[i]
                return _pooled(folds[i])
            return read
        done += [as_trial(objective(i), p, log) for i, p in enumerate(part)]
    return any_done(done)
