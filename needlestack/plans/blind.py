"""End-to-end plans: fit or tune on labelled rows, score a blind table, match catalogues."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, functions as F

from ..learners import trees
from ..learners.scores import score
from ..operators.catalog import catalog_match, threshold_split
from ..operators.prep import ClassWeights, MedianImputer, pca, scaler_stages
from ..sources.catalogs import read_id_list, write_ids
from .search import best_trial, trial_table
from .shared import FoldFrames, boosted_search, kept
from .spaces import split_weights
from .trials import TrialLog


def standard_pipeline(cols: Sequence[str], learner, scaler: str = "standard",
                      n_components: int | None = None, log=None) -> Pipeline:
    """Impute, optionally log and impute again, scale, optionally project, classify.

    The learner must read `features`, or `pca` when n_components is given.
    """
    stages = [MedianImputer(cols=list(cols))]
    if log is not None:
        stages += [log, MedianImputer(cols=list(cols))]
    stages += scaler_stages(cols, scaler)
    if n_components:
        stages.append(pca(n_components))
    return Pipeline(stages=[*stages, learner])


def blind_scoring(pipeline, train: DataFrame, target: DataFrame, new: DataFrame,
                  candidates: DataFrame, not_in_cat: DataFrame, id_col: str, t: float = 0.5,
                  ties: str = "drop", probe: str | None = None, key_field: int | None = None,
                  result_path: str | None = None) -> DataFrame:
    """Fit, score the target, optionally write the found ids, and match: one row."""
    scored = score(pipeline.fit(train), target).select(id_col, "p")
    if result_path:
        found = threshold_split(scored, "p", t, ties).where("found")
        write_ids(found, result_path, id_col)
    return catalog_match(scored, new, candidates, not_in_cat, id_col, "p", t, ties, probe, key_field)


def match_result_file(spark, result_path: str, new: DataFrame) -> DataFrame:
    """How many new ids a written result list contains."""
    found = read_id_list(spark, result_path, "result").select("id").distinct()
    return new.select("id").distinct().join(found, "id", "left_semi").agg(
        F.count(F.lit(1)).alias("new_found"))


def tune_refit(make: Callable[[Mapping], object], trials: DataFrame, train: DataFrame,
               growth: float = 1.25):
    """Refit the best parameter set of a trial table on all labelled rows.

    A round count that early stopping attached as best_n becomes n_estimators, `growth` times
    as many: the refit has more rows than a fold had.
    """
    best = best_trial(trials).first()
    if best is None:
        raise ValueError("no trial of the table has a loss")
    attached = dict(best["attachments"])
    params = {**best["params"], **{k: v for k, v in attached.items() if k != "best_n"}}
    if "best_n" in attached:
        params["n_estimators"] = int(growth * float(attached["best_n"]))
    return make(params).fit(train)


def tuned_blind_scoring(train: DataFrame, target: DataFrame, new: DataFrame, candidates: DataFrame,
                        not_in_cat: DataFrame, cols: Sequence[str], label: str, id_col: str, sets: Sequence[Mapping],
                        fold: str = "fold", k: int = 4, rounds: int = 10_000, patience: int = 50, t: float = 0.5,
                        growth: float = 1.25, seed: int = 1, scale: bool = True, log: TrialLog | None = None,
                        probe: str | None = None, key_field: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(trials, one row of matches): tune boosted trees, stop each fold early, refit, score, match.

    Every set of `sets` is cross-validated on the same folds and statistics. The best one is refitted on all of
    `train`, imputed and scaled by its own statistics, with `growth` times the largest best round of its folds.
    Rows are dealt to tasks and kept once for all fits.
    """
    frames = FoldFrames(train, cols, fold, k, label, scale)

    def refit(params: Mapping):
        learner, weight = split_weights(params)
        gbt = trees.boosted_trees({**learner, "seed": seed}, n_rows=frames.n, labelCol=label, weightCol="weight")
        gbt.deal = False            # it reads the dealt rows of the folds
        return Pipeline(stages=[ClassWeights(label=label, weight=float(weight)),
                                *standard_pipeline(cols, gbt, "standard" if scale else "none").getStages()])
    cells = ("tn", "fp", "fn", "tp")
    with kept(frames.dealt()) as rows:
        trials = trial_table(train.sparkSession, boosted_search(frames, list(sets), rounds, patience, seed, log=log, rows=rows))
        plain = trials.withColumn("attachments", F.map_filter("attachments", lambda name, _: ~name.isin(*cells)))
        model = tune_refit(refit, plain, rows, growth)
    scored = score(model, target.select(*dict.fromkeys([id_col, *cols]))).select(id_col, "p")
    return trials, catalog_match(scored, new, candidates, not_in_cat, id_col, "p", t, "drop", probe, key_field)
