"""Grid, random and adaptive parameter search. The result is a table of trials.

Trials share one prepared frame and one fold column. A trial is a Spark job on the
whole data; `parallelism` only lets several of them be in flight. The driver holds
parameter sets and losses, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..inflight import PARALLELISM, in_flight
from ..learners.scores import score
from ..operators.split import stratified_folds
from ..sources.scratch import materialize
from .evaluate import cv_score, metric_value
from .spaces import Choice, draw
from .trials import DONE, FAILED, TrialLog

TRIAL_SCHEMA = ("trial_id long, params map<string,double>, loss double, attachments map<string,string>, "
                "status string, error string")
LARGER_IS_BETTER = {"f1", "f1_weighted", "accuracy", "roc_auc", "ap"}


def trial_table(spark: SparkSession, trials: Sequence[Mapping]) -> DataFrame:
    """Trial rows; parameters that are not numbers go to attachments as text. A failed trial has no loss."""
    rows = []
    for i, t in enumerate(trials):
        number = {k: float(v) for k, v in t["params"].items() if isinstance(v, (int, float))}
        text = {k: str(v) for k, v in t["params"].items() if k not in number}
        text.update({k: str(v) for k, v in t.get("attachments", {}).items()})
        loss = t["loss"]
        rows.append((i, number, None if loss is None else float(loss), text, t.get("status", DONE), t.get("error")))
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the smallest loss, the earliest on ties; failed ones don't count."""
    return trials.where(F.col("loss").isNotNull()).orderBy("loss", "trial_id").limit(1)


def as_trial(objective: Callable[[dict], Mapping | float], params: dict, log: TrialLog | None = None) -> dict:
    """One trial: read from the log if it is there, else run and logged. A failure is a trial without a loss."""
    known = log.find(params) if log else None
    if known:
        return {"params": params, **known}
    try:
        out = objective(params)
        out = out if isinstance(out, Mapping) else {"loss": out}
        trial = {"params": params, "loss": None if out["loss"] is None else float(out["loss"]),
                 "attachments": out.get("attachments", {}), "status": DONE, "error": None}
    except Exception as e:
        trial = {"params": params, "loss": None, "attachments": {}, "status": FAILED, "error": f"{type(e).__name__}: {e}"[:1000]}
    if log:
        log.add(trial)
    return trial


def run_trials(objective: Callable[[dict], Mapping], sets: Sequence[dict],
               parallelism: int = PARALLELISM, log: TrialLog | None = None) -> list[dict]:
    return any_done(in_flight(lambda params: as_trial(objective, params, log), sets, parallelism))


def any_done(done: list[dict]) -> list[dict]:
    """The trials, unless every one failed: that is an error."""
    if done and all(t["status"] == FAILED for t in done):
        raise RuntimeError(f"every trial failed, the first with {done[0]['error']}")
    return done


def cv_objective(make: Callable[[dict], object], df: DataFrame, fold: str, k: int, label: str,
                 metric="f1", how: str = "pool") -> Callable[[dict], dict]:
    """Loss of a parameter set: 1 - metric for scores, the metric itself for losses."""
    def objective(params):
        value = cv_score(make(params), df, fold, k, label, metric, how).first()["value"]
        return {"loss": 1.0 - value if metric in LARGER_IS_BETTER else value}
    return objective


def holdout_objective(make, train: DataFrame, test: DataFrame, label: str, metric="f1"):
    """Loss on one held-out part."""
    def objective(params):
        value = metric_value(score(make(params).fit(train), test), metric, label).first()["value"]
        return {"loss": 1.0 - value if metric in LARGER_IS_BETTER else value}
    return objective


def grid_search(spark, objective, grid: Mapping[str, Sequence], parallelism: int = PARALLELISM,
                log: TrialLog | None = None) -> DataFrame:
    names = list(grid)
    sets = [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]
    return trial_table(spark, run_trials(objective, sets, parallelism, log))


def random_search(spark, objective, space: Mapping, n_iter: int, seed: int = 1,
                  parallelism: int = PARALLELISM, log: TrialLog | None = None) -> DataFrame:
    rng = np.random.default_rng(seed)
    sets = [draw(space, rng) for _ in range(n_iter)]
    return trial_table(spark, run_trials(objective, sets, parallelism, log))


def nested_random_search(make, df: DataFrame, label: str, id_col: str, space: Mapping, n_iter: int,
                         outer: str = "fold", k: int = 4, inner_k: int = 3, metric="f1",
                         seed: int = 1, parallelism: int = PARALLELISM) -> DataFrame:
    """(fold, inner_loss, outer_value, params): the best draw of each outer training part,
    refitted on that part and scored on the fold it never saw."""
    rng = np.random.default_rng(seed)
    sets = [draw(space, rng) for _ in range(n_iter)]

    def one(f):
        train = df.where(F.col(outer) != f).drop("seed", outer)
        inner = materialize(
            stratified_folds(train, label, id_col, inner_k, [seed]).withColumnRenamed("fold", "inner"),
            "inner")
        done = run_trials(cv_objective(make, inner, "inner", inner_k, label, metric), sets, 1)
        best = min(done, key=_rank)
        model = make(best["params"]).fit(inner)
        value = metric_value(score(model, df.where(F.col(outer) == f)), metric, label).first()["value"]
        number = {p: float(v) for p, v in best["params"].items() if isinstance(v, (int, float))}
        return f, float(best["loss"]), float(value), number

    rows = in_flight(one, range(k), parallelism)
    return df.sparkSession.createDataFrame(
        rows, "fold int, inner_loss double, outer_value double, params map<string,double>")


def _rank(trial: Mapping) -> float:
    return math.inf if trial["loss"] is None else trial["loss"]


# ---------------------------------------------------------------- adaptive search

def _log_density(points: np.ndarray, at: np.ndarray, span) -> np.ndarray:
    """Log of an even mixture of one Gaussian per point and a flat prior over the span."""
    lo, hi = span
    width = max((hi - lo) / max(2.0, math.sqrt(len(points) + 1.0)), 1e-12)
    kernels = np.exp(-0.5 * ((at[:, None] - points[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    flat = 1.0 / max(hi - lo, 1e-12)
    return np.log((kernels.sum(axis=1) + flat) / (len(points) + 1.0))


def _propose(name, dist, good, bad, rng, candidates):
    """A candidate drawn near the good values with a large good/bad density ratio."""
    g = [t["params"][name] for t in good if name in t["params"]]
    b = [t["params"][name] for t in bad if name in t["params"]]
    if isinstance(dist, Choice):
        plain = lambda v: dist.options.index(v) if not isinstance(v, float) or v in dist.options else int(v)
        count = lambda vs: np.bincount([plain(v) for v in vs], minlength=len(dist.options)) + 1.0
        pg, pb = count(g) / (len(g) + len(dist.options)), count(b) / (len(b) + len(dist.options))
        # Drawn, not maximised: a maximum over few options would never leave the first winner.
        odds = pg * pg / pb
        return dist.options[int(rng.choice(len(dist.options), p=odds / odds.sum()))]
    lo, hi = dist.span
    if not g:
        return dist.draw(rng)
    gx = np.array([dist.inward(v) for v in g])
    bx = np.array([dist.inward(v) for v in b])
    width = (hi - lo) / max(2.0, math.sqrt(len(gx) + 1.0))
    near = rng.choice(gx, size=candidates) + rng.normal(0.0, width, candidates)
    u = np.concatenate([near[(near >= lo) & (near <= hi)], rng.uniform(lo, hi, 2)])
    ratio = _log_density(gx, u, dist.span) - _log_density(bx, u, dist.span)
    return dist.outward(float(u[np.argmax(ratio)]))


def _next_set(space, done, rng, share, candidates):
    ranked = sorted(done, key=_rank)
    n_good = max(1, int(math.ceil(share * len(ranked))))
    good, bad = ranked[:n_good], ranked[n_good:]

    def fill(part):
        out = {}
        for name in sorted(part):
            dist = part[name]
            value = _propose(name, dist, good, bad, rng, candidates) if hasattr(dist, "draw") else dist
            if isinstance(value, Mapping):
                out[name] = float(dist.options.index(value))
                out.update(fill(value))
            else:
                out[name] = value
        return out
    return fill(space)


def adaptive_search(spark, objective, space: Mapping, n_trials: int, batch: int = 5,
                    startup: int = 10, seed: int = 1, share: float = 0.25, candidates: int = 24,
                    parallelism: int = PARALLELISM, log: TrialLog | None = None) -> DataFrame:
    """Rounds of trials drawn where good losses are dense (Bergstra et al., 2011).

    The first `startup` sets are random. Each later round draws `batch` sets from the
    ratio of densities of the best `share` of trials and the rest, parameter by
    parameter; a parameter of an absent branch does not count. The last set of a round
    is random, so a branch that started badly is still tried. With a `log`, a search that
    was ended goes on from the trials in it and ends in the same table.
    """
    rng = np.random.default_rng(seed)
    done: list[dict] = []
    while len(done) < n_trials:
        if len(done) < startup:
            sets = [draw(space, rng) for _ in range(min(startup, n_trials) - len(done))]
        else:
            sets = [_next_set(space, done, rng, share, candidates)
                    for _ in range(min(batch, n_trials - len(done)))]
            if len(sets) > 1:
                sets[-1] = draw(space, rng)
        done += run_trials(objective, sets, parallelism, log)
    return trial_table(spark, done)
