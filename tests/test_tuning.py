"""Shared folds, resumable trials, presets as they are, and the tuned flow from end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from needlestack.learners import trees
from needlestack.operators import prep
from needlestack.operators.audit import correlation_pairs
from needlestack.plans import blind, search, shared, spaces
from needlestack.plans.trials import TrialLog
from needlestack.queries import learning as q
from needlestack.queries.frames import TEXT_FEATURES
from needlestack.sources import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return q._docs(spark, SF).cache()


@pytest.fixture(scope="module")
def frames(docs):
    return shared.FoldFrames(docs, TEXT_FEATURES, "fold", 4, "y")


def losses(trials):
    return [r.loss for r in trials.orderBy("trial_id").collect()]


@pytest.mark.parametrize("metric", ["f1", "accuracy", "f1_weighted", "logloss"])
def test_shared_statistics_give_the_losses_of_a_pipeline_per_fold(spark, docs, frames, metric):
    sets = [{"max_depth": d} for d in (1, 3)]
    make = lambda p: trees.decision_tree({**p, "seed": 1}, labelCol="y", weightCol="weight")
    plain = docs.drop("weight").withColumn("weight", F.lit(1.0))
    slow = search.cv_objective(lambda p: blind.standard_pipeline(TEXT_FEATURES, make(p)), plain, "fold", 4, "y", metric)
    want = losses(search.trial_table(spark, search.run_trials(slow, sets)))
    assert losses(shared.shared_search(make, frames, sets, metric)) == pytest.approx(want, abs=1e-9)
    assert losses(shared.shared_search(make, frames, sets, metric, batch=1)) == pytest.approx(want, abs=1e-9)


def test_a_round_of_trials_is_scored_in_one_scan(spark, frames, monkeypatch):
    jobs = []
    together = shared.score_together
    monkeypatch.setattr(shared, "score_together", lambda m, f: jobs.append(len(m)) or together(m, f))
    make = lambda p: trees.decision_tree({**p, "seed": 1}, labelCol="y", weightCol="weight")
    sets = [{"max_depth": d, "scale_pos_weight": w} for d in (1, 2) for w in (1.0, 9.0)]
    out = shared.shared_search(make, frames, sets, batch=4).collect()
    assert jobs == [16] and all(r.status == "done" for r in out)
    assert all(sum(int(r.attachments[c]) for c in ("tn", "fp", "fn", "tp")) == 399 for r in out)
    with pytest.raises(ValueError):
        shared.shared_search(make, frames, sets[:1], "roc_auc")


def test_a_killed_search_resumes_to_the_same_table(spark):
    space, calls = {"x": spaces.Uniform(-5, 5), "n": spaces.integers(1, 9)}, []

    def objective(p):
        calls.append(p)
        return {"loss": (p["x"] - 2) ** 2, "attachments": {"best_n": p["n"], "note": "kept", "share": 0.5}}
    run = lambda log, f=objective, n=20: search.adaptive_search(spark, f, space, n, batch=3, startup=6, parallelism=1, log=log)
    whole = run(None).collect()
    path = scratch_path(spark, "trials")
    killed = iter(range(9))

    def dies(p):
        if next(killed, None) is None:
            raise KeyboardInterrupt
        return objective(p)
    with pytest.raises(KeyboardInterrupt):
        run(TrialLog(spark, path), dies)
    logged = TrialLog(spark, path).table().count()
    assert 0 < logged <= 9
    calls.clear()
    again = run(TrialLog(spark, path)).collect()
    assert again == whole and len(calls) == 20 - logged
    row = TrialLog(spark, path).table().first()
    assert set(row.numbers) == {"best_n", "share"} and row.texts == {"note": "kept"} and row.status == "done"
    calls.clear()
    assert run(TrialLog(spark, path)).collect() == whole and not calls


def test_a_failing_trial_is_a_row(spark):
    path = scratch_path(spark, "trials")
    objective = lambda p: 1.0 / p["a"]
    out = search.grid_search(spark, objective, {"a": [0, 1, 2]}, log=TrialLog(spark, path)).orderBy("trial_id").collect()
    assert [r.status for r in out] == ["failed", "done", "done"] and out[0].loss is None and "division" in out[0].error
    assert search.best_trial(spark.createDataFrame(out, search.TRIAL_SCHEMA)).first().params["a"] == 2.0
    tried = []
    search.grid_search(spark, lambda p: tried.append(p) or 0.0, {"a": [0, 1]}, log=TrialLog(spark, path))
    assert tried == []
    search.grid_search(spark, lambda p: tried.append(p) or 0.0, {"a": [0, 1]}, log=TrialLog(spark, path, retry_failed=True))
    assert tried == [{"a": 0}]
    with pytest.raises(RuntimeError):
        search.grid_search(spark, objective, {"a": [0]})


def test_failures_of_shared_trials_are_rows(frames):
    def make(p):
        if p["max_depth"] == 2:
            raise ValueError("no such depth")
        return trees.decision_tree({**p, "seed": 1}, labelCol="y", weightCol="weight")
    out = shared.shared_search(make, frames, [{"max_depth": d} for d in (1, 2, 3)]).orderBy("trial_id").collect()
    assert [r.status for r in out] == ["done", "failed", "done"]


def test_weights_of_a_trial():
    assert spaces.split_weights({"max_depth": 3, "scale_pos_weight": 6}) == ({"max_depth": 3}, 6)
    assert spaces.split_weights({"class_weight": "balanced"}) == ({}, "balanced")
    assert spaces.split_weights({"max_depth": 3}) == ({"max_depth": 3}, 1.0)
    with pytest.raises(ValueError):
        spaces.split_weights({"scale_pos_weight": 6, "class_weight": 2})


@pytest.mark.filterwarnings("ignore:.*no Spark counterpart")
@pytest.mark.parametrize("preset", ["gbt_f1", "gbt_ap"])
def test_presets_run_as_they_are(spark, docs, frames, preset):
    sets = spaces.sample_space(spaces.PRESETS[preset], 2, seed=4)
    objective = shared.boosted_objective(frames, rounds=4, patience=2)
    trials = search.trial_table(spark, search.run_trials(objective, sets))
    out = trials.collect()
    assert [r.status for r in out] == ["done"] * 2, out
    assert all(1 <= int(r.attachments["best_n"]) <= 4 and 0 <= r.loss <= 1 for r in out)


@pytest.mark.filterwarnings("ignore:.*no Spark counterpart")
def test_tuned_flow_on_documents(spark, docs):
    text = F.col("doc_id").cast("string").alias("id")
    new, cand = docs.where("y = 1").select(text), docs.where("toxic = 1").select(text)
    nic = docs.where("toxic = 1").select(text, F.lit("VAR").alias("line"))
    sets = spaces.sample_space(spaces.PRESETS["gbt_f1"], 2, seed=1)
    trials, out = blind.tuned_blind_scoring(docs.drop("weight"), docs.drop("y", "weight"), new, cand, nic, TEXT_FEATURES,
                                            "y", "doc_id", sets, rounds=4, patience=2)
    row = out.first()
    assert trials.count() == 2 and row.tp + row.fn + row.fp + row.tn <= docs.count()
    assert row.new_found > 0.5 * new.count()


def test_correlations_of_pairs_with_missing_values(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3000, 1))
    x = base * rng.normal(size=24) + rng.normal(size=(3000, 24)) * 2 + np.arange(24) * 1e6
    gone = rng.random(x.shape) < 0.2
    rows = [[None if g else float(v) for v, g in zip(r, m)] + [3.0, None] for r, m in zip(x, gone)]
    rows[0][0] = float("nan")
    cols = [f"c{i}" for i in range(24)] + ["flat", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = {(r.f1, r.f2): r["corr"] for r in correlation_pairs(df, cols).collect()}
    clean = df.withColumns({c: F.nanvl(c, F.lit(None)) for c in cols})
    pairs = [(b, a) for i, a in enumerate(cols) for b in cols[i + 1:]]
    full = [p for p in pairs if not {"flat", "none"} & set(p)]
    want = clean.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in full]).first().asDict()
    assert set(got) == set(pairs)
    for (a, b), v in got.items():
        if "flat" in (a, b) or "none" in (a, b):
            assert v is None
        else:
            assert v == pytest.approx(want[f"{a}|{b}"], abs=1e-9)
    assert correlation_pairs(df, ["c1"]).count() == 0
    assert correlation_pairs(df.where("false"), ["c1", "c2"]).first()["corr"] is None


def test_class_weights_as_a_stage(spark, docs, tmp_path):
    stage = prep.ClassWeights(label="y", weight=7.0)
    assert {(r.y, r.weight) for r in stage.transform(docs).select("y", "weight").collect()} == {(0, 1.0), (1, 7.0)}
    assert stage.transform(docs.drop("y")).select("weight").distinct().collect()[0].weight == 1.0
    stage.save(str(tmp_path / "s"))
    assert prep.ClassWeights.load(str(tmp_path / "s")).transform(docs).where("weight = 7").count() > 0
