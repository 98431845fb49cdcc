"""Invariants of learners, ensembles and searches."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from needlestack.learners import boosting, trees
from needlestack.learners.calibrated import SigmoidCalibrated, sigmoid_fit
from needlestack.learners.linear import PenalisedLogistic
from needlestack.learners.mlp import DenseNetwork, network_from_trial
from needlestack.learners.scores import score
from needlestack.learners.stacking import Stacking, stacked_columns
from needlestack.operators import curves, metrics, prep
from needlestack.plans import blind, evaluate, search, spaces
from needlestack.queries import learning as q
from needlestack.queries.frames import TEXT_FEATURES
from needlestack.sources import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return q._docs(spark, SF).cache()


def auc(scored, label="y"):
    return curves.roc_auc(scored, label, "p").first()[0]


@pytest.mark.parametrize("name", ["logistic", "forest", "boost", "svm", "net", "tree"])
def test_learner_separates_held_out_rows(docs, name):
    est = {"logistic": lambda: q._on_docs(q._logit()), "forest": lambda: q._on_docs(q._forest(), "none"),
           "boost": lambda: q._on_docs(q._boost(), "none"), "svm": lambda: q._on_docs(q._svm()),
           "net": lambda: q._on_docs(q._net()),
           "tree": lambda: q._on_docs(q._tree({"max_depth": 4}), "none")}[name]()
    out = q._held_out(est, docs, "doc_id", "y").cache()
    assert out.count() == docs.count()
    if name != "svm":
        assert out.where("p < 0 or p > 1 or p is null").count() == 0
    assert auc(out.where("held_out")) >= 0.8


def test_scoring_leaves_the_columns_alone(docs):
    model = q._on_docs(q._logit()).fit(docs)
    once = score(model, docs, "p")
    assert once.drop("p").exceptAll(docs).count() == 0
    again = score(model, once, "again")
    assert again.where("p <> again").count() == 0


def test_duplicate_row_equals_weight_two(docs):
    data = prep.assemble(docs.select("y", *TEXT_FEATURES), TEXT_FEATURES)
    twice = data.where("y = 1").union(data)
    weighted = data.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    a = PenalisedLogistic(C=0.01, labelCol="y", tol=1e-10).fit(twice)
    b = PenalisedLogistic(C=0.01, labelCol="y", weightCol="w", tol=1e-10).fit(weighted)
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), rtol=1e-3, atol=1e-5)


def test_same_seed_same_network(docs):
    fit = lambda d: q._on_docs(q._net(epochs=3)).fit(d).stages[-1].getOrDefault("weights")
    assert np.allclose(fit(docs), fit(docs.repartition(7)), atol=1e-9)


def test_network_gradient_is_right():
    from needlestack.learners.mlp import _gradient, _loss, _size, forward
    rng = np.random.default_rng(0)
    layers = [3, 4, 2, 1]
    flat, x = rng.normal(size=_size(layers)), rng.normal(size=(9, 3))
    y, w = (rng.random(9) < 0.5).astype(float), rng.random(9) + 0.5
    f = lambda z: _loss(forward(z, layers, x), y, w) / w.sum()
    got = _gradient(flat, layers, x, y, w, (0.0, 0.0), rng)
    for i in range(len(flat)):
        e = np.zeros_like(flat); e[i] = 1e-6
        assert got[i] == pytest.approx((f(flat + e) - f(flat - e)) / 2e-6, abs=1e-6)


def test_network_depth_follows_trial():
    two = {f"{s}_{i}": 1 for s in ("width", "dropout", "max_norm") for i in (1, 2)}
    assert len(network_from_trial(two).args["hidden"]) == 2
    three = {**two, "width_3": 5, "dropout_3": 0.1, "max_norm_3": 2}
    assert network_from_trial(three).args["hidden"] == (1, 1, 5)


def test_staged_scores_end_at_the_model(docs):
    data = prep.assemble(docs, TEXT_FEATURES)
    model = q._boost({"n_estimators": 5}).fit(data)
    last = boosting.staged_scores(model, data, ["doc_id"]).where("iteration = 5")
    both = last.join(score(model, data, "full").select("doc_id", "full"), "doc_id")
    assert both.where(F.abs(F.col("p") - F.col("full")) > 1e-9).count() == 0
    dev = boosting.staged_deviance(model, {"train": data}, "y").collect()
    hist = boosting.training_history(model, {"train": data}, "y", ["logloss"]).collect()
    want = {r.iteration: r.value for r in dev}
    # The library's loss is on the margin 2F, twice the log loss of p, with weights 1 here.
    plain = data.withColumn("weight", F.lit(1.0))
    dev = {r.iteration: r.value for r in boosting.staged_deviance(model, {"t": plain}, "y").collect()}
    assert len(want) == 5
    for r in hist:
        assert dev[r.iteration] == pytest.approx(2 * r.value, rel=1e-6)


def test_early_stopping_keeps_best_round(docs):
    data = prep.assemble(docs, TEXT_FEATURES).withColumn("valid", F.col("fold") == 0)
    m = boosting.EarlyStoppedGBT(q._boost({"n_estimators": 6}), patience=2, metric="auc").fit(data)
    values = {r.iteration: r.value for r in m.history.collect()}
    assert m.getNumTrees == m.best_n and len(values) == 6
    assert boosting.refit(q._boost(), data, 4).getNumTrees == 5


def test_auc_equals_evaluator(docs):
    model = q._on_docs(q._logit()).fit(docs)
    made = model.transform(docs)
    want = BinaryClassificationEvaluator(labelCol="y", numBins=0).evaluate(made)
    assert auc(score(model, docs, "p")) == pytest.approx(want, abs=1e-9)


def test_stacking_without_bases_is_the_meta_learner(docs):
    meta = q._on_docs(q._logit())
    st = Stacking([], meta, "y", "doc_id")
    _, half = st.fit_bases(docs)
    a = score(st.fit(docs), docs, "p").select("doc_id", "p")
    b = score(meta.fit(half), docs, "r").select("doc_id", "r")
    assert a.join(b, "doc_id").where(F.abs(F.col("p") - F.col("r")) > 1e-6).count() == 0


def test_stacking_saves_and_loads(docs):
    bases = [q._on_docs(q._tree(), "none")]
    meta = blind.standard_pipeline(stacked_columns(TEXT_FEATURES, bases), q._logit())
    model = Stacking(bases, meta, "y", "doc_id").fit(docs)
    path = scratch_path(docs.sparkSession, "stack")
    model.save(path)
    again = type(model).load(path, 1)
    a, b = score(model, docs, "p"), score(again, docs, "r")
    assert a.select("doc_id", "p").join(b.select("doc_id", "r"), "doc_id").where("p <> r").count() == 0


def test_calibration_is_monotone_and_bounded(docs):
    est = SigmoidCalibrated(q._on_docs(q._logit()), "y", "doc_id", k=3)
    out = score(est.fit(docs.drop("fold")), docs, "p").cache()
    assert out.where("p < 0 or p > 1").count() == 0 and auc(out) >= 0.9
    slope, _ = sigmoid_fit(out, "y", "p")
    assert slope > 0


def test_fold_statistics_never_see_the_test_fold(docs):
    poisoned = docs.withColumn("words", F.when(F.col("fold") == 0, 1e9).otherwise(F.col("words")))
    a = prep.FoldSafe.fit(docs, ["words"], "fold", 4)
    b = prep.FoldSafe.fit(poisoned, ["words"], "fold", 4)
    assert a.medians["words", 0] == b.medians["words", 0] and a.means["words", 0] == b.means["words", 0]
    assert a.means["words", 1] != b.means["words", 1]
    model = prep.MedianImputer(cols=["words"]).fit(docs.where("fold <> 0"))
    assert model.getValues() == [a.medians["words", 0]]
    same = a.frame(docs, 0).where("fold = 0").select("doc_id", "words").join(
        a.held_out(docs).select("doc_id", F.col("words").alias("w")), "doc_id")
    assert same.where("words <> w").count() == 0


def test_pooled_f1_equals_f1_of_pooled_rows(docs):
    oof = evaluate.oof_predict(q._on_docs(q._tree(), "none"), docs, "fold", 4, "y", ["doc_id"])
    z = oof.withColumn("z", (F.col("p") > 0.5).cast("int"))
    a = metrics.prf(metrics.pooled(metrics.confusion(z, "y", "z", ["fold"]))).first().f1
    assert a == metrics.prf(metrics.confusion(z, "y", "z")).first().f1
    assert oof.select("doc_id").distinct().count() == docs.count()


def test_saved_pipeline_scores_the_same(docs):
    steps = [prep.ShiftLog(cols=["words"]), prep.LogColumns(cols=["lines"]),
             *q._on_docs(q._logit()).getStages()]
    model = Pipeline(stages=steps).fit(docs)
    path = scratch_path(docs.sparkSession, "pipe")
    model.write().save(path)
    a, b = score(model, docs, "p"), score(PipelineModel.load(path), docs, "r")
    assert a.select("doc_id", "p").join(b.select("doc_id", "r"), "doc_id").where("p <> r").count() == 0


def test_scaler_options(docs):
    for kind in ("minmax", "robust", "maxabs"):
        m = Pipeline(stages=prep.scaler_stages(["words", "lines"], kind)).fit(docs)
        v = m.transform(docs).select(vector_to_array("features")[0].alias("v")).agg(F.min("v"), F.max("v")).first()
        assert v[0] < v[1]


def test_parameter_names():
    assert trees.boosted_trees({"learning_rate": 0.1, "n_estimators": 7, "subsample": 0.5}).getMaxIter() == 7
    assert trees.random_forest({"max_features": 3}).getFeatureSubsetStrategy() == "3"
    assert trees.boosted_trees({"min_child_weight": 2}, n_rows=100).getMinWeightFractionPerNode() == 0.02
    with pytest.warns(UserWarning):
        trees.boosted_trees({"reg_lambda": 1})
    with pytest.raises(ValueError):
        trees.boosted_trees({"typo": 1})
    with pytest.raises(ValueError):
        trees.boosted_trees({"scale_pos_weight": 6})


def test_importance_tables(docs):
    data = prep.assemble(docs, TEXT_FEATURES)
    model = q._boost({"n_estimators": 2}).fit(data)
    gain = {r.feature: r.importance for r in trees.importances(model, TEXT_FEATURES).collect()}
    used = {r.feature: r.importance for r in trees.importances(model, TEXT_FEATURES, "splits").collect()}
    assert set(gain) == set(used) == set(TEXT_FEATURES) and sum(gain.values()) == pytest.approx(1)
    inner = trees.tree_rules(model, TEXT_FEATURES).where("feature is not null").count()
    assert sum(used.values()) == inner
    imp = trees.importances(model, TEXT_FEATURES)
    kept = evaluate.select_by_importance(docs, imp, max(gain.values()), "doc_id")
    assert len(kept.columns) == 2


def test_spaces_and_conditional_branches():
    draws = spaces.sample_space(spaces.PRESETS["mlp"], 40, seed=3)
    assert draws == spaces.sample_space(spaces.PRESETS["mlp"], 40, seed=3)
    with_branch = [d for d in draws if "width_3" in d]
    assert 0 < len(with_branch) < 40
    assert all((d["third_layer"] == 1.0) == ("width_3" in d) for d in draws)
    for d in spaces.sample_space(spaces.PRESETS["gbt_f1"], 20):
        assert 4 <= d["max_depth"] <= 11 and np.exp(-4.7) <= d["learning_rate"] <= np.exp(-1.25)
        assert d["scale_pos_weight"] % 2 == 0


def test_adaptive_search_finds_the_minimum(spark):
    space = {"x": spaces.Uniform(-5, 5), "kind": spaces.Choice(({}, {"z": spaces.Uniform(0, 1)}))}
    f = lambda p: {"loss": (p["x"] - 2) ** 2 + (0.0 if "z" in p else 1.0), "attachments": {"n": 1}}
    t = search.adaptive_search(spark, f, space, 60, batch=5, startup=10, parallelism=1)
    best = search.best_trial(t).first()
    assert t.count() == 60 and abs(best.params["x"] - 2) < 0.5 and "z" in best.params
    late = t.where("trial_id >= 30").agg(F.avg("loss")).first()[0]
    early = t.where("trial_id < 10").agg(F.avg("loss")).first()[0]
    assert late < early


def test_grid_covers_every_point(spark):
    t = search.grid_search(spark, lambda p: p["a"] * p["b"], {"a": [1, 2], "b": [3, 4, 5]})
    assert t.count() == 6 and search.best_trial(t).first().loss == 3.0


def test_oversample_lies_between_minority_rows(spark):
    from needlestack.operators.neighbors import oversample
    rows = [(i, 1, float(i), 0.0) for i in range(10)] + [(100 + i, 0, 0.0, 9.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    new = oversample(df, "y", "id", ["a", "b"], 0.1, k=3)
    r = new.agg(F.count("*").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("b").alias("b")).first()
    assert r.n == 30 and 0 <= r.lo and r.hi <= 9 and r.b == 0
