"""Staged metrics that merge, and ensembles cut to their best round."""

import pytest
from pyspark.sql import functions as F

from needlestack.learners import boosting
from needlestack.learners.staged import StagedMetrics
from needlestack.learners.trees import boosted_trees
from needlestack.operators import curves, metrics, prep
from needlestack.queries import learning as q
from needlestack.queries.frames import TEXT_FEATURES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return prep.assemble(q._docs(spark, SF), TEXT_FEATURES).repartition(5).cache()


@pytest.fixture(scope="module")
def model(data):
    return q._boost({"n_estimators": 12}).fit(data)


def values(df, by=("iteration",)):
    return {tuple(r[c] for c in by): r["value"] for r in df.collect()}


def test_merged_metrics_equal_those_of_rows_times_rounds(data, model):
    rows = boosting.staged_scores(model, data, ["y", "fold"]).cache()
    by = ["fold", "iteration"]
    y, p = F.col("y"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    want = {
        "logloss": rows.groupBy(*by).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("value")),
        "error": rows.groupBy(*by).agg(F.avg(((F.col("p") > 0.5) != (y == 1)).cast("double")).alias("value")),
        "f1": rows.groupBy(*by).agg(metrics.f1_loss(y, F.col("p")).alias("value")),
        "auc": curves.roc_auc(rows, "y", "p", by).withColumnRenamed("roc_auc", "value"),
        "map": curves.average_precision(rows, "y", "p", by).withColumnRenamed("average_precision", "value"),
    }
    got = StagedMetrics(model, data, "y", ["fold"], areas=True)
    for name, frame in want.items():
        assert values(got.metric(name), by) == pytest.approx(values(frame, by), rel=1e-12), name
    cells = metrics.confusion(rows.withColumn("z", (F.col("p") > 0.5).cast("int")), "y", "z", by)
    assert sorted(map(tuple, got.cells().collect())) == sorted(map(tuple, cells.select(*got.cells().columns).collect()))


def test_deviance_equals_the_library(data, model):
    got = values(StagedMetrics(model, data, "y").metric("deviance"))
    scored = data.withColumn("y", F.col("y").cast("double"))
    assert got == pytest.approx({(i + 1,): v for i, v in enumerate(model.evaluateEachIteration(scored))}, rel=1e-9)


def test_null_groups_labels_and_empty_frames(data, model):
    spoiled = data.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold"))).withColumn(
        "y", F.when(F.col("doc_id") % 3 != 0, F.col("y")))
    got = StagedMetrics(model, spoiled, "y", ["fold"])
    n = {r.fold: r.n for r in got.sums.where("iteration = 1").collect()}
    assert n == {r.fold: r["count"] for r in spoiled.where("y IS NOT NULL").groupBy("fold").count().collect()}
    assert None in n
    assert StagedMetrics(model, data.where("false"), "y").metric("f1").count() == 0
    with pytest.raises(ValueError):
        got.metric("auc")
    with pytest.raises(ValueError):
        got.metric("typo")


def test_many_rounds_are_one_scan(spark, data):
    few = data.select("y", "features").limit(60)
    model = boosted_trees({"n_estimators": 200, "max_depth": 1, "seed": 1}, labelCol="y").fit(few)
    staged = StagedMetrics(model, data, "y")
    plan = staged.metric("logloss")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert "Generate" not in plan and staged.metric("logloss").count() == 200


@pytest.mark.parametrize("params", [{}, {"subsample": 1.0}, {"max_features": 2.0}])
def test_a_cut_ensemble_equals_the_refit(data, params):
    learner = q._boost({"n_estimators": 7, **params})
    cut, again = boosting.truncated(learner.fit(data), 4), learner.copy().setMaxIter(4).fit(data)
    assert cut.getNumTrees == 4 and cut.getMaxIter() == 4 and cut.numFeatures == again.numFeatures
    assert cut.toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1]
    assert cut.treeWeights == again.treeWeights
    a, b = cut.transform(data).select("doc_id", "probability"), again.transform(data).select("doc_id", "probability")
    assert a.exceptAll(b).count() == 0
    assert list(cut.featureImportances.toArray()) == pytest.approx(list(again.featureImportances.toArray()))
    with pytest.raises(ValueError):
        boosting.truncated(cut, 0)


def test_a_cut_ensemble_is_saved_and_loaded(spark, data, model, tmp_path):
    cut = boosting.truncated(model, 3)
    cut.write().save(str(tmp_path / "cut"))
    again = type(cut).load(str(tmp_path / "cut"))
    assert again.getNumTrees == 3 and again.transform(data).select("probability").exceptAll(
        cut.transform(data).select("probability")).count() == 0


def test_rounds_of_each_fold(data):
    history, _ = boosting.boosting_cv(q._boost({"n_estimators": 5}), data, "fold", 4, 2, "f1")
    best = {r.fold: r.best_iteration for r in boosting.fold_rounds(history, 2, "f1").collect()}
    for fold in range(4):
        losses = [r.value for r in history.where(F.col("fold") == fold).orderBy("iteration").collect()]
        at = 0
        for i, loss in enumerate(losses):
            if loss < losses[at]:
                at = i
            elif i - at >= 2:
                break
        assert best[fold] == at + 1
