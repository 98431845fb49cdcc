"""Models that hold tables and other models: written, read back and scoring the same, inside pipelines too."""

import pytest
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.sql import SparkSession, functions as F

from needlestack.learners.calibrated import SigmoidCalibrated
from needlestack.learners.knn import KNNClassifier
from needlestack.learners.scores import score
from needlestack.learners.stacking import Stacking, stacked_columns
from needlestack.learners.stored import write_part
from needlestack.plans import blind
from needlestack.queries import learning as q
from needlestack.queries.frames import TEXT_FEATURES
from needlestack.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return q._docs(spark, sf).cache()


def reread(model):
    path = scratch_path(SparkSession.active(), "stored")
    model.write().save(path)
    return PipelineModel.load(path), path


def same(model, again, docs):
    a, b = score(model, docs, "p"), score(again, docs, "r")
    both = a.select("doc_id", "p").join(b.select("doc_id", "r"), "doc_id")
    assert both.count() == docs.count() and both.where("NOT p <=> r").count() == 0


def test_neighbours(docs):
    model = q._on_docs(KNNClassifier(k=3, labelCol="y", idCol="doc_id")).fit(docs)
    again, path = reread(model)
    same(model, again, docs)
    index = again.stages[-1].index
    assert index.path.startswith(path) and again.stages[-1].k == 3


def test_calibrated_members_may_be_pipelines_or_hold_tables(docs):
    for classifier in (q._on_docs(q._logit()), q._on_docs(KNNClassifier(k=3, labelCol="y", idCol="doc_id"))):
        model = Pipeline(stages=[SigmoidCalibrated(classifier, "y", "doc_id", k=2)]).fit(docs)
        again, _ = reread(model)
        same(model, again, docs)
        assert [m[1:] for m in again.stages[0].members] == [m[1:] for m in model.stages[0].members]


def test_stacked_within_a_pipeline(docs):
    bases = [q._on_docs(q._tree(), "none"), q._on_docs(q._net(epochs=2))]
    meta = blind.standard_pipeline(stacked_columns(TEXT_FEATURES, bases), q._logit())
    model = Pipeline(stages=[Stacking(bases, meta, "y", "doc_id")]).fit(docs)
    again, _ = reread(model)
    same(model, again, docs)
    assert len(again.stages[0].models) == 2


def test_network_keeps_its_history(docs):
    model = q._on_docs(q._net(epochs=3)).fit(docs)
    again, _ = reread(model)
    same(model, again, docs)
    net, read = model.stages[-1], again.stages[-1]
    assert read.history == net.history and len(read.history) == 3 and read.best_n == net.best_n and read.uid == net.uid


def test_a_model_is_written_over_only_when_told(docs):
    model = q._on_docs(q._net(epochs=1)).fit(docs).stages[-1]
    path = scratch_path(docs.sparkSession, "stored")
    model.save(path)
    with pytest.raises(Exception):
        model.save(path)
    model.write().overwrite().save(path)
    assert type(model).load(path).history == model.history


def test_a_part_that_cannot_be_written_is_named(spark, tmp_path):
    class Plain(Model):
        def _transform(self, dataset):
            return dataset.withColumn("prediction", F.lit(0.0))

    with pytest.raises(TypeError, match="Plain"):
        write_part(spark, Plain(), str(tmp_path / "m"))
