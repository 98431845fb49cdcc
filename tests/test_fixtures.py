"""Hand-computed values on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from needlestack.functions import binarize, finite, id_key, two_class
from needlestack.operators import audit, catalog, curves, history, metrics, neighbors, prep, votes
from needlestack.sources import (
    load_labelled, read_id_list, read_stat_table, scratch_path, without_marker, write_ids,
)
from needlestack.schema import FEATURE_SET_DROPS, STAT_COLUMNS, feature_columns


@pytest.fixture(scope="module")
def six(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.5), (0, 0.2)]
    return spark.createDataFrame([(i, y, p, 0) for i, (y, p) in enumerate(rows)],
                                 "id long, y int, p double, fold int")


def test_confusion_and_f1(six):
    z = six.withColumn("z", binarize("p"))
    r = metrics.prf(metrics.confusion(z, "y", "z")).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 0, 3)
    assert r.precision == 0.75 and r.recall == 1.0 and r.f1 == pytest.approx(6 / 7)


def test_ties_are_dropped(six):
    cut = catalog.threshold_split(six, "p", 0.5)
    z = cut.withColumn("z", F.col("found").cast("int"))
    assert metrics.confusion(z, "y", "z").first().tn == 1
    assert catalog.threshold_split(six, "p", 0.5, "positive").where("found").count() == 5
    assert catalog.threshold_split(six, "p", 0.5, "negative").where("found").count() == 4


@pytest.mark.parametrize("rows_per_bucket", [2, 500_000])
def test_areas(six, rows_per_bucket):
    kw = dict(rows_per_bucket=rows_per_bucket)
    assert curves.roc_auc(six, "y", "p", **kw).first()[0] == pytest.approx(8 / 9)
    assert curves.average_precision(six, "y", "p", **kw).first()[0] == pytest.approx((1 + 1 + 0.75) / 3)


def test_best_f1_threshold(six):
    r = curves.best_f1_threshold(six, "y", "p").first()
    assert r.threshold == 0.5 and r.f1 == pytest.approx(6 / 7)


def test_empty_denominator_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "y int, z int")
    r = metrics.prf(metrics.confusion(df, "y", "z")).first()
    assert r.precision is None and r.recall is None and r.f1 is None


def test_median_and_scale(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (9.0,)], "x double")
    filled = prep.MedianImputer(cols=["x"]).fit(df).transform(df)
    assert [r.x for r in filled.collect()] == [1, 2, 3, 4, 9]
    m = prep.PopulationScaler(cols=["x"]).fit(filled)
    assert m.getValues() == [pytest.approx(3.8)]
    assert m.getSpreads() == [pytest.approx(math.sqrt(7.76))]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("b", 1.0), ("b", 3.0)],
                               "source string, x double")
    got = {(r.source, r.feature): r.n_missing for r in audit.missing_audit(df, ["x"]).collect()}
    assert got == {("a", "x"): 2, ("b", "x"): 0}
    assert prep.MedianImputer(cols=["x"]).fit(df).getValues() == [2.0]
    assert df.where(finite("x")).count() == 2


def test_shift_log(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (float("inf"),), (3.0,)], "CSSD double")
    model = prep.ShiftLog(cols=["CSSD", "absent"]).fit(df)
    got = [r[0] for r in model.transform(df).collect()]
    assert got[0] == pytest.approx(math.log(0.1)) and got[1] == pytest.approx(math.log(2.1))
    assert got[2] is None and got[3] == pytest.approx(math.log(5.1))


@pytest.mark.parametrize("rows_per_bucket", [2, 500_000])
def test_rank_average(spark, rows_per_bucket):
    df = spark.createDataFrame([(1, .1, .2), (2, .4, .1), (3, .4, .8), (4, .9, .9)],
                               "id int, a double, b double")
    got = {r.id: r.rank_score for r in
           votes.rank_average(df, "id", ["a", "b"], rows_per_bucket=rows_per_bucket).collect()}
    assert got == {1: pytest.approx(1 / 6), 2: pytest.approx(1 / 6), 3: 0.5, 4: 1.0}


def test_hard_vote(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0, 0.0)], ["lr", "knn", "gb", "rf", "nn", "svm"])
    w = votes.HARD_VOTE_WEIGHTS
    r = votes.hard_vote(df, list(w), list(w.values()), votes.HARD_VOTE_TOTAL).first()
    assert r.vote == pytest.approx((0.81 + 0.76 + 0.81) / 4.52) and r.prediction == 1.0


def test_catalog_match(spark):
    scored = spark.createDataFrame([("a", .9), ("b", .9), ("c", .9), ("d", .1), ("e", .1), ("f", .1)],
                                   "id string, p double")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    nic = spark.createDataFrame([("x", "1 x"), ("e", "2 e"), ("f", "3 f CST")], "id string, line string")
    r = catalog.catalog_match(scored, ids("a"), ids("b", "d", "x"), nic, "id", "p", probe="c").first()
    assert (r.tp, r.fn, r.tn, r.fp, r.new_found, r.probe_found) == (2, 2, 1, 1, 1, True)
    assert r.precision == pytest.approx(2 / 3) and r.recall == 0.5 and r.f1 == pytest.approx(4 / 7)
    truth = catalog.truth_ids(ids("a"), ids("b", "d", "x"), nic)
    assert {t.id for t in truth.collect()} == {"a", "b", "d", "x", "e"}


def test_inverse_distance(spark):
    near = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 0), (1, 4.0, 1), (2, 0.0, 0), (2, 1.0, 1)],
                                 "query_id int, distance double, y int")
    got = {r.query_id: r.p for r in neighbors.inverse_distance(near, "y").collect()}
    assert got == {1: pytest.approx(1.25 / 1.75), 2: 0.0}


@pytest.mark.parametrize("rows_per_bucket", [2, 500_000])
def test_patience(spark, rows_per_bucket):
    losses = [.9, .7, .8, .6, .65, .61, .5]
    h = spark.createDataFrame([(i + 1, v) for i, v in enumerate(losses)], "iteration int, value double")
    r = history.patience_rule(h, 2, rows_per_bucket=rows_per_bucket).first()
    assert (r.best_iteration, r.best_value, r.last_iteration, r.stopped) == (4, .6, 6, True)
    up = h.withColumn("value", -F.col("value"))
    r = history.patience_rule(up, 2, larger_is_better=True, rows_per_bucket=rows_per_bucket).first()
    assert (r.best_iteration, r.best_value) == (4, -.6)
    r = history.patience_rule(h, 50).first()
    assert (r.best_iteration, r.last_iteration, r.stopped) == (7, 7, False)


def test_reliability(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.4), (1, 0.6), (1, 1.0)], "y int, p double")
    got = {r.bin: (r.mean_score, r.fraction_positive) for r in
           audit.reliability(df, "y", "p", 2, normalize=False).collect()}
    assert got == {0: (pytest.approx(.2), .5), 1: (pytest.approx(.8), 1.0)}


def test_balanced_weight(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {r.y: r.weight for r in prep.class_weights(df, "y").distinct().collect()}
    assert got == {0: pytest.approx(8 / 12), 1: 2.0}
    fixed = {r.y: r.weight for r in prep.class_weights(df, "y", {0: 1, 1: 28}).distinct().collect()}
    assert fixed == {0: 1.0, 1: 28.0}


def test_feature_sets():
    assert [len(feature_columns(s)) for s in "ABC"] == [24, 18, 25]
    assert len(STAT_COLUMNS) == 30 and set(FEATURE_SET_DROPS) == {"A", "B", "C"}


def test_log_files(spark):
    star = "a_b_c_d_181193.dat"
    line = lambda v: " ".join([v if n == "CSSD" else star if n == "star_ID" else "1.5" for n in STAT_COLUMNS])
    paths = []
    for values in (["-2", "+inf"], ["7", "nan", "x"]):
        path = scratch_path(spark, "t")
        spark.createDataFrame([("  " + line(v) + "  extra",) for v in values], "value string").write.text(path)
        paths.append(path)
    df = load_labelled(spark, paths, drop=["Npts"])
    got = sorted((r.variable, r.CSSD is None, r.CSSD or 0) for r in df.collect())
    assert got == [(0, False, -2.0), (0, True, 0), (1, False, 7.0), (1, True, 0), (1, True, 0)]
    assert "Npts" not in df.columns
    assert read_stat_table(spark, paths[0]).select(id_key("star_ID").alias("k")).first().k == "181193"


def test_id_lists(spark):
    def written(*lines):
        path = scratch_path(spark, "ids")
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
        return path
    assert {r.id for r in read_id_list(spark, written("1 x extra", "2 y", "short"), "token2").collect()} == {"x", "y"}
    quoted = written("{'a', ", "\"b\"}", "'c'")
    assert {r.id for r in read_id_list(spark, quoted, "quoted").collect()} == {"a", "b", "c"}
    marked = read_id_list(spark, written("1 x CST", "2 y VAR"), "token2")
    assert [r.id for r in without_marker(marked, "line").collect()] == ["y"]
    path = scratch_path(spark, "out")
    write_ids(spark.createDataFrame([("a_b_c_d_9.dat",)], "star_ID string"), path)
    assert read_id_list(spark, path, "result").first().id == "9"


def test_two_class(spark):
    r = spark.createDataFrame([(0.25,)], "p double").select(two_class("p").alias("v")).first()
    assert r.v == [0.75, 0.25]
