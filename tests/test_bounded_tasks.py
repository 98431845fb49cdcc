"""What a task holds or moves stays bounded, or grows no faster than the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from needlestack.operators import approximate, neighbors


def vectors(spark, n, dim=6, kind="array<float>", seed=2):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    return df.withColumn("vec", F.col("vec").cast(kind))


def rows(df):
    return {(r.query_id, r.neighbor_id, round(r.distance, 9), r["rank"]) for r in df.collect()}


def test_queries_are_not_written_once_a_bucket(spark, monkeypatch):
    written, plans = [], []
    real, compare = approximate.materialize, approximate._compare
    monkeypatch.setattr(approximate, "materialize", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    monkeypatch.setattr(approximate, "_compare", lambda t, q, *a: plans.append((t, q)) or compare(t, q, *a))
    df = vectors(spark, 2000)
    many = approximate.approximate_nearest(df, df, 4, "vec", "id", True, target=0.99, bucket_rows=8)
    assert many.first()["probes"] > 2 and plans[0][1].count() == 2000      # chunks move fewer rows than buckets
    few = approximate.approximate_nearest(df, df, 4, "vec", "id", True, target=0.3, bucket_rows=8, block_rows=50)
    assert plans[1][1].count() == 2000 * 4 * few.first()["probes"]
    assert {name: out.count() for name, out in written if name != "lsh_result"} == {"lsh_rows": 2000, "lsh_queries": 2000}


@pytest.mark.parametrize("target", [0.3, 0.6])
def test_chunks_meet_the_rows_that_buckets_meet(spark, target, monkeypatch):
    df = vectors(spark, 1500, 3)
    find = lambda **kw: approximate.approximate_nearest(df, df, 3, "vec", "id", True, target=target, bucket_rows=16, **kw)
    layouts, compare = [], approximate._compare
    monkeypatch.setattr(approximate, "_compare", lambda *a: layouts.append(a[-1] is not None) or compare(*a))
    assert rows(find()) == rows(find(block_rows=2))
    assert layouts == [True, False]


def test_repeated_rows_take_no_places_of_others(spark):
    df = vectors(spark, 300, 3)
    many = df.union(df).union(df)
    found = approximate.approximate_nearest(many, many, 4, "vec", "id", True, bucket_rows=64)
    assert found.count() == 1200 and found.where("query_id = neighbor_id").count() == 0


def test_queries_of_a_cell_go_to_chunks_of_bounded_size(spark, monkeypatch):
    plans, compare = [], neighbors._compare
    monkeypatch.setattr(neighbors, "_compare", lambda t, q, plan, *a: plans.append(plan.first()) or compare(t, q, plan, *a))
    neighbors.nearest(spark.range(60_000).select("id", F.array(F.col("id").cast("double")).alias("vec")),
                      vectors(spark, 100, 1), 2, "vec", "id")
    df = vectors(spark, 4000)
    near = neighbors.nearest(df, df, 3, "vec", "id", True)
    assert plans[0]["q_chunks"] >= 3 and plans[1]["q_chunks"] == 4
    x = np.array([r.vec for r in df.orderBy("id").collect()])
    for r in near.where("query_id < 40 AND rank = 1").collect():
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(axis=1))
        d[r.query_id] = np.inf
        assert r.neighbor_id == d.argmin() and r.distance == pytest.approx(d.min(), abs=1e-12)


def test_floats_travel_as_floats_with_the_same_result(spark):
    single, double = vectors(spark, 800), vectors(spark, 800, kind="array<double>")
    assert neighbors._vector(single, "vec")._jc.toString() != neighbors._vector(double, "vec")._jc.toString()
    kw = dict(block_rows=100, query_rows=150)
    a, b = (neighbors.nearest(df, df, 5, "vec", "id", True, **kw) for df in (single, double))
    assert rows(a) == rows(b)


def test_pivots_times_rows_of_a_task_are_cut(monkeypatch):
    import pandas as pd
    seen = []
    real = neighbors._pivot_distances
    monkeypatch.setattr(neighbors, "_pivot_distances", lambda x, p: seen.append(len(x) * len(p)) or real(x, p))
    monkeypatch.setattr(neighbors, "PAIRS_AT_ONCE", 500)
    pivots, v = np.arange(50.0)[:, None], pd.Series([[float(i)] for i in range(90)])
    cell = pd.concat(neighbors._cell_udf(pivots).func(iter([v])))
    ones = np.ones(50)
    cells = pd.concat(neighbors._targets_udf(pivots, 0 * ones, ones, ones, ones.astype(int), 1).func(iter([v])))
    assert max(seen) <= 500 and cell["cell"].tolist() == [min(i, 49) for i in range(90)] and len(cells) == 90


# ---------------------------------------------------------------- learners, orders, logs

def _labelled(spark, n):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(n).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                               (F.col("id") % 7 > 4).cast("double").alias("y"), F.lit(1.0).alias("weight"), "id")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


@pytest.mark.parametrize("name", ["decision_tree", "random_forest", "boosted_trees"])
@pytest.mark.parametrize("n_rows", [None, 900])
def test_training_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch, name, n_rows):
    from needlestack.learners import trees
    frame = type(spark.range(0))
    dealt, real = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *c: dealt.append(n) or real(df, n, *c))
    df = _labelled(spark, 900).coalesce(1)
    learner = getattr(trees, name)({"max_depth": 3, "seed": 1}, n_rows, labelCol="y", weightCol="weight")
    learner.fit(df)
    assert not dealt                                            # small tables stay as they lie
    monkeypatch.setattr(trees, "TASK_BYTES", 4000)
    model = learner.copy().fit(df)
    assert dealt and 900 / dealt[0] <= 4000 / trees.ROW_BYTES
    hits = model.transform(df).where("prediction = y").count()
    assert hits == 900


def test_the_order_moves_no_digests(spark):
    from pyspark.sql import Window
    from needlestack.operators.ordered import hashed_ordinal
    df = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("y"), F.lit(3).alias("seed"))
    out = hashed_ordinal(df, ["seed", "y"], "id", "seed", digits=1, lean=True)
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line and "__b" in line and "id#" in "".join(plan[i:i + 2])]
    assert shuffles and not any("__h" in line for i in shuffles for line in plan[i:])
    w = Window.partitionBy("y").orderBy(F.md5(F.concat_ws(":", F.lit("3"), "id")), "id")
    want = {(r.id, r.n) for r in df.select("id", F.row_number().over(w).alias("n")).collect()}
    assert {(r.id, r.ordinal) for r in out.collect()} == want


def test_log_text_is_split_once(spark, sf, monkeypatch):
    from needlestack.queries import relational
    written = []
    monkeypatch.setattr(relational, "materialize", lambda df, name, f=relational.materialize: written.append(name) or f(df, name))
    out = relational.labelled_load_shift_log(spark, sf)
    files = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    assert written == ["labelled"] and all(f.startswith("labelled-") for f in files)


def test_trimming_knows_all_white_space(spark, tmp_path):
    from needlestack.sources.statlog import read_stat_table
    (tmp_path / "log").write_text(" \t\x0b\f1 2\t\x0bx\f \n \f\x0b\t \n3  4 y\n")
    got = read_stat_table(spark, str(tmp_path / "log"), ["a", "b", "name"], id_col="name").collect()
    assert sorted((r.a, r.b, r.name) for r in got) == [(1.0, 2.0, "x"), (3.0, 4.0, "y")]


def test_rows_are_grouped_by_score_once(spark):
    from needlestack.operators import curves
    df = spark.range(300).select((F.col("id") % 3).alias("y"), (F.col("id") % 17 / 17.0).alias("p"), (F.col("id") % 2).alias("g"))
    steps = curves.score_steps(df, "y", "p", ["g"])
    assert all("/steps-" in f for f in steps.inputFiles()) and steps.inputFiles()


# ---------------------------------------------------------------- F11: tuned_blind_scoring

def _folded(spark, n):
    return spark.range(n).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                 ((F.col("id") % 7 > 4) & (F.col("id") % 5 > 0)).cast("int").alias("y"),
                                 F.pmod(F.hash("id"), F.lit(3)).alias("fold"), F.col("id").cast("string").alias("name"))


def test_rows_are_dealt_and_prepared_once_for_all_sets(spark, monkeypatch):
    from needlestack.learners import trees
    from needlestack.plans import blind, search, shared
    frame = type(spark.range(0))
    df, sets = _folded(spark, 900), [{"max_depth": 2, "scale_pos_weight": w} for w in (1.0, 3.0, 9.0)]
    frames = shared.FoldFrames(df, ["a", "b"], "fold", 3, "y", scale=False)
    want = search.run_trials(shared.boosted_objective(frames, 3, 2), sets)
    assert shared.boosted_search(frames, sets, 3, 2) == want
    dealt, kept, gone = [], [], []
    deal, keep, drop = frame.repartition, frame.persist, frame.unpersist
    monkeypatch.setattr(frame, "repartition", lambda d, n, *c: dealt.append(n) or deal(d, n, *c))
    monkeypatch.setattr(frame, "persist", lambda d, *a: kept.append(d.columns) or keep(d, *a))
    monkeypatch.setattr(frame, "unpersist", lambda d, *a: gone.append(d.columns) or drop(d, *a))
    monkeypatch.setattr(trees, "TASK_BYTES", 30_000)
    ids = df.limit(0).select(F.col("name").alias("id"))
    trials, out = blind.tuned_blind_scoring(df, df, ids, ids, ids.withColumn("line", F.lit("")), ["a", "b"], "y", "name",
                                            sets, k=3, rounds=3, patience=2, scale=False)
    assert len(dealt) == 1 and 900 / dealt[0] <= 30_000 / trees.ROW_BYTES
    assert [c for c in kept if "weight" not in c] == [["a", "b", "y", "fold"], *3 * [["features", "y"]]]
    assert sorted(gone) == sorted(kept) and len(kept) == 5
    assert [r.loss for r in trials.orderBy("trial_id").collect()] == pytest.approx([t["loss"] for t in want])
    assert out.first()["fp"] > 0


def test_failed_and_logged_sets_of_a_boosted_search(spark):
    from needlestack.plans import shared
    from needlestack.plans.trials import TrialLog
    from needlestack.sources import scratch_path
    frames = shared.FoldFrames(_folded(spark, 300), ["a", "b"], "fold", 3, "y")
    sets, path = [{"max_depth": 1}, {"no_such": 1}, {"max_depth": 2}], scratch_path(spark, "trials")
    found = shared.boosted_search(frames, sets, 2, 1, parallelism=2, log=TrialLog(spark, path))
    assert [t["status"] for t in found] == ["done", "failed", "done"] and "no_such" in found[1]["error"]
    frames.k = 0                                                    # logged trials need no fold
    again = shared.boosted_search(frames, sets, 2, 1, log=TrialLog(spark, path))
    assert [(t["loss"], t["status"]) for t in again] == [(t["loss"], t["status"]) for t in found]
    frames.k = 3
    with pytest.raises(RuntimeError):
        shared.boosted_search(frames, sets[1:2], 2, 1)


@pytest.mark.parametrize("ties", ["drop", "positive", "negative"])
def test_the_match_scores_a_row_once(spark, ties):
    from needlestack.operators import catalog
    rows = [("a", 0.9), ("b", 0.5), ("c", 0.1), ("d", None), ("e", float("nan")), ("b", 0.2), (None, 0.7)]
    scored = spark.createDataFrame(rows, "id string, p double").withColumn("p", F.udf(lambda v: v, "double")("p"))
    ids = spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    out = catalog.catalog_match(scored, ids, ids, ids.withColumn("line", F.lit("x")), "id", "p", 0.5, ties)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<lambda>(") == 1
    split = catalog.threshold_split(spark.createDataFrame(rows, "id string, p double"), "p", 0.5, ties)
    hits = {r.id for r in split.where("found").collect()}
    missed = {r.id for r in split.where("NOT found").collect()}
    row, true = out.first(), {"a", "b", "d"}
    assert (row.tp, row.fp, row.fn, row.tn, row.new_found) == (
        len(hits & true), len(hits - true), len(missed & true), len(missed - true), len(hits & true))
