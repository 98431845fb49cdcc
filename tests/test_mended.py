"""Cases that used to be capped, dropped or misread."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from needlestack.learners import mlp, trees
from needlestack.operators import audit, neighbors, skew, split, votes
from needlestack.operators.ordered import running
from needlestack.sources.statlog import read_stat_table


def test_parameters_without_a_counterpart_raise(spark):
    with pytest.raises(ValueError):
        trees.boosted_trees({"max_depth": 40})
    with pytest.raises(ValueError):
        trees.boosted_trees({"min_child_weight": 2})
    with pytest.raises(ValueError):
        trees.boosted_trees({"min_child_weight": 60}, n_rows=100)
    with pytest.warns(UserWarning):
        assert trees.boosted_trees({"gamma": 3.14}).getMinInfoGain() == 0
    assert trees.boosted_trees({"max_features": 3.0}).getFeatureSubsetStrategy() == "3"


def test_null_strata_and_groups_stay(spark):
    df = spark.range(2000).select(F.col("id").alias("i"), F.when(F.col("id") % 10 != 0, F.col("id") % 2).alias("y"))
    assert split.stratified_folds(df, "y", "i", 4).count() == 2000
    steps = df.groupBy("y", (F.col("i") % 7).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("bucket", F.lit(0.0))
    out = running(steps, ["y"], "v", sums=["n"])
    assert out.count() == steps.count() and out.where("y IS NULL").agg(F.max("run_n")).first()[0] == 200


def test_null_groups_stay_in_joins_and_reliability(spark):
    df = spark.range(60).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("g"), (F.col("id") / 60).alias("p"),
                                (F.col("id") % 2).alias("y"))
    got = audit.reliability(df, "y", "p", 4, by=["g"]).groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r.g: r.n for r in got} == {None: 20, 1: 20, 2: 20}
    table = df.groupBy("g").agg(F.max("p").alias("m"), F.count("*").alias("n"))
    for out in (skew.join_small(df, table, ["g"]), skew.join_small(df, table, ["g"], limit=1),
                skew.join_counted(df, table, ["g"], F.col("g").isNull(), ["m"]),
                skew.join_counted(df, table, ["g"], F.col("g") == 1, ["m"])):
        assert out.count() == 60 and out.where("g IS NULL AND m = 0.95").count() == 20


def test_rows_without_scores_keep_their_id(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2), (2, None, None), (3, 0.9, None)], "i int, a double, b double")
    got = {r.i: r.rank_score for r in votes.rank_average(df, "i", ["a", "b"]).collect()}
    assert set(got) == {1, 2, 3} and got[2] == 0.0 and got[3] == 1.0


def test_small_minority_gets_all_rows(spark):
    df = spark.createDataFrame([(i, float(i), 1 if i < 3 else 0) for i in range(23)], "i int, v double, y int")
    assert neighbors.oversample(df, "y", "i", ["v"], 1.0, k=5).count() == 17
    with pytest.raises(ValueError):
        neighbors.oversample(df.where("y = 0 OR i = 0"), "y", "i", ["v"], 1.0, k=5).count()


def test_leading_tab(spark, tmp_path):
    (tmp_path / "log").write_text("\t1 2 x\n 3\t4 y \n\n")
    rows = read_stat_table(spark, str(tmp_path / "log"), ["a", "b", "name"], id_col="name").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, "x"), (3.0, 4.0, "y")]


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_network_is_the_same_however_rows_are_spread(spark, dropout):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("label"), F.col("id") % 5 == 0,
                                 array_to_vector(F.array((F.col("id") % 7) / 7.0, (F.col("id") % 2) * 0.5)).alias("features"))
    df = df.withColumn("held", F.pmod("row_id", F.lit(5)) == 0)
    fit = lambda parts, rows: mlp.DenseNetwork(hidden=(5, 3), dropout=(dropout, dropout), batch=100, epochs=3, partitions=parts,
                                               validCol="held").fit(rows)
    models = [fit(None, df), fit(2, df), fit(8, df.repartition(3)), fit(70, df)]
    for m in models[1:]:
        assert m.getOrDefault("weights") == pytest.approx(models[0].getOrDefault("weights"), abs=1e-10)
        assert m.history[-1] == pytest.approx(models[0].history[-1], abs=1e-10)


def test_network_steps_are_bounded_and_equal_one_machine(spark):
    """One step an epoch over all rows is plain gradient descent, whatever the batch asks for."""
    import numpy as np
    x = np.random.default_rng(0).normal(size=(50, 3)).astype(np.float32)
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    net = mlp.DenseNetwork(hidden=(4,), dropout=(0.0,), max_norm=(0.0,), lr=0.5, momentum=0.9, batch=1, max_steps=1, epochs=5)
    got, layers = net.fit(df).getOrDefault("weights"), [3, 4, 1]
    rng, flat = np.random.default_rng(1), np.zeros(mlp._size([3, 4, 1]))
    for w, _ in mlp._unpack(flat, layers):
        w[:] = rng.uniform(-1, 1, w.shape) * np.sqrt(6.0 / sum(w.shape))
    v = np.zeros_like(flat)
    for _ in range(5):
        v = 0.9 * v - 0.5 * mlp._gradient(flat, layers, x.astype(float), y, np.ones(50), (0.0,))
        flat = flat + v
    assert got == pytest.approx(flat.tolist(), abs=1e-9)


def test_rows_shuffle_once_in_windows(spark, tmp_path):
    """The window and the join to the bucket totals share one partitioning; NULL groups cost nothing."""
    from needlestack.operators.ordered import hashed_ordinal, with_bucket
    spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 1000).alias("v"), F.col("id").alias("n")).write.parquet(
        str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count = lambda made: made._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        assert count(running(with_bucket(df, "v", [0.2, 0.5]), ["g"], "v", sums=["n"])) == 4
        assert count(running(with_bucket(df, "v", []), ["g"], "v", sums=["n"])) == 3
        assert count(hashed_ordinal(df.withColumn("seed", F.lit(1)), ["seed", "g"], "n", "seed")) == 4
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
