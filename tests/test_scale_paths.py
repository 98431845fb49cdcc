"""The bucketed, bracketed and partitioned routes against plain brute force, with hot keys."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from needlestack.operators import curves, ordered, quantiles, skew, split
from needlestack.operators.neighbors import nearest


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one score."""
    rng = np.random.default_rng(3)
    p = np.where(rng.random(3000) < 0.34, 0.25, np.round(rng.random(3000), 3))
    y = (rng.random(3000) < p).astype(int)
    return spark.createDataFrame([(i, int(a), float(b), i % 3) for i, (a, b) in enumerate(zip(y, p))],
                                 "id long, y int, p double, g int").cache()


def test_bucketed_steps_equal_plain_window(skewed):
    few = curves.score_steps(skewed, "y", "p", ["g"], rows_per_bucket=100)
    one = curves.score_steps(skewed, "y", "p", ["g"])
    assert few.exceptAll(one).count() == 0 and one.exceptAll(few).count() == 0


def test_auc_matches_numpy(skewed):
    rows = skewed.collect()
    pos = np.array([r.p for r in rows if r.y]); neg = np.array([r.p for r in rows if not r.y])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = curves.roc_auc(skewed, "y", "p", rows_per_bucket=200).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_hashed_ordinal_is_the_global_order(skewed):
    df = skewed.withColumn("seed", F.lit(5))
    got = ordered.hashed_ordinal(df, ["seed", "y"], "id", "seed", digits=2)
    w = Window.partitionBy("y").orderBy(F.md5(F.concat_ws(":", F.lit("5"), "id")), "id")
    want = df.withColumn("want", F.row_number().over(w)).select("id", "want")
    assert got.join(want, "id").where("ordinal <> want").count() == 0


def test_exact_medians_through_the_bracket(skewed):
    exprs = {"p": F.col("p"), "odd": F.when(F.col("g") != 1, F.col("p") * F.col("id")),
             "none": F.lit(None).cast("double"), "hot": F.when(F.col("p") == 0.25, F.col("p"))}
    got = quantiles.exact_medians(skewed, exprs, distinct_limit=40, accuracy=100)
    rows = skewed.collect()
    assert got["p"] == pytest.approx(np.median([r.p for r in rows]))
    assert got["odd"] == pytest.approx(np.median([r.p * r.id for r in rows if r.g != 1]))
    assert got["none"] is None and got["hot"] == 0.25


def test_join_counted_splits_hot_keys(spark, skewed):
    table = skewed.groupBy("p").agg(F.count("*").alias("n")).withColumn("v", F.col("p") * 2)
    got = skew.join_counted(skewed, table, ["p"], F.col("n") > 500, ["v"])
    assert got.count() == skewed.count() and got.where("v <> p * 2").count() == 0


def test_join_small_beyond_its_limit(skewed):
    table = skewed.groupBy("g").agg(F.max("p").alias("m"))
    a = skew.join_small(skewed, table, ["g"])
    b = skew.join_small(skewed, table, ["g"], limit=1)
    assert a.select(*b.columns).exceptAll(b).count() == 0 and b.count() == skewed.count()


def test_folds_are_stratified_and_repeatable(skewed):
    a = split.stratified_folds(skewed, "y", "id", 4, [1, 9])
    per = a.groupBy("seed", "y", "fold").count().groupBy("seed", "y").agg(
        (F.max("count") - F.min("count")).alias("gap")).agg(F.max("gap")).first()[0]
    assert per <= 1 and a.count() == 2 * skewed.count()
    again = split.stratified_folds(skewed.repartition(5), "y", "id", 4, [1, 9])
    assert a.exceptAll(again.select(*a.columns)).count() == 0


def test_train_subsets_nest(skewed):
    s = split.train_subsets(skewed, "y", "id", (0.2, 0.6, 1.0))
    n = {f: s.where(F.col("min_fraction") <= f).count() for f in (0.2, 0.6, 1.0)}
    assert n[0.2] < n[0.6] < n[1.0] == skewed.count()


@pytest.mark.parametrize("block_rows,query_rows", [(40, 70), (20_000, 100_000)])
@pytest.mark.parametrize("exclude", [True, False])
def test_nearest_equals_brute_force(spark, block_rows, query_rows, exclude):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 3)), rng.normal(size=(100, 3)) * 0.1 + 4,
                   np.tile([1.0, 1.0, 1.0], (120, 1))])        # a third are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = nearest(df, df, 5, "v", "id", exclude_self=exclude, block_rows=block_rows,
                  query_rows=query_rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.neighbor_id)
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(len(x)), d)) if not (exclude and j == i)][:5]
        assert found[i] == want


def test_nearest_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    got = nearest(df, df, 6, "v", "id", exclude_self=True).collect()
    assert sorted((r.query_id, r.neighbor_id) for r in got) == [(1, 2), (2, 1)]


def test_mean_curve_matches_interpolation(skewed):
    got = {r.i: r.y for r in curves.mean_curve(skewed, "roc", "y", "p", "g", rows_per_bucket=150).collect()}
    total = np.zeros(100)
    grid = np.linspace(0, 1, 100)
    for g in range(3):
        rows = [r for r in skewed.collect() if r.g == g]
        t = sorted({r.p for r in rows}, reverse=True)
        n1 = sum(r.y for r in rows); n0 = len(rows) - n1
        fpr = [0.0] + [sum(r.p >= c and not r.y for r in rows) / n0 for c in t]
        tpr = [0.0] + [sum(r.p >= c and r.y for r in rows) / n1 for c in t]
        total += np.interp(grid, fpr, tpr)
    total /= 3
    total[0], total[-1] = 0.0, 1.0
    assert sorted(got) == list(range(100))
    assert np.allclose([got[i] for i in range(1, 99)], total[1:99], atol=1e-9)
