"""Neighbours by random-projection buckets: recall against brute force, hot buckets, empty sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from needlestack.operators.approximate import approximate_nearest, scan_nearest
from needlestack.operators.neighbors import nearest

SCHEMA = "id long, vec array<double>, y double"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, list(map(float, v)), float(i % 2)) for i, v in enumerate(x)], SCHEMA)


def pairs(df):
    return {(r.query_id, r.neighbor_id) for r in df.select("query_id", "neighbor_id").collect()}


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    return rng.normal(size=(40, 12))[rng.integers(0, 40, 3000)] + rng.normal(scale=0.4, size=(3000, 12))


def test_recall_is_reached_and_told_truly(spark, cloud):
    df = table(spark, cloud)
    found = approximate_nearest(df, df, 5, "vec", "id", True, ["y"], bucket_rows=64)
    exact = pairs(nearest(df, df, 5, "vec", "id", True))
    rows = found.collect()
    share = len(exact & {(r.query_id, r.neighbor_id) for r in rows}) / len(exact)
    told = {r.recall for r in rows}
    assert len(told) == 1 and share >= 0.9 and abs(told.pop() - share) < 0.06
    assert all(r.y == float(r.neighbor_id % 2) and r.query_id != r.neighbor_id for r in rows)
    for r in rows[:200]:
        assert r.distance == pytest.approx(np.linalg.norm(cloud[r.query_id] - cloud[r.neighbor_id]))
    ranks = {}
    for r in rows:
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_fewer_rows_are_met_than_by_comparing_all(spark, cloud):
    df = table(spark, cloud)
    low = approximate_nearest(df, df, 5, "vec", "id", True, target=0.5, bucket_rows=64).first()
    high = approximate_nearest(df, df, 5, "vec", "id", True, target=0.99, bucket_rows=64).first()
    assert low.probes < high.probes and low.recall <= high.recall


def test_copies_of_one_vector_fill_no_single_task(spark):
    x = np.vstack([np.ones((900, 4)), np.random.default_rng(1).normal(size=(100, 4))])
    df = table(spark, x)
    found = approximate_nearest(df, df.where("id % 50 = 0"), 3, "vec", "id", bucket_rows=32, block_rows=7, query_rows=100)
    copies = found.where("query_id < 900")
    assert copies.groupBy("query_id").count().agg(F.min("count"), F.max("count"), F.count("count")).first()[:] == (3, 3, 900)
    assert {r.neighbor_id for r in copies.select("neighbor_id").distinct().collect()} == {0, 50, 100}


def test_a_scan_of_all_rows_is_exact(spark, cloud):
    df = table(spark, cloud)
    some = df.where("id % 300 = 0")
    asked = some.select("id", "vec").toPandas()
    found = scan_nearest(asked, df.select("id", "vec"), 7, True, "bigint")
    assert pairs(found) == pairs(nearest(some, df, 7, "vec", "id", True))


@pytest.mark.parametrize("queries, rows", [(0, 20), (20, 0), (0, 0), (20, 1)])
def test_empty_sides_and_null_vectors(spark, cloud, queries, rows):
    q, t = table(spark, cloud[:queries]), table(spark, cloud[:rows], 1000)
    nulls = spark.createDataFrame([(7000, None, 1.0)], SCHEMA)
    found = approximate_nearest(q.union(nulls), t.union(nulls), 2, "vec", "id").collect()
    assert len(found) == queries * min(2, rows)
    assert all(r.query_id != 7000 and r.neighbor_id != 7000 and r.recall == 1.0 for r in found)
