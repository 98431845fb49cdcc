"""The stored neighbour index against brute force and against the search without an index."""

import random

import pytest
from pyspark.sql import functions as F

from needlestack.operators.neighbor_index import NeighborIndex
from needlestack.operators.neighbors import nearest


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(c, 0.4) for _ in range(3)], float(i % 3)) for i, c in
            enumerate(rng.choice((0.0, 4.0, 9.0)) for _ in range(600))]
    rows += [(600 + i, [1.0, 1.0, 1.0], 0.0) for i in range(200)]      # copies of one vector
    return rows


def brute(rows, queries, k, exclude_self=False):
    out = set()
    for q, v, _ in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i) for i, w, _ in rows if not (exclude_self and i == q))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 5, 37])
def test_search_is_exact(spark, points, k):
    train = spark.createDataFrame(points, "id long, vec array<double>, y double")
    index = NeighborIndex.build(train, "vec", "id", ["y"], block_rows=50)
    again = NeighborIndex(spark, index.path)
    queries = points[::40]
    found = again.search(spark.createDataFrame(queries, train.schema), k, "vec", "id", True, ["y"], block_rows=50).collect()
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in found} == brute(points, queries, k, True)
    assert all(r.y == points[r.neighbor_id][2] for r in found)
    plain = nearest(spark.createDataFrame(queries, train.schema), train, k, "vec", "id", True, block_rows=50)
    assert {(r.query_id, r.neighbor_id) for r in plain.collect()} == {(r.query_id, r.neighbor_id) for r in found}


def test_search_reads_only_the_cells_it_needs(spark, points):
    train = spark.createDataFrame(points, "id long, vec array<double>, y double")
    index = NeighborIndex.build(train, "vec", "id", block_rows=50)
    cells = spark.read.parquet(f"{index.path}/rows").select("cell").distinct().count()
    one = index.search(spark.createDataFrame([(1, [9.0, 9.0, 9.0])], "id long, vec array<double>"), 1, "vec", "id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    read = [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines()
            if "neighbor_index-" in line and "PartitionFilters: [" in line]
    assert cells > 5 and len(read) == 1 and "cell" in read[0]
    assert one.count() == 1


def test_nulls_and_empty_tables(spark, points):
    schema = "id long, vec array<double>, y double"
    train = spark.createDataFrame(points[:20] + [(99, None, 1.0)], schema)
    index = NeighborIndex.build(train, "vec", "id")
    queries = spark.createDataFrame([(1, None, 0.0), (2, points[2][1], 0.0)], schema)
    assert {(r.query_id, r.neighbor_id) for r in index.search(queries, 1, "vec", "id").collect()} == {(2, 2)}
    assert index.search(queries.limit(0), 3, "vec", "id", payload=[]).count() == 0
    nothing = NeighborIndex.build(train.limit(0), "vec", "id", ["y"])
    found = nothing.search(queries, 3, "vec", "id", payload=["y"])
    assert found.count() == 0 and found.columns == ["query_id", "neighbor_id", "distance", "y", "rank"]
