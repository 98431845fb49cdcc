"""Approximate k nearest neighbours by random-projection buckets, with their recall measured.

Each of `tables` hash tables cuts the space by random directions at the medians of the rows' projections, so a
bucket holds about `bucket_rows` rows however the rows lie (Datar et al., "Locality-Sensitive Hashing Scheme Based
on p-Stable Distributions", 2004). A query visits its own bucket and those reached by crossing the cuts that it
lies closest to (multi-probe: Lv et al., "Multi-Probe LSH", 2007). Distances to all rows met are exact.

How many buckets a query visits is not guessed. For a bounded sample of queries the true neighbours come from one
scan of all rows; one half of the sample sets the number of probes that reaches `target` recall, and the other half
measures the recall of the finished result, which every row carries as `recall`.

Buckets with many rows or queries (copies of one vector share a bucket in every table) are compared in chunks on
both sides, as in the exact search, and nothing is capped. A query travels to each bucket it visits; where it visits
so many that fewer rows move with all queries cut against all rows in chunks, each chunk instead finds from the
vectors which rows its queries meet. Both ways meet the same rows. Rows and queries with a null vector have no distance and
are left out. Ties break by neighbour id; rows of equal id and distance are one. An empty side gives no rows.
The exact search stays the default of everything built on neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialize
from .neighbors import BLOCK_ROWS, QUERY_ROWS, _block_nearest, _chunk_rows, _compare, _matrix, _result, _vector

TABLES = 4
BUCKET_ROWS = 4096
MAX_BITS = 24
CROSSED = 10
SAMPLE = 256
SAMPLE_NEIGHBOURS = 20_000


def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, count))


def _projections(directions: np.ndarray):
    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(v) @ directions), dtype=object) if len(v) else pd.Series([], dtype=object)
    return project


def _codes(x: np.ndarray, directions: np.ndarray, cuts: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each row in each table, and the projections' signed distances from the cuts."""
    gap = (x @ directions - cuts).reshape(len(x), tables, -1)
    return ((gap >= 0) * (1 << np.arange(gap.shape[2]))).sum(axis=2), gap


def _probes(code: np.ndarray, gap: np.ndarray, count: int) -> np.ndarray:
    """The `count` buckets of one table nearest to each row, its own first."""
    bits = gap.shape[1]
    near = np.argsort(np.abs(gap), axis=1, kind="stable")[:, :min(bits, CROSSED)]
    subsets = np.array(list(product((0, 1), repeat=near.shape[1])), dtype=np.int64)
    away = np.take_along_axis(gap, near, axis=1) ** 2
    first = np.argsort(away @ subsets.T, axis=1, kind="stable")[:, :count]
    flips = (1 << near) @ subsets.T
    return code[:, None] ^ np.take_along_axis(flips, first, axis=1)


def _cells_udf(directions, cuts, tables: int, probes: int):
    """Numbers of the buckets to visit: table and code in one integer."""
    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        code, gap = _codes(_matrix(v), directions, cuts, tables)
        seen = [(t << MAX_BITS) + _probes(code[:, t], gap[:, t], probes) for t in range(tables)]
        return pd.Series(list(np.concatenate(seen, axis=1).astype("int32")), dtype=object)
    return cells


def _meets(directions, cuts, tables: int, probes: int) -> Callable:
    """Of the queries and rows of a chunk: which pairs share a bucket that the query visits."""
    def of_chunk(qx: np.ndarray, tx: np.ndarray) -> Callable[[slice], np.ndarray]:
        theirs = _codes(tx, directions, cuts, tables)[0]
        held = [np.unique(theirs[:, t], return_inverse=True) for t in range(tables)]

        def of_queries(part: slice) -> np.ndarray:
            code, gap = _codes(qx[part], directions, cuts, tables)
            met = np.zeros((len(code), len(tx)), dtype=bool)
            for t, (buckets, at) in enumerate(held):
                seen = _probes(code[:, t], gap[:, t], probes)
                place = np.minimum(np.searchsorted(buckets, seen), len(buckets) - 1)
                row, col = np.nonzero(buckets[place] == seen)
                visited = np.zeros((len(code), len(buckets)), dtype=bool)
                visited[row, place[row, col]] = True
                met |= visited[:, at]
            return met
        return of_queries
    return of_chunk


def scan_nearest(query: pd.DataFrame, train: DataFrame, k: int, exclude_self: bool, id_type: str) -> DataFrame:
    """(query_id, neighbor_id, distance, vec, rank) for a bounded number of queries (id, vec), from one scan of (id, vec).

    Each task keeps the k best rows of every query and nothing else.
    """
    order = ["query_id", "distance", "neighbor_id"]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            near = _block_nearest(query, batch, k, exclude_self, ["vec"])
            if near.empty:
                continue
            held = near if held is None else pd.concat([held, near]).sort_values(order).groupby("query_id").head(k)
        if held is not None:
            yield held

    found = train.mapInPandas(best, f"query_id {id_type}, neighbor_id {train.schema['id'].dataType.simpleString()}, "
                                    "distance double, vec array<double>")
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _share_found(queries: np.ndarray, true: pd.DataFrame, directions, cuts, tables: int, probes: int) -> float:
    """Share of true neighbours that lie in a bucket which their query visits."""
    at = true["at"].to_numpy()
    code, gap = _codes(queries, directions, cuts, tables)
    theirs, _ = _codes(_matrix(true["vec"]), directions, cuts, tables)
    met = np.zeros(len(true), dtype=bool)
    for t in range(tables):
        met |= (_probes(code[:, t], gap[:, t], probes)[at] == theirs[:, t][:, None]).any(axis=1)
    return float(met.mean())


def approximate_nearest(query: DataFrame, train: DataFrame, k: int, vec: str, id_col: str, exclude_self: bool = False,
                        payload: Sequence[str] = (), target: float = 0.95, tables: int = TABLES,
                        bucket_rows: int = BUCKET_ROWS, sample: int = SAMPLE, seed: int = 1,
                        block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, neighbor_id, distance, rank, payload, probes, recall) of the nearest rows met in the visited buckets.

    `probes` is the number of buckets visited per table, `recall` the share of the true k nearest that the result
    holds, over the half of the sample that did not set `probes`. The sample takes `sample` queries of least hash,
    fewer where k is so large that their neighbours would pass 20,000. Train rows travel `tables` times, or once a
    chunk of queries where that moves less.
    """
    payload = list(payload)
    rows = train.select(F.col(id_col).alias("id"), _vector(train, vec), *payload).where("vec IS NOT NULL")
    asked = query.select(F.col(id_col).alias("id"), _vector(query, vec)).where("vec IS NOT NULL")
    n, m = rows.count(), asked.count()
    bits = min(MAX_BITS, max(1, int(np.ceil(np.log2(max(n, 2) / bucket_rows)))))
    first = (rows if n else asked).select(F.size("vec").alias("d")).first()
    directions = _directions(first["d"] if first else 1, tables * bits, seed)
    # One pass over the rows gives the medians of all projections.
    projected = rows.select(_projections(directions)("vec").alias("p"))
    medians = projected.agg(*[F.percentile_approx(F.col("p")[i], 0.5, 1000).alias(f"m{i}") for i in range(tables * bits)])
    cuts = np.array([0.0 if m is None else m for m in medians.first()])

    take = max(2, min(sample, SAMPLE_NEIGHBOURS // k))
    drawn = asked.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(take).toPandas().drop_duplicates("id", ignore_index=True)
    id_type = asked.schema["id"].dataType.simpleString()
    true = scan_nearest(drawn, rows.select("id", F.col("vec").cast("array<double>")), k, exclude_self, id_type).toPandas()
    true["at"] = true["query_id"].map({q: i for i, q in enumerate(drawn["id"])}).astype("int64")
    setting, measured = true[true["at"] % 2 == 0], true[true["at"] % 2 == 1]
    probes = 1
    if len(setting):
        x = _matrix(drawn["vec"])
        while probes < 1 << min(bits, CROSSED) and _share_found(x, setting, directions, cuts, tables, probes) < target:
            probes *= 2

    chunks = lambda df, size, name: df.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    t_chunks, q_chunks = max(1, -(-n // block_rows)), max(1, -(-m // _chunk_rows(m, query_rows)))
    by_chunk = t_chunks * m + q_chunks * n < tables * (probes * m + n)
    if by_chunk:
        t, q = rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0))
        plan = F.broadcast(rows.sparkSession.createDataFrame([(0, t_chunks, q_chunks)], "cell int, t_chunks int, q_chunks int"))
    else:
        # Written with their lists of buckets: a row a bucket exists only on its way to it.
        t = materialize(rows.withColumn("cells", _cells_udf(directions, cuts, tables, 1)("vec")), "lsh_rows")
        q = materialize(asked.withColumn("cells", _cells_udf(directions, cuts, tables, probes)("vec")), "lsh_queries")
        t, q = (df.withColumn("cell", F.explode("cells")).drop("cells") for df in (t, q))
        plan = chunks(t, block_rows, "t_chunks").join(chunks(q, query_rows, "q_chunks"), "cell")
    schema = _result(query.schema[id_col].dataType, train.schema[id_col].dataType, train, payload)
    met = _compare(t, q, plan, k, exclude_self, payload, schema,
                   _meets(directions, cuts, tables, probes) if by_chunk else None)
    # A pair met in several tables counts once; both steps below share the shuffle by query.
    met = met.repartition("query_id").dropDuplicates(["query_id", "neighbor_id", "distance"])
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out = materialize(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "lsh_result")
    recall = _recall(out, measured if len(measured) else setting)
    return out.withColumns({"probes": F.lit(probes), "recall": F.lit(recall).cast("double")})


def _recall(out: DataFrame, true: pd.DataFrame) -> float | None:
    """Share of the true neighbours that the result holds; None where there are none."""
    if not len(true):
        return None
    asked = true["query_id"].drop_duplicates().tolist()
    held = out.where(F.col("query_id").isin(asked)).select("query_id", "neighbor_id").toPandas()
    return float(true.merge(held, on=["query_id", "neighbor_id"]).shape[0] / len(true))
