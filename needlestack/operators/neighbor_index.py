"""A neighbour index kept as tables: built once, reopened by any session, searched exactly.

A folder holds `rows` (the indexed rows, partitioned by cell), `cells` (how many rows a cell has, how near and
far they lie, and the distance of its 1st, 2nd, 4th ... row from the pivot), `pivots` and `schema`. A search reads
the small tables and, of `rows`, the cells that some query must visit; nothing of the build runs again.

Rows and queries with a null vector have no distance and are left out. Equal vectors and repeated ids all stay;
ties break by neighbour id. An empty table makes an index that finds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..sources.scratch import materialize, scratch_path
from .neighbors import BLOCK_ROWS, MAX_CELLS, QUERY_ROWS, _cell_udf, _meet, _result, _targets_udf

LARGEST_STEP = 4096


class NeighborIndex:
    """An index at a path that all executors share; `path` alone reopens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, train: DataFrame, vec: str, id_col: str, payload: Sequence[str] = (), path: str | None = None,
              block_rows: int = BLOCK_ROWS, max_cells: int = MAX_CELLS) -> "NeighborIndex":
        """Writes the index to a new folder. A cell's rows go to a file per `block_rows`, so none is one task's."""
        spark = train.sparkSession
        path = path or scratch_path(spark, "neighbor_index")
        rows = train.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"),
                            *payload).where("vec IS NOT NULL")
        cells = max(1, min(max_cells, -(-rows.count() // block_rows)))
        # Distinct first, or many copies of one vector could take every pivot.
        first = rows.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(cells).collect()
        pivots = sorted(list(r["vec"]) for r in first)
        spark.createDataFrame(list(enumerate(pivots)), "cell int, vec array<double>").coalesce(1).write.parquet(
            f"{path}/pivots")
        if pivots:
            rows = rows.withColumn("at", _cell_udf(np.array(pivots))("vec")).select("*", "at.*").drop("at")
        else:
            rows = rows.withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
        kept = rows.drop("away").schema.json()
        spark.createDataFrame([(kept,)], "kept string").coalesce(1).write.parquet(f"{path}/schema")
        near = Window.partitionBy("cell").orderBy("away")
        steps = (rows.select("cell", "away").withColumn("r", F.row_number().over(near))
                 .where((F.col("r") <= LARGEST_STEP) & (F.col("r").bitwiseAND(F.col("r") - 1) == 0))
                 .groupBy("cell").agg(F.sort_array(F.collect_list("away")).alias("steps")))
        shape = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"),
                                         F.max("away").alias("high"))
        shape.join(steps, "cell").coalesce(1).write.parquet(f"{path}/cells")
        files = spark.read.parquet(f"{path}/cells").select("cell", F.ceil(F.col("n") / block_rows).alias("files"))
        rows = rows.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
        rows.repartition("cell", "file").drop("files", "file", "away").write.partitionBy("cell").parquet(f"{path}/rows")
        return cls(spark, path)

    def copy_to(self, path: str) -> "NeighborIndex":
        """The same index in another folder, copied table by table by the executors; crowded cells keep their files."""
        for table in ("pivots", "schema", "cells"):
            self.spark.read.parquet(f"{self.path}/{table}").coalesce(1).write.parquet(f"{path}/{table}")
        rows = self.spark.read.schema(self._row_schema()).parquet(f"{self.path}/rows")
        rows.write.partitionBy("cell").parquet(f"{path}/rows")
        return NeighborIndex(self.spark, path)

    def _row_schema(self) -> T.StructType:
        kept = self.spark.read.parquet(f"{self.path}/schema").first()["kept"]
        return T.StructType.fromJson(json.loads(kept))

    def _shape(self, need: int):
        """Pivots, nearest and farthest row, bound on the distance of the need-th row, and rows, by cell."""
        pivots = [r["vec"] for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("cell").collect()]
        p = len(pivots)
        low, high, kth, counts = np.zeros(p), np.zeros(p), np.full(p, np.inf), np.zeros(p, dtype=np.int64)
        step = (need - 1).bit_length()              # the 2**step-th row is at least as far as the need-th
        for r in self.spark.read.parquet(f"{self.path}/cells").collect():
            c = r["cell"]
            counts[c], low[c], high[c] = r["n"], r["low"], r["high"]
            if step < len(r["steps"]):
                kth[c] = r["steps"][step]
        return np.array(pivots, dtype=np.float64), low, high, kth, counts

    def search(self, query: DataFrame, k: int, vec: str, id_col: str, exclude_self: bool = False,
               payload: Sequence[str] = (), block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
        """(query_id, neighbor_id, distance, rank, payload) of the k nearest indexed rows."""
        need = k + int(exclude_self)
        q = query.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
        pivots, low, high, kth, counts = self._shape(need)
        visit = _targets_udf(pivots, low, high, kth, counts, need)("vec") if len(pivots) else F.array().cast("array<int>")
        q = materialize(q.withColumn("cells", visit), "knn_query").withColumn("cell", F.explode("cells")).drop("cells")
        loads = {r["cell"]: r["m"] for r in q.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}
        rows = self.spark.read.schema(self._row_schema()).parquet(f"{self.path}/rows")
        rows = rows.where(F.col("cell").isin(sorted(loads))).select("id", "vec", "cell", *payload)
        schema = _result(query.schema[id_col].dataType, rows.schema["id"].dataType, rows, payload)
        return _meet(rows, q, counts, loads, k, exclude_self, list(payload), schema, block_rows, query_rows)
