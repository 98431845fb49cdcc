"""Sums of arrays over all rows, added up in tasks, then in slots, then on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Partial sums that the driver adds up itself; with more tasks, Spark adds them in so many groups first.
SLOTS = 64
_FIELDS = "slot int, part array<double>"


def _row(slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.astype(np.float64)], pa.list_(pa.float64()))],
                                      names=["slot", "part"])


def array_sum(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int,
              parts: int | None = None) -> np.ndarray:
    """The sum over all batches of a flat array of `size` numbers made from each one; zeros without rows.

    A task adds in extended precision and gives one row. `parts` is the number of tasks, where it is known."""
    slots = SLOTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(batch).astype(np.longdouble)
                total = own if total is None else total + own
        if total is not None:
            yield _row(TaskContext.get().partitionId() % slots, total)

    def join(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros(size, dtype=np.longdouble), 0
        for batch in group:
            slot = batch.column(0)[0].as_py()
            total = total + np.array(batch.column(1).to_pylist(), dtype=np.longdouble).sum(axis=0)
        yield _row(slot, total)

    made = df.mapInArrow(add, _FIELDS)
    if (df.rdd.getNumPartitions() if parts is None else parts) > slots:
        made = made.groupBy("slot").applyInArrow(join, _FIELDS)
    total = np.zeros(size, dtype=np.longdouble)
    for row in sorted(made.collect(), key=lambda r: r["slot"]):
        total = total + np.array(row["part"], dtype=np.longdouble)
    return total.astype(np.float64)
