"""Several independent Spark fits in flight at once, as CrossValidator's parallelism does."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

PARALLELISM = 4


def in_flight(f: Callable, items: Sequence, parallelism: int = PARALLELISM) -> list:
    """f of every item, in order. Each call submits its own jobs; Spark shares the executors."""
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [f(i) for i in items]
    f = inheritable_thread_target(SparkSession.builder.getOrCreate())(f)
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(f, items)
