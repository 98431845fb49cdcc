"""Rules on per-round metric histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordered import ROWS_PER_BUCKET, order_splits, running, with_bucket


def patience_rule(history: DataFrame, patience: int, by: Sequence[str] = (),
                  iteration: str = "iteration", value: str = "value",
                  larger_is_better: bool = False,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Best round, and the round that stops: `patience` rounds after it with no gain.

    A later round replaces the best only if strictly better. Without a stop the
    last round is reported and `stopped` is false.
    """
    by = list(by)
    loss = -F.col(value) if larger_is_better else F.col(value)
    rows = history.where(F.col(value).isNotNull()).select(
        *by, F.col(iteration).cast("long").alias("r"),
        F.struct(loss.alias("loss"), F.col(iteration).cast("long").alias("at")).alias("best"))
    rows = with_bucket(rows, "r", order_splits(rows, "r", rows_per_bucket))
    seen = running(rows, by, "r", mins=["best"])
    state = F.struct("r", "run_best")
    over = F.col("r") - F.col("run_best.at") >= patience
    grouped = seen.groupBy(*by) if by else seen.groupBy()
    out = grouped.agg(F.min(F.when(over, state)).alias("stop"), F.max(state).alias("end"))
    final = F.coalesce("stop", "end")
    sign = -1.0 if larger_is_better else 1.0
    return out.select(
        *by, final["run_best"]["at"].alias("best_iteration"),
        (final["run_best"]["loss"] * F.lit(sign)).alias("best_value"),
        final["r"].alias("last_iteration"), F.col("stop").isNotNull().alias("stopped"))


def mean_history(history: DataFrame, by: Sequence[str] = (), iteration: str = "iteration",
                 value: str = "value") -> DataFrame:
    """Per-round mean and spread of a metric over folds."""
    return history.groupBy(*by, iteration).agg(
        F.avg(value).alias(value), F.stddev_pop(value).alias("std"))
