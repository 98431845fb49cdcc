"""Combining scores of several models that sit in one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from .ordered import ROWS_PER_BUCKET, order_splits, running, with_bucket
from .skew import HOT_SHARE, join_counted

# Weights of the six-model hard vote and their divisor.
HARD_VOTE_WEIGHTS = {"lr": 0.67, "knn": 0.68, "gb": 0.81, "rf": 0.76, "nn": 0.81, "svm": 0.79}
HARD_VOTE_TOTAL = 4.52


def soft_vote(df: DataFrame, cols: Sequence[str], weights: Sequence[float] | None = None,
              p: str = "p", pred: str = "prediction") -> DataFrame:
    """Weighted mean of probabilities and the class it favours (ties go to 0)."""
    weights = [1.0] * len(cols) if weights is None else [float(w) for w in weights]
    total = reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in zip(cols, weights)])
    mean = total / F.lit(sum(weights))
    return df.withColumn(p, mean).withColumn(pred, (F.col(p) > 0.5).cast("double"))


def hard_vote(df: DataFrame, cols: Sequence[str], weights: Sequence[float],
              total: float | None = None, t: float = 0.5, vote: str = "vote",
              pred: str = "prediction") -> DataFrame:
    """Weighted share of positive class predictions; positive at `>= t`."""
    total = float(sum(weights)) if total is None else float(total)
    mass = reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in zip(cols, weights)])
    return df.withColumn(vote, mass / F.lit(total)).withColumn(pred, (F.col(vote) >= t).cast("double"))


def min_ranks(df: DataFrame, by: Sequence[str], value: str,
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(by, value, n, rank0): how many rows of the group lie strictly below each value."""
    by = list(by)
    splits = order_splits(df, value, rows_per_bucket)
    steps = with_bucket(df, value, splits).groupBy(*by, "bucket", value).agg(
        F.count(F.lit(1)).alias("n"))
    out = running(steps, by, value, sums=["n"])
    return out.select(*by, value, "n", (F.col("run_n") - F.col("n")).alias("rank0"),
                      F.col("all_n").alias("group_n"))


def rank_average(df: DataFrame, id_col: str, cols: Sequence[str], out: str = "rank_score",
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(id, out): min-rank minus 1 of each score, summed over models, over the largest sum.

    The models are stacked into one long frame, so ranking costs the same number of
    shuffles for any number of them. A score shared by many rows is joined by broadcast.
    A missing score ranks lowest: it adds 0, and the row stays.
    """
    long = df.select(id_col, *cols).unpivot([id_col], list(cols), "model", "score")
    absent = long.where(F.col("score").isNull()).withColumn("rank0", F.lit(0).cast("long"))
    long = long.where(F.col("score").isNotNull())
    # Ranks and sums are each read twice, so they are written once.
    ranks = materialize(
        min_ranks(long.select("model", "score"), ["model"], "score", rows_per_bucket), "ranks")
    ranked = join_counted(long, ranks, ["model", "score"],
                          F.col("n") * HOT_SHARE >= F.col("group_n"), ["rank0"])
    ranked = ranked.select(id_col, "rank0").unionByName(absent.select(id_col, "rank0"))
    sums = materialize(ranked.groupBy(id_col).agg(F.sum("rank0").alias("__s")), "rank_sums")
    top = sums.agg(F.max("__s").alias("m"))
    return sums.select(id_col, F.try_divide(F.col("__s").cast("double"), top.scalar()).alias(out))
