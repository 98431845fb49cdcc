"""Stratified splits, folds and nested subsets in seeded md5 order.

Positions come from the id, not from a random generator, so a recomputed task
after an executor loss gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordered import hashed_ordinal


def _per_seed(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    if len(seeds) == 1:
        return df.withColumn("seed", F.lit(int(seeds[0])))
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int,
                     seeds: Sequence[int] = (1,)) -> DataFrame:
    """Every row once per seed, with `seed` and `fold` in 0..k-1 stratified by label."""
    ordered = hashed_ordinal(_per_seed(df, seeds), ["seed", label], id_col, "seed", lean=len(seeds) > 1)
    fold = F.pmod(F.col("ordinal") - 1, F.lit(k)).cast("int")
    return ordered.withColumn("fold", fold).drop("ordinal", "group_size")


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float, seed: int = 1,
                     n_reps: int = 1) -> DataFrame:
    """`split` is test for the first round(test_size * n) rows of each class, else train.

    Repetition r uses seed + r - 1 and comes out as one more copy of every row.
    """
    seeds = [seed + r for r in range(n_reps)]
    ordered = hashed_ordinal(_per_seed(df, seeds), ["seed", label], id_col, "seed")
    cut = F.round(F.col("group_size") * F.lit(float(test_size)))
    split = F.when(F.col("ordinal") <= cut, "test").otherwise("train")
    return ordered.withColumn("split", split).drop("ordinal", "group_size")


def nested_split(df: DataFrame, label: str, id_col: str, inner_size: float, seed: int = 2,
                 split: str = "split") -> DataFrame:
    """Split the train part again: train becomes train1 or train2, test stays."""
    outer = df.drop("seed")
    inner = stratified_split(outer.where(F.col(split) == "train").drop(split), label, id_col,
                             inner_size, seed)
    renamed = inner.withColumn(
        split, F.when(F.col("split") == "test", "train2").otherwise("train1"))
    keep = [c for c in outer.columns]
    return renamed.select(*keep).unionByName(outer.where(F.col(split) != "train").select(*keep))


def train_subsets(df: DataFrame, label: str, id_col: str,
                  fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
                  seed: int = 1) -> DataFrame:
    """Adds `min_fraction`, the smallest listed fraction whose subset holds the row.

    The subset for fraction f is `min_fraction <= f`, so subsets are nested and no
    row is copied.
    """
    ordered = hashed_ordinal(_per_seed(df, [seed]), ["seed", label], id_col, "seed")
    level = F.lit(None).cast("double")
    for f in sorted(fractions, reverse=True):
        inside = F.col("ordinal") <= F.round(F.col("group_size") * F.lit(float(f)))
        level = F.when(inside, F.lit(float(f))).otherwise(level)
    return ordered.withColumn("min_fraction", level).drop("ordinal", "group_size", "seed")
