"""Threshold decisions and their comparison with external catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import id_key
from ..sources.catalogs import CONSTANT_MARKER
from .metrics import prf


def threshold_split(df: DataFrame, p: str, t: float = 0.5, ties: str = "drop",
                    out: str = "found") -> DataFrame:
    """Boolean `found` for each row; a score equal to t is dropped unless told otherwise."""
    if ties == "drop":
        return df.where(F.col(p) != t).withColumn(out, F.col(p) > t)
    if ties == "positive":
        return df.where(F.col(p).isNotNull()).withColumn(out, F.col(p) >= t)
    if ties == "negative":
        return df.where(F.col(p).isNotNull()).withColumn(out, F.col(p) > t)
    raise ValueError(f"unknown ties {ties!r}")


def _hit_or_miss(p: Column, t: float, ties: str) -> tuple[Column, Column]:
    """What `threshold_split` finds and doesn't find, as flags; both are false where it drops the row.

    A filter on a model's score would make Spark score each row a second time below the filter."""
    tied = {"drop": (False, False), "positive": (True, False), "negative": (False, True)}
    if ties not in tied:
        raise ValueError(f"unknown ties {ties!r}")
    return tuple(F.coalesce(F.when(p == t, F.lit(at)).otherwise(flag), F.lit(False))
                 for at, flag in zip(tied[ties], (p > t, p < t)))


def truth_ids(new: DataFrame, candidates: DataFrame, not_in_cat: DataFrame) -> DataFrame:
    """Distinct true ids: new ones, candidates that no list contradicts, and the
    listed ones that are not marked constant."""
    cat = candidates.select("id").distinct().join(not_in_cat.select("id").distinct(), "id", "left_anti")
    noncat = not_in_cat.where(~F.col("line").contains(CONSTANT_MARKER)).select("id")
    return new.select("id").union(cat).union(noncat).distinct()


def catalog_match(scored: DataFrame, new: DataFrame, candidates: DataFrame,
                  not_in_cat: DataFrame, id_col: str, p: str, t: float = 0.5,
                  ties: str = "drop", probe: str | None = None,
                  key_field: int | None = None) -> DataFrame:
    """One row: new_found, probe_found, tn, fp, fn, tp, precision, recall, f1.

    Every set is a flag on its ids, so all unions, intersections and differences come
    out of a single group-by over id with map-side combine: one shuffle, no broadcast,
    and an id repeated many times collapses before it moves.
    """
    key = id_key(id_col, key_field) if key_field else F.col(id_col)
    hit, miss = _hit_or_miss(F.col(p), t, ties)
    split = scored.select(key.cast("string").alias("id"), hit.alias("hit"), miss.alias("miss"))
    flags = ["hit", "miss", "new", "cand", "nic", "noncat"]

    def tagged(df, **on):
        return df.select(F.col("id").cast("string").alias("id"),
                         *[on.get(f, F.lit(False)).alias(f) for f in flags])

    yes = F.lit(True)
    parts = [
        tagged(split, hit=F.col("hit"), miss=F.col("miss")),
        tagged(new, new=yes),
        tagged(candidates, cand=yes),
        tagged(not_in_cat, nic=yes, noncat=~F.col("line").contains(CONSTANT_MARKER)),
    ]
    ids = reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(
        *[F.bool_or(f).alias(f) for f in flags])
    truth = F.col("new") | (F.col("cand") & ~F.col("nic")) | F.col("noncat")
    hit, miss = F.col("hit"), F.col("miss")
    probed = F.coalesce(F.bool_or(hit & (F.col("id") == probe)), F.lit(False)) if probe else F.lit(None).cast("boolean")
    counts = ids.agg(
        F.count_if(hit & F.col("new")).alias("new_found"),
        probed.alias("probe_found"),
        F.count_if(miss & ~truth).alias("tn"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(miss & truth).alias("fn"),
        F.count_if(hit & truth).alias("tp"),
    )
    return prf(counts)
