"""Exact ranks and running totals without a single-task window.

A window over a whole class, or over every score, puts all its rows in one task.
Here the order is cut into buckets that respect it: the window runs inside each
bucket and a small table of bucket totals supplies what came before. The result
equals the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

INF = float("inf")
ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 16_384


def order_splits(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                 max_buckets: int = MAX_BUCKETS) -> list[float]:
    """Bucket boundaries at near-equal row counts: one narrow scan, a bounded result.

    The quantile sketch only balances the buckets; any boundaries give exact totals.
    """
    n = df.select(F.count(key)).first()[0]
    buckets = min(max_buckets, -(-n // rows_per_bucket))
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.select(
        F.percentile_approx(F.col(key).cast("double"), probs, max(10_000, 4 * buckets)).alias("q")
    ).first()["q"]
    return sorted(set(cuts))


def with_bucket(df: DataFrame, key: str, splits: Sequence[float], out: str = "bucket") -> DataFrame:
    """Bucket number of a numeric key. Equal keys always share a bucket."""
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    bins = Bucketizer(splits=[-INF, *splits, INF], inputCol="__key", outputCol=out,
                      handleInvalid="keep")
    return bins.transform(df.withColumn("__key", F.col(key).cast("double"))).drop("__key")


def grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds the group as one struct, and names it. A struct is never NULL, whatever it holds, and structs of
    the same values are equal, NULLs included: so a NULL group is a group, windows and joins by plain equality
    share one partitioning, and rows shuffle once."""
    return (df.withColumn("__g", F.struct(*by)), ["__g"]) if by else (df, [])


def running(df: DataFrame, by: Sequence[str], key: str, sums: Sequence[str] = (),
            mins: Sequence[str] = (), bucket: str = "bucket",
            descending: bool = False) -> DataFrame:
    """Inclusive running sums and minima along `key` within `by`.

    `df` must hold one row per (by, key), with a `bucket` column that is monotone
    in key. Adds run_<c> for every listed column and all_<c> for every sum (its
    total over `by`). The window is hash-partitioned and sorted on (by, bucket),
    which the join to the bucket totals re-uses, so rows shuffle once.
    """
    keyed, group = grouped(df, by)
    direction = F.desc if descending else F.asc
    inside = (Window.partitionBy(*group, bucket).orderBy(direction(key))
              .rowsBetween(Window.unboundedPreceding, 0))
    before = (Window.partitionBy(*group).orderBy(direction(bucket))
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*group)

    totals = (
        keyed.groupBy(*group, bucket)
        .agg(*[F.sum(c).alias(f"__t_{c}") for c in sums],
             *[F.min(c).alias(f"__m_{c}") for c in mins])
    )
    offsets = totals.select(
        *group, bucket,
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums],
        *[F.sum(f"__t_{c}").over(whole).alias(f"all_{c}") for c in sums],
        *[F.min(f"__m_{c}").over(before).alias(f"__p_{c}") for c in mins],
    )
    ranked = keyed.withColumns({
        **{f"__r_{c}": F.sum(c).over(inside) for c in sums},
        **{f"__n_{c}": F.min(c).over(inside) for c in mins},
    })
    joined = ranked.join(offsets, [*group, bucket])
    return joined.select(
        *df.columns,
        *[(F.col(f"__r_{c}") + F.col(f"__o_{c}")).alias(f"run_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
        *[F.least(f"__n_{c}", f"__p_{c}").alias(f"run_{c}") for c in mins],
    )


def hashed_ordinal(df: DataFrame, by: Sequence[str], id_col: str, seed_col: str,
                   digits: int = 4, out: str = "ordinal", size: str = "group_size",
                   lean: bool = False) -> DataFrame:
    """1-based position of each row within `by` in seeded md5 order of its id.

    The bucket is the leading hex digits of the same md5, so buckets are even
    whatever the ids look like. `id_col` must be unique within `by`. With `lean` the md5 is
    made again behind the shuffle: its 32 characters a row don't compress and need not travel.
    """
    keyed, group = grouped(df, by)
    place = F.md5(F.concat_ws(":", F.col(seed_col).cast("string"), F.col(id_col).cast("string")))
    if lean:
        keyed = keyed.withColumn("__b", F.substring(place, 1, digits))
        placed = keyed.repartition(*group, "__b").withColumn("__h", place)
    else:
        placed = keyed = keyed.withColumn("__h", place).withColumn("__b", F.substring("__h", 1, digits))
    inside = Window.partitionBy(*group, "__b").orderBy("__h", id_col)
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, "__b",
                F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
                F.sum("__n").over(Window.partitionBy(*group)).alias(size))
    )
    return (
        placed.withColumn("__r", F.row_number().over(inside)).join(offsets, [*group, "__b"])
        .select(*df.columns, (F.col("__r") + F.col("__o")).cast("long").alias(out), size)
    )
