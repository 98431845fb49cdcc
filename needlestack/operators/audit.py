"""Missing counts, histograms, correlations and calibration tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .metrics import _agg
from .skew import join_small
from .summed import array_sum


def missing_audit(df: DataFrame, cols: Sequence[str], by: str = "source") -> DataFrame:
    """(source, feature, n_missing): NULL or NaN cells of every feature."""
    wide = df.groupBy(by).agg(*[
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols])
    return wide.unpivot([by], list(cols), "feature", "n_missing")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle of the Pearson matrix; each pair uses the rows where both are present.

    One pass sums products of whole blocks of rows, with a mask of what is present: counts, sums, squares and
    products of all pairs at once. Values are shifted by their column's mean first, so nothing cancels. NULL and
    NaN are missing; a pair without variance has no correlation.
    """
    d, names = len(cols), list(cols)
    if d < 2:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, corr double")
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names]
    middle = np.array([m or 0.0 for m in df.agg(*[F.avg(v) for v in values]).first()])

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64) - middle
        there = ~np.isnan(x)
        x, m = np.where(there, x, 0.0), there.astype(np.float64)
        return np.concatenate([g.ravel() for g in (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)])

    n, s, q, xy = array_sum(df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]), of_batch, 4 * d * d).reshape(4, d, d)
    rows = []
    for j, i in combinations(range(d), 2):
        if not n[i, j]:
            rows.append((names[i], names[j], None))
            continue
        var = (q[i, j] - s[i, j] ** 2 / n[i, j]) * (q[j, i] - s[j, i] ** 2 / n[i, j])
        flat = min(q[i, j] - s[i, j] ** 2 / n[i, j] - 1e-12 * q[i, j], q[j, i] - s[j, i] ** 2 / n[i, j] - 1e-12 * q[j, i]) <= 0
        rows.append((names[i], names[j], None if flat else float((xy[i, j] - s[i, j] * s[j, i] / n[i, j]) / np.sqrt(var))))
    return df.sparkSession.createDataFrame(rows, "f1 string, f2 string, corr double")


def column_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column: one pass, two numbers per column."""
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def bin_of(c: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin; the top edge falls in the last bin, a constant column in bin 0."""
    at = F.floor(F.try_divide((c - lo) * bins, hi - lo))
    return F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 100) -> DataFrame:
    """(feature, bin, n) over the range of each feature; empty bins are absent."""
    ranges = column_ranges(df, cols)
    cells = [
        F.struct(F.lit(c).alias("feature"),
                 F.when(F.col(c).isNotNull(),
                        bin_of(F.col(c), F.lit(ranges[c][0]), F.lit(ranges[c][1]), bins)).alias("bin"))
        for c in cols
    ]
    melted = df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return melted.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def minmax(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Column rescaled to [0, 1]; NULL when it is constant."""
    lo, hi = column_ranges(df, [c])[c]
    scaled = F.try_divide(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo))
    return df.withColumn(out or c, scaled)


def reliability(df: DataFrame, label: str, p: str, bins: int = 5, by: Sequence[str] = (),
                normalize: bool = True) -> DataFrame:
    """(bin, mean_score, fraction_positive, n) over equal-width score bins.

    Scores are min-max normalised within `by` first, from one small aggregate.
    """
    by = list(by)
    rows = df.where(F.col(p).isNotNull())
    if normalize:
        ends = _agg(rows, by, F.min(p).alias("__lo"), F.max(p).alias("__hi"))
        if by:
            rows = join_small(rows, ends, by)
            lo, hi = F.col("__lo"), F.col("__hi")
        else:
            e = ends.first()
            lo, hi = F.lit(e["__lo"]), F.lit(e["__hi"])
        q = F.try_divide(F.col(p) - lo, hi - lo)
    else:
        q = F.col(p)
    scored = rows.select(*by, F.col(label).alias("__y"), q.alias("__q")).where(F.col("__q").isNotNull())
    b = F.least(F.floor(F.col("__q") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*by, b.alias("bin")).agg(
        F.avg("__q").alias("mean_score"), F.avg(F.col("__y").cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"))
