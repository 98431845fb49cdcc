"""Column expressions shared by every operator. All are built-in and codegen'd."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True for ordinary numbers, false for NULL, NaN and the infinities."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def missing_to_null(c: str | Column) -> Column:
    """NaN and the infinities become NULL, the single missing marker."""
    c = col(c).cast("double")
    return F.when(finite(c), c)


def ln_positive(c: str | Column) -> Column:
    """Natural log; NULL where the argument is not positive."""
    c = col(c)
    return F.when(c > 0, F.ln(c))


def binarize(c: str | Column, t: float = 0.5, inclusive: bool = False) -> Column:
    """Class 1.0 above the threshold (or at it, when inclusive), else 0.0."""
    c = col(c)
    return ((c >= t) if inclusive else (c > t)).cast("double")


def round_class(c: str | Column) -> Column:
    """Score rounded to the nearest class."""
    return F.round(col(c)).cast("double")


def id_key(c: str | Column, field: int = 5) -> Column:
    """The given `_` field of an id, up to its first dot."""
    return F.split_part(F.split_part(col(c), F.lit("_"), F.lit(field)), F.lit("."), F.lit(1))


def two_class(c: str | Column) -> Column:
    """[1 - p, p] from a single probability column."""
    c = col(c)
    return F.array(F.lit(1.0) - c, c)
