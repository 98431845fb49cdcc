"""Readers for statistics logs and managed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import finite, missing_to_null
from ..schema import ID_COLUMN, LABEL, STAT_COLUMNS


def read_stat_table(spark: SparkSession, path: str, names: Sequence[str] = STAT_COLUMNS,
                    id_col: str = ID_COLUMN) -> DataFrame:
    """Headerless whitespace-delimited log; fields beyond `names` are ignored.

    Infinities, NaN and unreadable numbers become NULL. Splitting text is per-row
    work, so write the result to parquet once and query that.
    """
    line = F.btrim("value", F.lit(" \t\n\x0b\f\r"))         # what \s stands for, without an expression a row
    parts = F.split(line, r"\s+")
    fields = spark.read.text(path).where(F.length(line) > 0).select(parts.alias("f"))
    out = []
    for i, name in enumerate(names):
        raw = F.get("f", F.lit(i))
        if name == id_col:
            out.append(raw.alias(name))
        else:
            out.append(missing_to_null(raw.try_cast("double")).alias(name))
    return fields.select(*out)


def union_classes(frames: Sequence[DataFrame], labels: Sequence[int] | None = None,
                  label: str = LABEL, sources: Sequence[str] | None = None) -> DataFrame:
    """Stack class frames; the first is class 0 and every other one class 1."""
    if labels is None:
        labels = [0] + [1] * (len(frames) - 1)
    if sources is None:
        sources = [str(i) for i in range(len(frames))]
    tagged = [
        f.withColumns({label: F.lit(int(y)), "source": F.lit(s)})
        for f, y, s in zip(frames, labels, sources)
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def finite_min(df: DataFrame, c: str) -> float | None:
    """Smallest finite value of a column over all rows."""
    return df.agg(F.min(F.when(finite(c), F.col(c))).alias("m")).first()["m"]


def load_labelled(spark: SparkSession, paths: Sequence[str],
                  names: Sequence[str] = STAT_COLUMNS, drop: Sequence[str] = (),
                  label: str = LABEL, id_col: str = ID_COLUMN) -> DataFrame:
    """Class files to one labelled frame; the id column always stays with the row."""
    frames = [read_stat_table(spark, p, names, id_col) for p in paths]
    gone = [c for c in drop if c != id_col]
    return union_classes(frames, label=label, sources=list(paths)).drop(*gone)


def load_target(spark: SparkSession, path: str, names: Sequence[str] = STAT_COLUMNS,
                id_col: str = ID_COLUMN) -> DataFrame:
    """Unlabelled table of the same layout. One frame carries ids through scoring.

    The training shift lives in the fitted pipeline, so nothing is passed here.
    """
    return read_stat_table(spark, path, names, id_col)


def managed_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A managed train or valid table, by table name or parquet path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.read.table(name_or_path)
