"""Catalogue readers and the id-list sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import id_key

# Fixed value: characters around an element of a quoted set literal.
QUOTED_EDGE = "\"', \n}{"
# Fixed value: marks constants in the list of objects outside the catalogues.
CONSTANT_MARKER = "CST"


def read_id_list(spark: SparkSession, path: str, mode: str = "token2") -> DataFrame:
    """One `id` column, one row per line, from a catalogue or result file.

    token2: second space-separated token. quoted: one element of a set literal.
    result: a written star_ID reduced to its key. plain: the line itself.
    A `line` column keeps the raw text for marker filters.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    line = F.col("line")
    if mode == "token2":
        key = F.get(F.split(F.trim(line), " "), F.lit(1))
    elif mode == "quoted":
        key = F.btrim(line, F.lit(QUOTED_EDGE))
    elif mode == "result":
        key = id_key(F.trim(line))
    elif mode == "plain":
        key = F.trim(line)
    else:
        raise ValueError(f"unknown id list mode {mode!r}")
    return lines.select(key.alias("id"), line).where(F.length("id") > 0)


def without_marker(df: DataFrame, c: str, marker: str = CONSTANT_MARKER) -> DataFrame:
    """Rows whose text does not contain the marker."""
    return df.where(~F.col(c).contains(marker))


def write_ids(df: DataFrame, path: str, id_col: str = "star_ID") -> None:
    """One id per line, written in parallel by every task."""
    df.select(F.col(id_col).cast("string").alias("value")).write.text(path)
