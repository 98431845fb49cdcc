"""Frames the registered queries share, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FEATURES = ["quantity", "price", "discount", "tax"]


def ff(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a feature table: id, label y, rare label, and injected NULLs."""
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_extendedprice") * F.col("l_discount") > 9000).cast("int").alias("rare"),
        F.col("l_linestatus").alias("source"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("quantity"),
        F.when(F.pmod("l_partkey", F.lit(7)) != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.pmod("l_suppkey", F.lit(11)) != 0, F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
    )


FF_SQL = """
ff AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         CASE WHEN l_extendedprice * l_discount > 9000 THEN 1 ELSE 0 END AS rare,
         l_linestatus AS source,
         CASE WHEN l_linenumber <> 5 THEN l_quantity END AS quantity,
         CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END AS price,
         CASE WHEN l_suppkey % 11 <> 0 THEN l_discount END AS discount,
         l_tax AS tax
  FROM lineitem
)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a score p for label y, and scores of three more models."""
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_extendedprice") * F.col("l_discount") > 9000).cast("int").alias("rare"),
        (F.col("l_quantity") / 50).alias("p"),
        (F.col("l_extendedprice") / 110000).alias("p_price"),
        (F.col("l_discount") * 10).alias("p_discount"),
        (F.col("l_tax") * 12.5).alias("p_tax"),
    )


SCORED_SQL = """
scored AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         CASE WHEN l_extendedprice * l_discount > 9000 THEN 1 ELSE 0 END AS rare,
         l_quantity / 50.0::DOUBLE AS p,
         l_extendedprice / 110000.0::DOUBLE AS p_price,
         l_discount * 10.0::DOUBLE AS p_discount,
         l_tax * 12.5::DOUBLE AS p_tax
  FROM lineitem
)"""


TEXT_FEATURES = ["n_chars", "words", "distinct_share", "punct_share", "lines", "upper_share"]


def docs(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    """Labelled documents as text statistics over whole texts; the rare class is quality = 0.

    With how="left" all documents, y and toxic missing where there is no label."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    text = F.col("text")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(F.trim(text), r"\s+")
    stats = d.select(
        "doc_id", "source",
        F.length(text).cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
        (F.length(F.regexp_replace(text, r"[^.,;:!?]", "")) / n).alias("punct_share"),
        (F.length(F.regexp_replace(text, r"[^\n]", "")) + 1.0).alias("lines"),
        (F.length(F.regexp_replace(text, r"[^A-Z]", "")) / n).alias("upper_share"),
    )
    return stats.join(lab.select("doc_id", (1 - F.col("quality")).alias("y"), "toxic"), "doc_id", how)
