"""Stages of the training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encode_digests
from .lines import LineIndex, drop_repeated
from .mixing import mix, take
from .setjoin import similar_components
from .text import row_key
from .toxicity import THRESHOLD, held_out, score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the others stay as they are."""
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()), "toxic")
    return score(docs, weights).where(F.col("score") < THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; n_chars follows the text that is left."""
    out = drop_repeated(docs, LineIndex.build(docs))
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays: the one of smallest id.

    Documents without words all stay. A row without an id comes after those with one, by its row key.
    """
    found = similar_components(docs, shingle=5, threshold=(4, 5))
    kept = found.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("k")).select("k.k1", "k.k2")
    text = F.col("text").cast("string")
    key = row_key(F.col("doc_id"), text)
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Rows that repeat share a key: the first by its other columns stays. As text, maps have an order as well.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others, F.lit(0).alias("end")), {"ignoreNullFields": "false"})
    rows = docs.where(worded).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, order.alias("order"))
    first = rows.join(kept, ["k1", "k2"]).groupBy("k1", "k2").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return first.unionByName(docs.where(~worded))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return take(docs, mix(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    import public_tokenizers as tokenizers
    return encode_digests(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]
