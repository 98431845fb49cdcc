"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encode_digests
from .counts import count_tokens
from . import language
from .fingerprint import containment, edited, likeness, measured, printed, sketch, with_next
from .lines import LineIndex, drop_repeated
from .mixing import mix
from .periodic import listed, longest_run, periodic_runs, with_periodic_tail
from .pii import personal_digests
from .quality import fit_cutoffs, judge, measure
from .setjoin import similar_components
from .substrings import drop_repeats
from .toxicity import THRESHOLD, held_out, score, train
from .whitening import whiten
from ..sources.scratch import materialize


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(*columns)


def op1_mix_sources(spark, sf):
    plan = mix(documents(spark, sf, "doc_id", "text", "source"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             2 * source_size AS cap FROM s0),
-- Clamp sources by rising cap per weight; the level is where what is left first fits under the next cap.
r AS (SELECT *, cap / weight::DOUBLE AS ratio FROM s),
c AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget,
             coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
             sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
l AS (SELECT min_by((budget - clamped)::DOUBLE / free, ratio) AS level FROM c
      WHERE (budget - clamped)::DOUBLE / free < ratio),
t AS (SELECT source, source_size,
             CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, round(weight * level, 6)) END AS target
      FROM s, l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS part,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN ahead + size / 2.0 < part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


def op2_fingerprints(spark, sf):
    own = measured(documents(spark, sf, "doc_id", "text"))
    rows = with_next(own, ["text", "sketch"], ["id", "text"], made={"sketch": sketch(F.col("text"))})
    rows = rows.select("id", "n_chars", "sketch", "next_sketch",
                       edited(F.col("text"), F.col("n_chars"), F.col("next_text")).alias("edited"))
    rows = rows.select("*", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"))


def op3_personal_data(spark, sf):
    return personal_digests(documents(spark, sf, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op4_jaccard_join(spark, sf):
    return similar_components(documents(spark, sf, "doc_id", "text"), links=True).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op5_quality_rules(spark, sf):
    measured = materialize(measure(documents(spark, sf, "doc_id", "text", "lang")), "quality_counts")
    cutoffs = fit_cutoffs(measured, spark.read.parquet(f"{sf}/labels.parquet"))
    return judge(measured, cutoffs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
                                           "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_repeated_passages(spark, sf):
    out = drop_repeats(documents(spark, sf, "doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    out = drop_repeated(docs, LineIndex.build(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
keys AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
bad AS (SELECT key FROM keys WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM bad)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM bad)), '')) AS kept_sha256
FROM keys GROUP BY doc_id
"""

def op8_byte_bpe(spark, sf):
    import public_tokenizers as tokenizers
    out = encode_digests(documents(spark, sf, "doc_id", "text"),
                         tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op9_token_counts(spark, sf):
    import public_tokenizers as tokenizers
    out = count_tokens(documents(spark, sf, "doc_id", "text"),
                       tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op10_toxicity(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()), "toxic")
    scored = score(docs, weights).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_language_id(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "lang")
    model = language.train(docs, ~language.held_out())
    found = language.predict(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op12_periodic_runs(spark, sf):
    docs = with_periodic_tail(documents(spark, sf, "doc_id", "text"))
    found = periodic_runs(docs).select("*", longest_run(F.col("runs")).alias("best"))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_embedding_whitening(spark, sf):
    rows = whiten(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))
    return rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        "row.vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"),
        F.col("col.explained").alias("explained"), "identity_error")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_fingerprints": op2_fingerprints,
    "op3_personal_data": op3_personal_data,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}
SQL = {"op1_mix_sources": OP1_SQL, "op7_line_dedup": OP7_SQL}
