"""Toxicity by FTRL-proximal logistic regression on hashed n-grams and skip-grams.

Every document is a set of hashed words, word pairs and pairs with one word between.
FTRL-proximal gives each coordinate its own rate and, by its L1 term, leaves most
weights at zero; the few others are what is broadcast.

Training reads at most `sample` labelled rows (those of lowest hash), in shards of
`per_shard` rows that train side by side and are averaged. Scoring reads all rows.

Nulls and the rest: a null text is empty and gets the bias' score; a null label is no
label; of repeated labels of one id the highest holds; without labelled rows every
score is 0.5; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import materialize
from .bpe import _once
from .text import U64, WordHashes, mixed

BITS = 18
SAMPLE = 16_384
PER_SHARD = 4_096
EPOCHS = 4
THRESHOLD = 0.3
#: Punctuation and white space become blanks, A-Z lower case.
PLAIN = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b
              for b in range(256))


def coordinates(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Hashed coordinates of words, pairs and skip-grams, repeats included; coordinate 0 is the bias."""
    words = hashes.of((text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split())
    if not len(words):
        return np.empty(0, dtype=np.int64)
    parts = [words,
             words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:] + U64(1),
             words[:-2] * U64(0xC2B2AE3D27D4EB4F) + words[2:] + U64(2)]
    return (mixed(np.concatenate(parts)) >> U64(64 - bits)).astype(np.int64).clip(1)


class Ftrl:
    """Follow the regularised leader, proximal: per-coordinate rates, L1 and L2."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        l1 = np.full(z.shape, self.l1)
        l1[at == 0 if isinstance(at, np.ndarray) else 0] = 0.0      # the bias is not shrunk
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, per_shard: int = PER_SHARD, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights from the labelled documents, as float32 by coordinate; `labels` holds the rows to learn from."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("y"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    chosen = materialize(marks.withColumn("h", order).orderBy("h", "id").limit(sample), "labelled_sample")
    shards = max(1, -(-chosen.count() // per_shard))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")        # at most `sample` ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            packed = [np.unique(coordinates(t.as_py(), hashes, bits)).astype("<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             names=["h", "y", "at"])

    def fit(table: pa.Table) -> pa.Table:
        model = Ftrl(1 << bits)
        rows = sorted(zip(table.column("h").to_pylist(), table.column("at").to_pylist(), table.column("y").to_pylist()))
        sets = [(np.concatenate([[0], np.frombuffer(at, dtype="<u4").astype(np.int64)]), y) for _, at, y in rows]
        for _ in range(epochs):
            for at, y in sets:
                model.learn(at, y)
        return pa.table({"rows": pa.array([len(sets)], pa.int64()),
                         "weights": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})

    made = (rows.select("h", "y", "text").mapInArrow(features, "h long, y double, at binary")
            .groupBy(F.pmod(F.xxhash64("h"), F.lit(shards))).applyInArrow(fit, "rows long, weights binary").collect())
    total = sum(r["rows"] for r in made)
    weights = np.zeros(1 << bits)
    for r in sorted(made, key=lambda r: bytes(r["weights"])):
        weights += np.frombuffer(r["weights"], dtype="<f4") * (r["rows"] / total)
    return weights.astype(np.float32)


_worker: dict = {}


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score): `row` holds all columns of the document. Non-zero weights alone are broadcast."""
    bits = len(weights).bit_length() - 1
    at = np.flatnonzero(weights).astype("<u4")
    held = docs.sparkSession.sparkContext.broadcast((at.tobytes(), weights[at].astype("<f4").tobytes()))
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([plain.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _once(_worker, "hashes", WordHashes)
        places, values = held.value
        dense = np.zeros(1 << bits)
        dense[np.frombuffer(places, dtype="<u4")] = np.frombuffer(values, dtype="<f4")
        used = dense != 0
        for batch in batches:
            out = []
            for text in batch.column(1):
                own = coordinates(text.as_py(), hashes, bits)
                own = np.unique(own[used[own]])
                out.append(sigmoid(dense[0] + dense[own].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=schema.names)
    return plain.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
