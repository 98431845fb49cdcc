"""Language identification: sparse multinomial regression on TF-IDF of character n-grams.

Letters become lower case and everything else a blank. The n-grams of one to `ORDER`
characters, blanks at word edges included, are hashed to 2^bits coordinates. Document
frequencies come from all documents that may be learnt from: a task counts in one array,
and Spark adds the arrays up. A document's vector is 1 + ln(count) times the inverse
document frequencies, brought to length 1. FTRL-proximal with an elastic net (L1 and L2)
trains one set of weights a language and leaves most of them at zero. The sample holds rare
languages more often than all documents do, so the biases are moved to the shares of all.
Last, one temperature is fitted on documents kept apart from training, weighted by the same
shares, so that scores are calibrated probabilities.

Training reads about `sample` documents of the at most `languages` most frequent languages,
each by its share but never asked for fewer than `least`, those of lowest hash; the hash of
a fifth of them sets them apart for the temperature. The others train in shards of `per_shard` that are averaged, all in Spark
tasks. Statistics and scores cover all documents, and whole texts, long ones in slices.

Nulls and the rest: a null lang is never learnt; a document without an id is not learnt
from but gets a prediction; a text that is null or has no letter is `und` with score 0,
and so is every text where nothing could be learnt; repeated documents count as often as
they occur in document frequencies and once in training; equal texts get equal results; of
equally likely languages the first in code point order is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..sources.scratch import materialize
from .bpe import _once

BITS = 16
ORDER = 3
SAMPLE = 12_288
LEAST = 512
LANGUAGES = 256
PER_SHARD = 8_192
EPOCHS = 2
SLICE = 1 << 20
UNKNOWN = "und"
BLANK = 32
ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))

_worker: dict = {}


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank where it is no letter."""
    out = np.full(0x110000, BLANK, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _slices(text: str, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text's letters with single blanks around words, in slices that begin with the end of the one before.

    Comes with how many characters of a slice the one before held already."""
    before = np.array([BLANK], dtype=np.uint32)
    for low in range(0, len(text), SLICE):
        codes = letters[np.frombuffer(text[low:low + SLICE].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if low + SLICE >= len(text):
            codes = np.append(codes, np.uint32(BLANK))
        codes = np.concatenate([before[-1:], codes])
        new = codes[1:][(codes[1:] != BLANK) | (codes[:-1] != BLANK)]
        whole = np.concatenate([before, new])
        yield len(before), whole
        before = whole[-(ORDER - 1):]


def counts_of(text: str | None, letters: np.ndarray, bits: int = BITS) -> np.ndarray | None:
    """How often each coordinate occurs in a text; None if it has no letter. A lone blank is no n-gram."""
    total = None
    for held, codes in _slices(text or "", letters):
        if total is None and not (codes != BLANK).any():
            continue
        grams = codes * ODD[0]
        parts = [grams[held:][codes[held:] != BLANK]]
        for n in range(2, ORDER + 1):
            grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * ODD[n - 1] + codes[n - 1:]
            parts.append(grams[max(0, held - n + 1):])
        h = np.concatenate(parts)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
        got = np.bincount((h >> np.uint32(32 - bits)).astype(np.int64), minlength=1 << bits)
        total = got if total is None else total + got
    return total


def _tables() -> np.ndarray:
    return _once(_worker, "letters", _letters)


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts each coordinate occurs, and how many texts have a letter; `texts` has the column text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total, n = _tables(), np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                own = counts_of(text.as_py(), letters, bits)
                if own is not None:
                    total += own > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))],
                                         names=["at", "n"])
    found = texts.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()     # at most 2^bits + 1 rows
    out = np.zeros(1 << bits, dtype=np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def vector_of(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, values) of a TF-IDF vector of length 1."""
    at = np.flatnonzero(counts > 0)
    return at, _weighed(counts[at], idf[at])


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf
    return v / np.sqrt((v * v).sum())


class MultinomialFtrl:
    """Follow the regularised leader, proximal, one column of weights a class: softmax loss, elastic net."""

    def __init__(self, size: int, classes: int, alpha: float = 5.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.01):
        self.z, self.n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        """Weights at some coordinates; the last one is the bias, which is not shrunk."""
        z = self.z[at]
        small = np.abs(z) <= self.l1
        out = np.where(small, 0.0, (np.sign(z) * self.l1 - z)
                       / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))
        out[-1] = -z[-1] / ((self.beta + np.sqrt(self.n[at][-1])) / self.alpha)
        return out

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        """One step; `at` ends with the bias' coordinate, `values` with 1."""
        w = self.weights(at)
        error = softmax(values @ w)
        error[label] -= 1
        g = np.outer(values, error)
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 60) -> float:
    """The temperature of least weighted log loss, by golden section on its logarithm; 1 without documents.

    One document more of another language is assumed to have been seen, so that no score becomes certain."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    other = 1 / (len(labels) + 2)
    target = np.full(logits.shape, other / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - other

    def loss(log_t: float) -> float:
        return -(weights[:, None] * target * np.log(np.clip(softmax(logits / np.exp(log_t)), 1e-300, 1))).sum()
    ratio = (np.sqrt(5) - 1) / 2
    low, high = np.log(0.02), np.log(20)
    for _ in range(rounds):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    """Languages in code point order, inverse frequencies, weights (the last row is the bias), temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float = 1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, heat

    def packed(self) -> tuple:
        """What is broadcast: rows of weights that are not all zero, and the inverse frequencies."""
        at = np.flatnonzero(self.weights.any(axis=1)).astype(np.int32)
        return self.languages, self.idf, at, self.weights[at].astype(np.float32), self.weights.shape, self.temperature

    @classmethod
    def unpacked(cls, languages, idf, at, rows, shape, heat) -> LanguageModel:
        weights = np.zeros(shape, dtype=np.float32)
        weights[at] = rows
        return cls(languages, idf, weights, heat)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, values = vector_of(counts, self.idf)
        return values @ self.weights[at] + self.weights[-1]


def _sample(learn: DataFrame, size: int, least: int, languages: int) -> tuple[dict[str, int], DataFrame]:
    """Languages with their number of documents, and (h, lang, text) of a sample of each, those of lowest hash."""
    sizes = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return {}, learn.select(F.lit(0).cast("long").alias("h"), "lang", "text")
    total = sum(r["count"] for r in sizes)
    quota = {r["lang"]: max(least, round(size * r["count"] / total)) for r in sizes}
    # Half as many again pass a cut of the hash, so that the windows below stay as small as the sample.
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 1.5 * quota[r["lang"]] / r["count"]))])
    most = F.create_map(*[F.lit(v) for lang in quota for v in (lang, quota[lang])])
    h = F.xxhash64("id", "text", F.lit("language"))
    place = (F.shiftrightunsigned(h, 11) / float(1 << 53)).alias("place")
    passed = learn.select(h.alias("h"), "lang", "text", place).where(F.col("place") < F.try_element_at(share, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("place", "h")
    rows = passed.dropDuplicates(["lang", "h"]).withColumn("nth", F.row_number().over(order))
    return {r["lang"]: r["count"] for r in sorted(sizes, key=lambda r: r["lang"])}, rows.where(
        F.col("nth") <= most[F.col("lang")]).select("h", "lang", "text")


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, least: int = LEAST, languages: int = LANGUAGES, per_shard: int = PER_SHARD,
          epochs: int = EPOCHS, bits: int = BITS) -> LanguageModel:
    """A model from the documents that the condition `learn` holds for."""
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                                    F.col(lang_col).cast("string").alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL")
    sizes, drawn_rows = _sample(rows, sample, least, languages)
    known = list(sizes)
    df, n = document_frequencies(rows, bits) if known else (np.zeros(1 << bits, dtype=np.int64), 0)
    idf, number, size, classes = inverse_frequencies(df, n), {v: i for i, v in enumerate(known)}, 1 << bits, len(known)
    model = LanguageModel(known, idf, np.zeros((size + 1, classes), dtype=np.float32))
    if not known:
        return model

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _tables()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for h, lang, text in zip(*batch.columns):
                counts = counts_of(text.as_py(), letters, bits)
                if counts is not None:
                    at = np.flatnonzero(counts > 0)
                    for column, value in zip(out, (h.as_py(), number[lang.as_py()], at.astype("<u4").tobytes(),
                                                   counts[at].astype("<u4").tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["h", "y", "at", "n"])

    made = materialize(drawn_rows.mapInArrow(vectors, "h long, y int, at binary, n binary"),
                       "language_sample")
    apart = F.pmod(F.xxhash64("h", F.lit("calibration")), F.lit(5)) == 0
    kept = made.where(~apart)
    drawn = {(r["y"], r["apart"]): r["count"] for r in made.groupBy("y", apart.alias("apart")).count().collect()}
    shards = max(1, -(-sum(c for (_, a), c in drawn.items() if not a) // per_shard))

    def unpacked(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.lexsort((table.column("y").to_numpy(), table.column("h").to_numpy()))
        for i in order.tolist():
            at = np.frombuffer(table.column("at")[i].as_py(), dtype="<u4").astype(np.int64)
            v = _weighed(np.frombuffer(table.column("n")[i].as_py(), dtype="<u4"), idf[at])
            yield table.column("y")[i].as_py(), np.append(at, size), np.append(v, 1.0)

    def fit(table: pa.Table) -> pa.Table:
        learner, own = MultinomialFtrl(size, classes), list(unpacked(table))
        for _ in range(epochs):
            for y, at, values in own:
                learner.learn(at, values, y)
        return pa.table({"rows": pa.array([len(own)], pa.int64()),
                         "weights": pa.array([learner.weights().astype("<f4").tobytes()], pa.binary())})

    fits = kept.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards))).applyInArrow(fit, "rows long, weights binary").collect()
    total = sum(r["rows"] for r in fits)
    for r in sorted(fits, key=lambda r: bytes(r["weights"])):
        model.weights += np.frombuffer(r["weights"], dtype="<f4").reshape(size + 1, classes) * np.float32(r["rows"] / total)
    over = np.array([sizes[v] / max(1, drawn.get((i, False), 0)) for i, v in enumerate(known)])
    model.weights[-1] += np.log(over / over.max()).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast(model.packed())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel.unpacked(*held.value)
        for batch in batches:
            ys, logits = [], []
            for y, at, values in unpacked(pa.Table.from_batches([batch])):
                ys.append(y)
                logits.append((values @ own.weights[at]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(logits, pa.list_(pa.float64()))],
                                             names=["y", "logits"])
    # A fifth of the sample, a few numbers each.
    seen = made.where(apart).mapInArrow(judged, "y int, logits array<double>").collect()
    labels = np.array([r["y"] for r in seen], dtype=np.int64)
    weights = np.array([sizes[known[y]] / drawn[y, True] for y in labels.tolist()])
    model.temperature = temperature(np.array([r["logits"] for r in seen]).reshape(len(seen), classes), labels, weights)
    held.unpersist()
    return model


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): `row` holds all columns of the document, `score` the probability of the prediction."""
    held = docs.sparkSession.sparkContext.broadcast(model.packed())
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([plain.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, own = _tables(), LanguageModel.unpacked(*held.value)
        bits = len(own.idf).bit_length() - 1
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                counts = counts_of(text.as_py(), letters, bits) if own.languages else None
                if counts is None:
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                p = softmax(own.logits(counts) / own.temperature)
                best = int(p.argmax())
                langs.append(own.languages[best]), scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=schema.names)
    return plain.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Documents that are never learnt from; one without an id isn't either, but is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
