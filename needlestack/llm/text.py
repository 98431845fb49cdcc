"""Words, hashes and row keys that the operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

U64 = np.uint64
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII white-space characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As `words_of`, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes, so that their order is as good as random."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def window_hashes(word_hashes: np.ndarray, k: int, base: int = ODD) -> np.ndarray:
    """Hash of every k consecutive words: a polynomial in an odd base, built by doubling."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, span, part, scale = None, 0, 1, word_hashes, base
    while True:
        if k & span:
            piece = part[done:done + n]
            out = piece if out is None else out * U64(scale) + piece
            done += span
        if span * 2 > k:
            return out
        part = part[:-span] * U64(scale) + part[span:]
        scale = scale * scale & MASK
        span *= 2


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles. Fewer words make one shingle of all; none, no shingle."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    if len(hashes) < k:
        return mixed(window_hashes(hashes, len(hashes)) + U64(len(hashes)))
    return np.unique(mixed(window_hashes(hashes, k)))


def row_key(*columns: str | Column) -> list[Column]:
    """Two 64-bit columns that identify a row by its values; nulls count as values."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(*reversed(columns), F.lit(1)).alias("k2")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2), whatever else the frame holds and however its columns are called."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.select("id", "text", *row_key("id", "text"))


def bit_filter(values: DataFrame, column: str, limit: int) -> np.ndarray:
    """Bit set of a long column's values, as 64-bit words for `passing`.

    It has 16 bits a value, and never more than `limit` bits: with more values it lets more through,
    but never stops one that is in it. Spark ors the words together.
    """
    bits = 1 << 16
    while bits < min(limit, 16 * values.count()):
        bits *= 2
    place = F.col(column).bitwiseAND(bits - 1)
    words = values.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def passing(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the unsigned values may be in the bit set."""
    place = values & U64(len(bits) * 64 - 1)
    return (bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) != 0
