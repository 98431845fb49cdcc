"""Runs: stretches of words that repeat with one period, found exactly in every text.

A run is a stretch with smallest period q (words q apart are the same) of at least
max(`shortest`, `repeats` * q) words that no neighbouring word extends. Words q apart
then agree at (`repeats` - 1) * q places or more in a row, so one of them lies on a grid
of that step: over all periods these are O(n log n) candidates, by the harmonic sum.
Those whose two words agree are extended both ways by longest common extensions on the
run-length grammar of `recompression`; what is long enough is a run. Multiples of a
period give the same stretch, and the smallest stays.

Texts of a batch are put together until they have `chunk_words` words and share one
grammar; a longer text makes a grammar of its own. Candidates are made `chunk_words` at
a time. So memory follows the longest text, and nothing is shuffled.

Nulls and the rest: a null or empty text has no words and no runs, and collapses to "";
a text of any length is searched as a whole; equal texts have equal runs, and every row
stays a row; other columns are kept in `row`, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .recompression import Grammar
from .text import words_of

REPEATS = 4
SHORTEST = 6
CHUNK_WORDS = 400_000
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal ones alike, and how many each text has."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    made = map(_Numbers().__getitem__, chain.from_iterable(texts))
    return np.fromiter(made, dtype=np.int64, count=int(lengths.sum())), lengths


def _candidates(grammar: Grammar, lengths: np.ndarray, repeats: int, shortest: int,
                chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): grid points whose word is the same one period later, a chunk at a time."""
    per_text = lengths // repeats
    ends = np.cumsum(per_text)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, max(1, chunk // 8)):
        pair = np.arange(low, min(total, low + max(1, chunk // 8)))
        text = np.searchsorted(ends, pair, side="right")
        period = pair - (ends - per_text)[text] + 1
        step = np.maximum(repeats * period, shortest) - period
        count = np.maximum(0, -(-(lengths[text] - period) // step))
        base = grammar.offset[text]
        bounds = np.searchsorted(np.cumsum(count), np.arange(chunk, int(count.sum()) + chunk, chunk))
        for a, b in zip([0, *(bounds[:-1] + 1)], bounds + 1):
            c, p = count[a:b], period[a:b]
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            p = np.repeat(p, c)
            at = np.repeat(base[a:b], c) + nth * np.repeat(step[a:b], c)
            same = grammar.text[at] == grammar.text[at + p]
            yield at[same], p[same]


def find_runs(texts: list[list[bytes]], repeats: int = REPEATS, shortest: int = SHORTEST,
              chunk: int = CHUNK_WORDS) -> list[np.ndarray]:
    """For each text its runs, as rows (start, length, period) by start, then period."""
    words, lengths = _numbered(texts)
    grammar = Grammar(words, lengths)
    found = []
    for at, period in _candidates(grammar, lengths, repeats, shortest, chunk):
        ahead = grammar.forward(at, at + period)
        behind = grammar.backward(at - 1, at - 1 + period)
        length = ahead + behind + period
        good = length >= np.maximum(shortest, repeats * period)
        found.append(np.stack([at - behind, length, period], 1)[good])
    rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(grammar.offset, rows[:, 0], side="right") - 1
    if len(rows):
        rows[:, 0] -= grammar.offset[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [rows[cuts[i]:cuts[i + 1]] for i in range(len(texts))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside runs and the first period of each, joined by one space."""
    if len(runs):
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text_col: str = "text", repeats: int = REPEATS, shortest: int = SHORTEST,
                  chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(row, n_words, runs, collapsed): `row` holds the other columns, `runs` (start, length, period)."""
    if repeats < 2 or shortest < 2:
        raise ValueError("a run repeats at least twice")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.struct(F.lit(0)).alias("row"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("collapsed", T.StringType())])
    kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def made(batch: pa.RecordBatch, begin: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(texts, repeats, shortest, chunk_words)
        flat = np.concatenate(runs) if runs else np.empty((0, 3), dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind))
        kept = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, runs)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).slice(begin, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(kept, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, begin = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if texts and size + len(words) > chunk_words:
                    yield made(batch, begin, texts)
                    texts, size, begin = [], 0, i
                texts.append(words)
                size += len(words)
            if texts:
                yield made(batch, begin, texts)
    return rows.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first, then the one of smallest period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start, then period, so a later one must be strictly better.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def with_periodic_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a periodic tail put into each of those whose hash ends in 0; `text` alone changes.

    With h the crc32 of the id as text and g = h / 10, a text of n words keeps its first a = g % n of them and goes on
    with period 1 + (n - a) / (3 + g % 8), whole divisions."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    held = "words"
    while held in docs.columns:
        held += "_"
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.when(F.size(held) > 0, F.size(held).cast("long"))     # null where nothing changes
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                       lambda i: F.element_at(held, (place(i) + 1).cast("int")))
    return docs.withColumn(held, F.when(h % 10 == 0, words)).withColumn(
        text_col, F.coalesce(F.array_join(tail, " "), F.col(text_col))).drop(held)
