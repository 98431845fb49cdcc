"""Exact removal of repeated passages, by super-k-mers.

A window is `window` consecutive words. Its minimiser is the leftmost run of `seed` words
in it with the smallest hash; consecutive windows mostly share one, and such a run of
windows travels as one packed string to its minimiser's bucket. Equal windows have equal
minimisers, so they meet in one bucket, where sorting the windows counts them exactly.

1. Count minimisers. A window can only repeat if its minimiser does, so one bit per hash
   of a repeated minimiser goes to all tasks (at most `filter_bits` bits; with more
   repeated minimisers the filter passes more, and the result stays the same).
2. A second pass over the texts writes the packed strings that pass, equal ones of one batch
   as one row with a count, and where each comes from. The strings travel to their buckets.
   A bucket is read in sorted order, and its windows are sorted in chunks.
   A minimiser with more words than a chunk may hold hands its windows on to a shuffle
   by window instead.
3. Each packed string gets a mask of its repeated windows; documents look theirs up and
   drop the words those windows cover.

Nulls and the rest: a null or empty text has no words and keeps none; fewer words than a
window are all kept; rows that repeat are places of their own, so each loses its
windows; a window that repeats inside one document counts as repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import materialize
from .bpe import _once
from .text import WordHashes, bit_filter, mixed, passing, row_key, window_hashes, words_of

WINDOW = 35
SEED = 8
FILTER_BITS = 1 << 26
CHUNK_WORDS = 400_000
GROUP_WORDS = 4_000_000
FLUSH_BYTES = 8 << 20
OTHER_BASE = 0xD6E8FEB86659FD93

_worker: dict = {}


def _hashes() -> WordHashes:
    return _once(_worker, "hashes", WordHashes)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value among every `width` consecutive ones, by doubling."""
    n = len(values) - width + 1
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = at[:n], at[width - span:width - span + n]
    return np.where(values[right] < values[left], right, left)


def super_kmers(hashes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimisers, first windows, ends): maximal runs of windows whose minimiser sits at one place."""
    if len(hashes) < window:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    seeds = mixed(window_hashes(hashes, seed))
    at = leftmost_minimum(seeds, window - seed + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return seeds[at[first]], first, np.concatenate([first[1:], [len(at)]])


def _count_minimisers(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            found = [super_kmers(hashes.of(words_of(t.as_py())), window, seed)[0] for t in batch.column(0)]
            own, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n, pa.int64())], names=["m", "n"])
    return docs.select("text").mapInArrow(count, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))


def _travelling(text: str | None, bits: np.ndarray, window: int, seed: int) -> Iterator[tuple[int, int, bytes]]:
    """(minimiser, first window, packed words) of the super-k-mers of a text that may hold a repeat."""
    words = words_of(text)
    if len(words) < window:
        return
    minimisers, first, end = super_kmers(_hashes().of(words), window, seed)
    for i in np.flatnonzero(passing(minimisers, bits)).tolist():
        yield int(minimisers[i].view(np.int64)), int(first[i]), b" ".join(words[first[i]:end[i] + window - 1])


TRAVEL_SCHEMA = "k1 long, k2 long, key binary, first int, m long, words binary, n long"


def _travel(docs: DataFrame, held, window: int, seed: int) -> DataFrame:
    """Packed strings on their way to the buckets (m, key, words, n), equal ones of a batch once, and, without
    words, where each of them comes from (k1, k2, key, first): one pass over the texts."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, dtype=np.uint64)
        for batch in batches:
            rows: dict[bytes, list] = {}
            size, places, keys, first = 0, [], [], []
            for i, text in enumerate(batch.column(2)):
                for m, start, words in _travelling(text.as_py(), bits, window, seed):
                    key = xxhash.xxh3_128_digest(words)
                    places.append(i), keys.append(key), first.append(start)
                    if key in rows:
                        rows[key][2] += 1
                    else:
                        rows[key] = [m, words, 1]
                        size += len(words) + 100
                if size > FLUSH_BYTES:
                    yield _rows(rows)
                    rows, size = {}, 0
            if rows:
                yield _rows(rows)
            if keys:
                at = pa.array(places, pa.int64())
                none = lambda kind: pa.nulls(len(keys), kind)
                yield _batch(batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary()),
                             pa.array(first, pa.int32()), none(pa.int64()), none(pa.binary()), none(pa.int64()))
    return docs.select("k1", "k2", "text").mapInArrow(pack, TRAVEL_SCHEMA)


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["k1", "k2", "key", "first", "m", "words", "n"])


def _rows(rows: dict[bytes, list]) -> pa.RecordBatch:
    m, words, n = zip(*rows.values())
    none = lambda kind: pa.nulls(len(rows), kind)
    return _batch(none(pa.int64()), none(pa.int64()), pa.array(list(rows), pa.binary()), none(pa.int32()),
                  pa.array(m, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64()))


def _windows(rows: list[tuple[int, bytes, bytes, int]], window: int):
    """Keys, and for all their windows: number of the key, place inside it, count, two hashes."""
    keys, parts, lengths, counts, minimisers = [], [], [], [], []
    for m, key, words, n in rows:
        if keys and keys[-1] == key:
            counts[-1] += n
            continue
        split = words.split(b" ")
        keys.append(key), counts.append(n), minimisers.append(m)
        parts += split
        lengths.append(len(split))
    lengths = np.array(lengths)
    hashes = _hashes().of(parts)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    per = lengths - window + 1
    owner = np.repeat(np.arange(len(keys)), per)
    offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = begin[owner] + offset
    salt = mixed(np.array(minimisers, dtype=np.int64).view(np.uint64))[owner]
    h1 = window_hashes(hashes, window)[at] ^ salt
    h2 = window_hashes(hashes, window, OTHER_BASE)[at]
    return keys, owner, offset, np.array(counts)[owner], h1, h2


def _repeated_masks(rows: list, window: int) -> tuple[list[bytes], np.ndarray]:
    keys, owner, offset, n, h1, h2 = _windows(rows, window)
    order = np.lexsort((h2, h1))
    s1, s2 = h1[order], h2[order]
    new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
    starts = np.flatnonzero(new)
    many = np.add.reduceat(n[order], starts) > 1
    repeated = order[many[np.cumsum(new) - 1]]
    masks = np.zeros(len(keys), dtype=np.int64)
    np.add.at(masks, owner[repeated], np.int64(1) << offset[repeated])
    return keys, masks


BUCKET_SCHEMA = "key binary, mask long, place int, h1 long, h2 long, n long"


def _count_in_buckets(packed: DataFrame, window: int, group_words: int) -> DataFrame:
    """(key, mask): which windows of each packed string occur twice or more."""
    def settled(keys: list[bytes], masks: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(masks)
        none = lambda kind: pa.nulls(len(at), kind)
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in at], pa.binary()), pa.array(masks[at]), none(pa.int32()), none(pa.int64()),
             none(pa.int64()), none(pa.int64())], names=["key", "mask", "place", "h1", "h2", "n"])

    def passed_on(rows: list) -> pa.RecordBatch:
        keys, owner, offset, n, h1, h2 = _windows(rows, window)
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in owner], pa.binary()), pa.nulls(len(owner), pa.int64()),
             pa.array(offset.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
             pa.array(n)], names=["key", "mask", "place", "h1", "h2", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, group, size, group_size, current, large = [], [], 0, 0, None, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != current:
                    if large and group:
                        yield passed_on(group)
                    elif not large:
                        done += group
                        size += group_size
                    if size > CHUNK_WORDS:
                        yield settled(*_repeated_masks(done, window))
                        done, size = [], 0
                    current, group, group_size, large = row[0], [], 0, False
                group.append(row)
                group_size += row[2].count(b" ") + 1
                if group_size > group_words:
                    yield passed_on(group)
                    group, group_size, large = [], 0, True
        if large and group:
            yield passed_on(group)
        elif not large:
            done += group
        if done:
            yield settled(*_repeated_masks(done, window))

    sorted_rows = packed.repartition("m").sortWithinPartitions("m", "key")
    out = materialize(sorted_rows.mapInArrow(count, BUCKET_SCHEMA), "repeated_windows")
    single = out.where("mask IS NOT NULL").select("key", "mask")
    windows = out.where("mask IS NULL")
    twice = windows.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2")
    late = windows.join(twice, ["h1", "h2"]).groupBy("key").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    return single.unionByName(late)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 seed: int = SEED, filter_bits: int = FILTER_BITS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(row, n_words, n_removed, kept): `row` holds the other columns, `kept` the words that are left,
    joined by one space. Removes each word covered by a window that also starts anywhere else."""
    if not 0 <= window - seed <= 62:
        raise ValueError("a packed string's windows must fit a 64-bit mask")
    others = [c for c in docs.columns if c != text_col]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text"),
                       *row_key(F.col(id_col), text))
    repeated = materialize(_count_minimisers(rows, window, seed).where("n > 1").select("m"), "repeated_minimisers")
    bits = bit_filter(repeated, "m", filter_bits)
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    travelled = materialize(_travel(rows, held, window, seed), "super_kmers")
    packed = travelled.where("words IS NOT NULL").select("m", "key", "words", "n")
    masks = _count_in_buckets(packed, window, group_words)
    places = travelled.where("words IS NULL").select("k1", "k2", "key", "first")
    # A row that occurs twice has equal keys; its masks are the same, so one set of them serves both.
    found = places.join(masks, "key").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("first", "mask")).alias("found"))
    together = rows.join(found, ["k1", "k2"], "left").select("row", "text", "found.first", "found.mask")
    schema = T.StructType([together.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, first, mask in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = words_of(text.as_py())
                n_words.append(len(words))
                if first.is_valid:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    for start, own in zip(first.as_py(), mask.as_py()):
                        at = start + np.flatnonzero(np.int64(own) >> np.arange(window - seed + 1) & 1)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                    n_removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=schema.names)
    return together.mapInArrow(cut, schema)
