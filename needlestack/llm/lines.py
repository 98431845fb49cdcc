"""Line dedup that can be undone: exact reference counts, and cuckoo filters in front of them.

The reference-count table says in how many documents each line key occurs. Inserting
documents adds to it, deleting them subtracts, and either one changes the filters only
by the keys that cross the threshold. The filters (one per shard of the key space) let a
scan of documents tell most lines from repeated ones without moving them; what they
let through is checked against the counts, so the answer is exact.

Nulls, ties and the rest: a null or empty text is one empty line; an empty key never
counts; a key counts once per row, and rows that repeat count each; an empty table gives
an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.skew import join_small
from ..sources.scratch import materialize
from .text import keyed, row_key

MIN_DOCS = 10
MIN_KEY_CHARS = 1
KEYS_PER_SHARD = 1_000_000
#: Filters together are broadcast up to this many bytes; beyond it every line is checked against the counts.
FILTER_BYTES = 64 << 20


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys: ends stripped of white space, A-Z lower-cased."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [line.strip().lower() for line in lines]


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


class CuckooFilter:
    """Membership of 16-byte digests in buckets of four 16-bit fingerprints; entries can be deleted.

    A digest has two buckets; each follows from the other and the fingerprint alone. An
    insertion that finds both full moves entries on; when that runs too long the table
    is built anew at twice its size from the caller's keys.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * cls.SLOTS * 0.85 < max(1, n):
            buckets *= 2
        return cls(buckets)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[4:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 7 & self.mask)

    def holds(self, keys: list[bytes]) -> np.ndarray:
        """Which digests may be inside: never no for one that is."""
        parts = np.frombuffer(b"".join(keys), dtype="<u4").reshape(-1, 4)
        mark = parts[:, 0].astype(np.int64) & 0xFFFF
        mark[mark == 0] = 1
        first = parts[:, 1].astype(np.int64) & self.mask
        other = first ^ (mark * 0x5BD1E995 >> 7 & self.mask)
        own = mark[:, None]
        return (self.table[first] == own).any(axis=1) | (self.table[other] == own).any(axis=1)

    def insert(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = a
        for i in range(self.KICKS):
            slot = (mark + i) % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False


def build_filter(keys: list[bytes]) -> CuckooFilter:
    room = len(keys)
    while True:
        made = CuckooFilter.sized(room)
        if all(made.insert(k) for k in keys):
            return made
        room *= 2


def _count_keys(docs: DataFrame, least: int) -> DataFrame:
    """(key, n): in how many rows each line key occurs. Counts are summed within a batch first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column(0).to_pylist():
                for key in set(line_keys(text)[1]):
                    if long_enough(key, least):
                        seen[key] = seen.get(key, 0) + 1
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(k) for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                    names=["key", "n"])
    part = docs.select(F.col("text")).mapInArrow(count, "key binary, n long")
    return part.groupBy("key").agg(F.sum("n").alias("n"))


def _shard(shards: int):
    """Shard of a digest: its last four bytes, as `_shards_of` reads them."""
    return (F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long") % shards).cast("int")


def _shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=">u4").reshape(-1, 4)[:, 3] % shards


class LineIndex:
    """Reference counts of line keys and the filters of the repeated ones. Updates give a new index."""

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.counts, self.filters = counts, filters
        self.shards, self.min_docs, self.min_chars = shards, min_docs, min_chars

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
              min_chars: int = MIN_KEY_CHARS, shards: int | None = None) -> LineIndex:
        counts = materialize(_count_keys(keyed(docs, id_col, text_col), min_chars), "line_counts")
        hot = counts.where(F.col("n") >= min_docs)
        if shards is None:
            shards = max(1, -(-hot.count() // KEYS_PER_SHARD))
        index = cls(counts, counts.limit(0), shards, min_docs, min_chars)
        index.filters = materialize(index._filters_of(hot), "line_filters")
        return index

    def _filters_of(self, hot: DataFrame) -> DataFrame:
        def build(table: pa.Table) -> pa.Table:
            made = build_filter(sorted(table.column("key").to_pylist()))
            return pa.table({"shard": table.column("shard")[:1], "filter": pa.array([made.dump()], pa.binary())})
        return hot.select(_shard(self.shards).alias("shard"), "key").groupBy("shard").applyInArrow(
            build, "shard int, filter binary")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._updated(docs, id_col, text_col, 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Without these documents, which must be in the index."""
        return self._updated(docs, id_col, text_col, -1)

    def _updated(self, docs: DataFrame, id_col: str, text_col: str, sign: int) -> LineIndex:
        change = _count_keys(keyed(docs, id_col, text_col), self.min_chars).select(
            "key", F.lit(0).cast("long").alias("old"), (F.col("n") * sign).alias("more"))
        both = self.counts.select("key", F.col("n").alias("old"), F.lit(0).cast("long").alias("more")).unionByName(change)
        both = materialize(both.groupBy("key").agg(F.sum("old").alias("old"), F.sum("more").alias("more")), "line_change")
        now = F.col("old") + F.col("more")
        was_in, is_in = F.col("old") >= self.min_docs, now >= self.min_docs
        crossing = both.where(was_in != is_in).select(_shard(self.shards).alias("shard"), "key", is_in.alias("enters"))
        counts = both.where(now > 0).select("key", now.alias("n"))

        def update(key, filters: pa.Table, keys: pa.Table) -> pa.Table:
            moves = sorted(zip(keys.column("key").to_pylist(), keys.column("enters").to_pylist()))
            enters = [k for k, e in moves if e]
            fits = True
            if filters.num_rows:
                made = CuckooFilter.load(filters.column("filter")[0].as_py())
                for k, e in moves:
                    if not e:
                        made.delete(k)
                fits = all(made.insert(k) for k in enters)
            else:
                made = build_filter(enters)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()),
                             "filter": pa.array([made.dump() if fits else None], pa.binary())})

        filters = materialize(self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(
            update, "shard int, filter binary"), "line_filters")
        index = LineIndex(counts, filters, self.shards, self.min_docs, self.min_chars)
        full = filters.where(F.col("filter").isNull()).select("shard")
        if full.limit(1).count():       # a filter that overflowed is built anew from the counts
            hot = counts.where(F.col("n") >= self.min_docs).withColumn("shard", _shard(self.shards)).join(full, "shard")
            index.filters = materialize(
                filters.where(F.col("filter").isNotNull()).unionByName(index._filters_of(hot.select("key"))), "line_filters")
        return index

    def repeated(self, docs: DataFrame) -> DataFrame:
        """(k1, k2, keys): the keys of each document that the counts call repeated. `docs` is keyed."""
        spark = docs.sparkSession
        total = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        held = None
        if total <= FILTER_BYTES:
            held = spark.sparkContext.broadcast({r["shard"]: r["filter"] for r in self.filters.collect()})
        least, shards = self.min_chars, self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = None if held is None else {s: CuckooFilter.load(f) for s, f in held.value.items()}
            for batch in batches:
                rows, keys = [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    for key in set(line_keys(text)[1]):
                        if long_enough(key, least):
                            rows.append(i)
                            keys.append(digest(key))
                if not keys:
                    continue
                maybe = np.ones(len(keys), dtype=bool)
                if filters is not None:
                    shard = _shards_of(keys, shards)
                    maybe[:] = False
                    for s, f in filters.items():
                        own = np.flatnonzero(shard == s)
                        if len(own):
                            maybe[own] = f.holds([keys[i] for i in own])
                at = np.flatnonzero(maybe)
                row = pa.array(np.asarray(rows)[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row),
                     pa.array([keys[i] for i in at], pa.binary())], names=["k1", "k2", "key"])
        hits = docs.select("k1", "k2", "text").mapInArrow(probe, "k1 long, k2 long, key binary")
        exact = self.counts.where(F.col("n") >= self.min_docs).select("key")
        return join_small(hits, exact, ["key"]).groupBy("k1", "k2").agg(F.collect_set("key").alias("keys"))


def drop_repeated(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept) of every row: `row` holds its other columns, `kept` its text
    without the repeated lines."""
    others = [c for c in docs.columns if c != text_col]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text"), *row_key(F.col(id_col), text))
    found = index.repeated(rows)
    together = rows.join(found, ["k1", "k2"], "left").select("row", "text", "keys")
    schema = T.StructType([together.schema["row"], T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, own = line_keys(text)
                left = lines
                if keys:
                    bad = set(keys)
                    left = [line for line, key in zip(lines, own) if digest(key) not in bad]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.string())], names=schema.names)
    return together.mapInArrow(cut, schema)
