"""Exact Jaccard join of shingle sets that skips by set relations.

Sets are ordered by how common their shingles are, and a set's first few shingles (its
prefix) go to an index: two sets that are similar enough share one of them. Three
relations between sets spare most of the work:

- Equal sets are one class from the start.
- Inside an index list, an entry's place in its set bounds what the two sets can still
  share. The smaller set of a pair must lie in the first block of places, and lists are
  joined block by block of sizes, so whole blocks are skipped.
- Every list has a pivot, and all its sets are compared with the pivot first. A set linked to
  it needs no comparison with the others linked to it: they are one component. For the rest,
  similarity is a metric: two sets whose similarities to a common pivot differ by more than
  1 - threshold can't be linked, which settles them from the answers of the pivot alone.

What is left after the pivots of two orders is compared pair by pair, each pair once, and only
where the two sets are not yet in one component. No pair that could join two components is skipped.

The links themselves are counted, or returned, after that: both ends of a link are in one
component, and their sizes are close. A component is cut into blocks of sets of one size step,
and a tile compares two blocks. Each tile has a pivot; what two of its sets share follows from
the answers of the pivot alone, that is from the shingles in which each differs from it. Shingles
that all sets share, or that only one set changes, need no look.

Nulls and the rest: a null text, or one without words, has the empty set and is linked with
nothing; fewer words than a shingle make one shingle of all; repeated rows are equal sets; a
null id takes part and is the smallest only where its component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.skew import join_small
from ..sources.scratch import materialize
from .bpe import _once
from .components import components
from .text import U64, WordHashes, bit_filter, lower_words_of, passing, row_key, shingle_set

SHINGLE = 3
THRESHOLD = (9, 10)
#: Broadcast bits that tell shared shingles (16 MiB), and steps of commonness (1 MiB).
SHARED_BITS = 27
FREQUENCY_BITS = 20
FILTER_BITS = 1 << 26
PIVOT_ORDERS = 2
#: About so many sets, and shingles of all of them, are one block of a component; a block has a set at least.
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 20
TILE_COLUMNS = 4096

_worker: dict = {}


def set_of(text: str | None, shingle: int) -> np.ndarray:
    return shingle_set(_once(_worker, "hashes", WordHashes).of(lower_words_of(text)), shingle)


def set_key(own: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


def prefix_size(n: int, threshold: tuple[int, int]) -> int:
    num, den = threshold
    return n - -(-num * n // den) + 1


def _new_sets(batches: Iterator[pa.RecordBatch], column: int, shingle: int) -> Iterator[list[tuple[bytes, np.ndarray, object]]]:
    """Batches of (key, set, text), leaving out sets that the task has met lately."""
    seen: set[bytes] = set()
    for batch in batches:
        out = []
        for cell in batch.column(column):
            text = cell.as_py()
            own = set_of(text, shingle)
            if len(own):
                key = set_key(own)
                if key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    out.append((key, own, text))
        yield out


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, k1, k2, n, d): size and key of every row's set; d is null for the empty set."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_of(t.as_py(), shingle) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(map(len, sets), pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())],
                names=["id", "k1", "k2", "n", "d"])
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("k1 long, k2 long, n long, d binary")])
    return rows.select("id", "k1", "k2", "text").mapInArrow(make, schema)


def _packed_tokens(rows: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """(bucket, tokens): the shingles of all sets, dealt by their leading bits, 32 further bits of each packed."""
    shift = 64 - buckets.bit_length() + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _new_sets(batches, 0, shingle):
            for part in range(0, len(sets), 2_000):
                own = np.sort(np.concatenate([s for _, s, _ in sets[part:part + 2_000]]))
                ends = np.searchsorted(own >> U64(shift), np.arange(buckets + 1, dtype=np.uint64))
                low = ((own << U64(64 - shift)) >> U64(32)).astype("<u4")
                full = np.flatnonzero(ends[1:] > ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)),
                     pa.array([low[ends[i]:ends[i + 1]].tobytes() for i in full], pa.binary())], names=["bucket", "tokens"])
    return rows.select("text").mapInArrow(pack, "bucket int, tokens binary")


def _frequencies(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared, steps): a bit for every shingle hash that several sets hold, and how common shingles are.

    Both have a fixed size and are read by a shingle's leading bits. `steps` grows with the logarithm of the
    largest count among the shingles that fall together. A shingle without its bit is in one set only.
    What falls together by chance only makes a shingle look more common than it is; any order is exact.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 256
    while buckets < min(4 * partitions, 1 << FREQUENCY_BITS):
        buckets *= 2
    lead = buckets.bit_length() - 1
    share_bits, share_steps = SHARED_BITS - lead, FREQUENCY_BITS - lead

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(bucket: int, parts: list) -> tuple[int, bytes, bytes]:
            own, n = np.unique(np.frombuffer(b"".join(parts), dtype="<u4"), return_counts=True)
            own, n = own[n > 1], n[n > 1]
            bits = np.zeros(1 << share_bits, dtype=np.uint8)
            bits[own >> np.uint32(32 - share_bits)] = 1
            steps = np.zeros(1 << share_steps, dtype=np.uint8)
            np.maximum.at(steps, own >> np.uint32(32 - share_steps), (2 * np.log2(n)).astype(np.uint8))
            return bucket, np.packbits(bits, bitorder="little").tobytes(), steps.tobytes()

        def rows_of(made: list) -> pa.RecordBatch:
            b, shared, steps = zip(*made)
            return pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array(shared, pa.binary()), pa.array(steps, pa.binary())],
                names=["bucket", "shared", "steps"])
        current, parts = None, []
        for batch in batches:
            made = []
            for bucket, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != current:
                    if parts:
                        made.append(settled(current, parts))
                    current, parts = bucket, []
                parts.append(tokens.as_py())
            if made:
                yield rows_of(made)
        if parts:
            yield rows_of([settled(current, parts)])
    packed = _packed_tokens(rows, shingle, buckets).repartition("bucket").sortWithinPartitions("bucket")
    shared = np.zeros((buckets, (1 << share_bits) // 8), dtype=np.uint8)
    steps = np.zeros((buckets, 1 << share_steps), dtype=np.uint8)
    for row in packed.mapInArrow(count, "bucket int, shared binary, steps binary").toArrow().to_pylist():
        shared[row["bucket"]] = np.frombuffer(row["shared"], dtype=np.uint8)
        steps[row["bucket"]] = np.frombuffer(row["steps"], dtype=np.uint8)
    return shared.reshape(-1), steps.reshape(-1)


def _index(rows: DataFrame, frequencies: tuple[np.ndarray, np.ndarray], shingle: int,
           threshold: tuple[int, int]) -> DataFrame:
    """(token, d, n, pos, p, pn, ppos): the index lists with two sets or more, each entry with its list's pivot.

    Shingles of one set alone come first in a prefix and need no list. The pivot is the entry with the lowest
    place: it has the fewest shingles of its own, so among edited copies it is close to the original, and the
    lists of one group of copies agree on it. A list is read as a stream, whatever its length.
    """
    held = rows.sparkSession.sparkContext.broadcast(tuple(a.tobytes() for a in frequencies))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, steps = (np.frombuffer(x, dtype=np.uint8) for x in held.value)
        for sets in _new_sets(batches, 0, shingle):
            tokens, keys, sizes, lengths, before = [], [], [], [], []
            for key, own, _ in sets:
                place = (own >> U64(64 - SHARED_BITS)).astype(np.int64)
                several = own[(shared[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0]
                alone = len(own) - len(several)
                room = prefix_size(len(own), threshold) - alone
                if room > 0:
                    # Sets are sorted by hash; a stable sort by commonness keeps that order inside a step.
                    order = np.argsort(steps[(several >> U64(64 - FREQUENCY_BITS)).astype(np.int64)], kind="stable")
                    first = several[order[:room]]
                    tokens.append(first), keys.append(key), sizes.append(len(own))
                    lengths.append(len(first)), before.append(alone)
            if keys:
                owner = np.repeat(np.arange(len(keys)), lengths)
                place = np.concatenate([np.arange(k) for k in lengths]) + np.array(before)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(keys, pa.binary()).take(pa.array(owner)),
                     pa.array((place << 32) | np.array(sizes)[owner])], names=["token", "d", "at"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, alone = (None, None, 0), False
        last = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                token, d, at = row
                if token != pivot[0]:
                    pivot, alone, last = row, True, d
                elif d != last:
                    if alone:
                        out.append((pivot, pivot))
                        alone = False
                    out.append((row, pivot))
                    last = d
            if out:
                own, led = [list(x) for x in zip(*(r for r, _ in out))], [list(x) for x in zip(*(p for _, p in out))]
                at, pat = np.array(own[2]), np.array(led[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[0], pa.int64()), pa.array(own[1], pa.binary()), pa.array(at & 0xFFFFFFFF),
                     pa.array(at >> 32), pa.array(led[1], pa.binary()), pa.array(pat & 0xFFFFFFFF),
                     pa.array(pat >> 32)], names=["token", "d", "n", "pos", "p", "pn", "ppos"])
    posted = rows.select("text").mapInArrow(post, "token long, d binary, at long")
    return posted.repartition("token").sortWithinPartitions("token", "at", "d").mapInArrow(
        pair, "token long, d binary, n long, pos long, p binary, pn long, ppos long")


def _may_link(n: str, pos: str, m: str, mpos: str, threshold: tuple[int, int]):
    """Whether sets of n and m shingles whose first common one is at these places can still be similar enough."""
    num, den = threshold
    a, b, i, j = (F.col(c) for c in (n, m, pos, mpos))
    sizes = (F.least(a, b) * den >= F.greatest(a, b) * num)
    return sizes & (F.least(a - i, b - j) * (num + den) >= (a + b) * num)


def _texts(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of `needed`, which has the key (k1, k2) of one row for each, with that row's text."""
    held = rows.sparkSession.sparkContext.broadcast(bit_filter(needed, "k1", FILTER_BITS).tobytes())

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, dtype=np.uint64)
        for batch in batches:
            pick = np.flatnonzero(passing(batch.column(0).to_numpy().view(np.uint64), bits))
            yield batch.take(pa.array(pick))
    texts = rows.select("k1", "k2", "text").mapInArrow(fetch, "k1 long, k2 long, text string")
    return texts.join(needed, ["k1", "k2"]).dropDuplicates(["d"])


def _compare(rows: DataFrame, reps: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(a, b, same, n, m): exact intersection size of the sets of each pair of keys. Written once."""
    pairs = materialize(pairs, "set_pairs")
    needed = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct()
    needed = materialize(needed.join(reps, "d"), "set_rows")
    texts = materialize(_texts(rows, needed).select("d", "text"), "set_texts")
    both = pairs.join(texts.select(F.col("d").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("d").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_set = None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c for c in batch.columns)):
                if b != last:
                    last, held_set = b, set_of(tb.as_py(), shingle)
                own = set_of(ta.as_py(), shingle)
                out.append((len(np.intersect1d(own, held_set, assume_unique=True)), len(own), len(held_set)))
            same, n, m = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(m, pa.int64())], names=["a", "b", "same", "n", "m"])
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(
        compare, "a binary, b binary, same long, n long, m long"), "set_similarities")


def _linked(threshold: tuple[int, int]):
    return F.expr(f"same * {threshold[1]} >= (n + m - same) * {threshold[0]}")


def _merge(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links between them: the links are taken between roots."""
    if roots is None:
        return materialize(components(links), "roots")
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    links = links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    above = materialize(components(links), "roots")
    higher = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(known.unionByName(above.join(roots, "node", "left_anti")), "roots")


def _with_roots(index: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that still hold two components, with each entry's component."""
    at = index.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("c", F.coalesce("root", "d"))
    at = materialize(at.drop("root"), "set_lists")
    mixed = at.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    return at.join(mixed, "token", "left_semi")


def _ordered(x: str, y: str):
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _tiled(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Members (root, d, n, ...) with their `tiles`: which two blocks each compares, and whether the set is in the second.

    Small components are one block. In others, linked sets are at most one size step apart (steps are
    a little wider than the threshold, so that rounding can't part them).
    """
    num, den = threshold
    own = (F.count(F.lit(1)), F.sum("n"))
    whole = members.groupBy("root").agg(((own[0] <= BLOCK_SETS) & (own[1] <= BLOCK_SHINGLES)).alias("small"))
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) * 1.0001)).cast("int")
    members = join_small(members, whole, ["root"]).withColumn("step", F.when(F.col("small"), 0).otherwise(step)).drop("small")
    steps = materialize(members.groupBy("root", "step").agg(F.greatest(
        F.ceil(own[0] / BLOCK_SETS), F.ceil(own[1] / BLOCK_SHINGLES)).cast("int").alias("parts")), "set_steps")
    above, below = (steps.select("root", (F.col("step") + by).alias("step"), F.col("parts").alias(name))
                    for name, by in (("above", -1), ("below", 1)))
    steps = steps.join(above, ["root", "step"], "left").join(below, ["root", "step"], "left").na.fill(0, ["above", "below"])
    out = join_small(members, steps, ["root", "step"])
    out = out.withColumn("part", F.expr("CAST(pmod(xxhash64(d), parts) AS INT)"))
    tiles = """concat(
        transform(sequence(0, parts - 1), q -> struct(step AS s, least(part, q) AS i, step AS t, greatest(part, q) AS j, part > q AS second)),
        transform(filter(sequence(0, above), q -> q < above), q -> struct(step AS s, part AS i, step + 1 AS t, q AS j, false AS second)),
        transform(filter(sequence(0, below), q -> q < below), q -> struct(step - 1 AS s, q AS i, step AS t, part AS j, true AS second)))"""
    return out.withColumn("tiles", F.expr(tiles)).drop("step", "parts", "above", "below", "part")


def tile_links(first: list[np.ndarray], second: list[np.ndarray] | None,
               threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, same): links of sets of one block with those of another, or within the first."""
    num, den = threshold
    sets = first + (second or [])
    cut = len(first)
    apart = [np.setxor1d(own, sets[0], assume_unique=True) for own in sets]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in apart])
    shingles, at = np.unique(np.concatenate(apart), return_inverse=True)
    held = np.bincount(at[owner < cut], minlength=len(shingles))
    if second is None:
        useful, low = held > 1, 0
    else:
        useful, low = (held > 0) & (np.bincount(at[owner >= cut], minlength=len(shingles)) > 0), cut
    column = np.cumsum(useful) - 1
    keep = useful[at]
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((cut, len(sets) - low), dtype=np.int64)
    width = int(useful.sum())
    for start in range(0, width, TILE_COLUMNS):
        lo, hi = np.searchsorted(at, (start, start + TILE_COLUMNS))
        table = np.zeros((len(sets), min(TILE_COLUMNS, width - start)), dtype=np.float32)
        table[owner[lo:hi], at[lo:hi] - start] = 1
        both += (table[:cut] @ table[low:].T).astype(np.int64)
    n, d = np.array([len(x) for x in sets]), np.array([len(x) for x in apart])
    total = n[:cut, None] + n[None, low:]
    same = (total - (d[:cut, None] + d[None, low:] - 2 * both)) // 2
    linked = same * den >= (total - same) * num
    x, y = np.nonzero(linked if second is not None else np.triu(linked, 1))
    return x, y + low, same[x, y]


def _links(rows: DataFrame, members: DataFrame, shingle: int, threshold: tuple[int, int], count: bool) -> DataFrame:
    """(d, n_links) of every linked set, or (a, b, same, n, m) of every link once."""
    members = materialize(_tiled(materialize(members, "set_members"), threshold), "set_members")
    texts = _texts(rows, members).select("root", "tiles", "d", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [set_of(t.as_py(), shingle).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())],
                                             names=["root", "tiles", "d", "own"])
    schema = T.StructType([*texts.schema.fields[:3], T.StructField("own", T.BinaryType())])
    key = ["root", "s", "i", "t", "j"]
    tiles = texts.mapInArrow(make, schema).select("root", F.inline("tiles"), "d", "own")
    tiles = tiles.repartition(*key).sortWithinPartitions(*key, "second").select(*key, "second", "d", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(tile: tuple, names: list, sets: list, cut: int) -> pa.RecordBatch | None:
            within = tile[1:3] == tile[3:5]
            if len(sets) < 2 or not (within or 0 < cut < len(sets)):
                return None
            x, y, same = tile_links(sets[:cut], None if within else sets[cut:], threshold)
            if not len(x):
                return None
            if count:
                n = np.bincount(x, minlength=len(sets)) + np.bincount(y, minlength=len(sets))
                some = np.flatnonzero(n)
                return pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.binary()), pa.array(n[some])],
                                                  names=["d", "n_links"])
            ends = [(u, v) if names[u] > names[v] else (v, u) for u, v in zip(x.tolist(), y.tolist())]
            columns = [pa.array([names[e[k]] for e in ends], pa.binary()) for k in (0, 1)]
            columns += [pa.array(same)] + [pa.array([len(sets[e[k]]) for e in ends], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "same", "n", "m"])

        tile, names, sets, cut = None, [], [], 0
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:5]))
            for at, second, d, own in zip(keys, *batch.columns[5:]):
                if at != tile:
                    if tile and (made := settled(tile, names, sets, cut)):
                        yield made
                    tile, names, sets, cut = at, [], [], 0
                names.append(d.as_py()), sets.append(np.frombuffer(own.as_py(), dtype=np.uint64))
                cut += not second.as_py()
        if tile and (made := settled(tile, names, sets, cut)):
            yield made
    if count:
        return tiles.mapInArrow(compare, "d binary, n_links long").groupBy("d").agg(F.sum("n_links").alias("n_links"))
    return tiles.mapInArrow(compare, "a binary, b binary, same long, n long, m long")


def _solved(docs: DataFrame, id_col: str, text_col: str, shingle: int,
            threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, sets, members, roots): all rows, their sets, the linked sets with their component, and its root."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *row_key(F.col(id_col), text))
    num, den = threshold
    sets = materialize(_sets(rows, shingle), "sets")
    reps = materialize(sets.where("d IS NOT NULL").groupBy("d").agg(F.min(F.struct("k1", "k2")).alias("r"), F.max("n").alias("size")).select(
        "d", "r.k1", "r.k2", "size"), "set_reps")       # the row that a set's text is read from
    index = materialize(_index(rows, _frequencies(rows, shingle), shingle, threshold), "set_index")

    may = partial(_may_link, threshold=threshold)
    first = index.where((F.col("d") != F.col("p")) & may("n", "pos", "pn", "ppos"))
    known = _compare(rows, reps, first.select(*_ordered("d", "p")).distinct(), shingle)
    roots = _merge(None, known.where(_linked(threshold)).select("a", "b"))

    for order in range(1, PIVOT_ORDERS):
        lists = materialize(_with_roots(index, roots), "set_lists")
        pivots = lists.groupBy("token").agg(F.min_by(
            F.struct("d", "n", "pos", "c"), F.struct(F.xxhash64("d", F.lit(order)), "d")).alias("q"))
        pairs = lists.join(pivots, "token").select("*", F.col("q.d").alias("qd"), F.col("q.n").alias("qn"),
                                                   F.col("q.pos").alias("qpos"))
        pairs = pairs.where((F.col("c") != F.col("q.c")) & may("n", "pos", "qn", "qpos"))
        pairs = pairs.select(*_ordered("d", "qd")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        more = _compare(rows, reps, pairs, shingle)
        known = known.unionByName(more)
        roots = _merge(roots, more.where(_linked(threshold)).select("a", "b"))

    # Pairs that are left: in one list, in two components, close in size, place and distance to the pivot.
    nearness = known.select(*["a", "b"], (F.col("same") / (F.col("n") + F.col("m") - F.col("same"))).alias("j"))
    nearness = nearness.select(F.col("a").alias("d"), F.col("b").alias("p"), "j").unionByName(
        nearness.select(F.col("b").alias("d"), F.col("a").alias("p"), "j"))
    lists = _with_roots(index, roots).join(nearness, ["d", "p"], "left")
    j = F.when(F.col("d") == F.col("p"), 1.0).otherwise(F.col("j"))
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int")
    lists = materialize(lists.select("token", "d", "n", "pos", "c", j.alias("j"), block.alias("block")), "set_lists")
    front = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den))
    small = lists.where(front).select("token", *[F.col(x).alias(f"s_{x}") for x in ("d", "n", "pos", "c", "j")],
                                      F.explode(F.array(F.col("block"), F.col("block") + 1, F.col("block") + 2)).alias("block"))
    pairs = lists.join(small, ["token", "block"]).where(
        (F.col("c") != F.col("s_c")) & ((F.col("s_n") < F.col("n")) | ((F.col("s_n") == F.col("n")) & (F.col("s_d") < F.col("d"))))
        & may("n", "pos", "s_n", "s_pos")
        & F.coalesce(F.abs(F.col("j") - F.col("s_j")) <= 1 - num / den + 1e-9, F.lit(True)))
    pairs = pairs.select(*_ordered("d", "s_d")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    more = _compare(rows, reps, pairs, shingle)
    roots = _merge(roots, more.where(_linked(threshold)).select("a", "b"))

    members = roots.select(F.col("node").alias("d"), "root").join(reps.withColumnRenamed("size", "n"), "d")
    return rows, sets, members, roots


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b, a_id, b_id, same, n, m): every link between two different sets once, in no order.

    a and b are the keys of the sets, a_id and b_id the smallest ids of the rows that have them,
    n and m their shingles and same how many both have. Rows with equal sets are one set.
    """
    rows, sets, members, _ = _solved(docs, id_col, text_col, shingle, threshold)
    links = _links(rows, members, shingle, threshold, count=False)
    least = sets.where("d IS NOT NULL").groupBy("d").agg(F.min("id").alias("least"))
    for end in ("a", "b"):
        links = links.join(least.select(F.col("d").alias(end), F.col("least").alias(f"{end}_id")), end)
    return links.select("a", "b", "a_id", "b_id", "same", "n", "m")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       threshold: tuple[int, int] = THRESHOLD, links: bool = False) -> DataFrame:
    """(id, k1, k2, n_shingles, component_id, component) of every row: the smallest id reachable by links, and a
    key of what is reachable, which is there without ids as well and null only for the empty set.

    Two sets link when their Jaccard similarity is at least threshold[0] / threshold[1]. With `links`
    there is n_links as well: how many different sets the row's set is linked with.
    """
    rows, sets, members, roots = _solved(docs, id_col, text_col, shingle, threshold)

    # Smallest ids: by set first, then by component, so that no group is ever gathered.
    own = sets.where("d IS NOT NULL").groupBy("d").agg(F.min("id").alias("least"))
    own = own.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").select(
        "d", "least", F.coalesce("root", "d").alias("root"))
    own = materialize(own, "set_roots")
    tops = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(tops, "root").select("d", "component_id", F.col("root").alias("component"))
    columns = []
    if links:
        named = named.join(_links(rows, members, shingle, threshold, count=True), "d", "left")
        columns = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    out = sets.join(named, "d", "left")
    return out.select("id", "k1", "k2", F.col("n").alias("n_shingles"),
                      F.when(F.col("d").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "component", *columns)
