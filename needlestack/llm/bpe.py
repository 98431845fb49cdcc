"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A text is cut by the pattern, and each piece runs through a transducer that reads bytes
and emits token ids. It rests on one fact about BPE: a sequence of tokens is the
encoding of its bytes exactly when every neighbouring pair is the encoding of the pair's
bytes. So every prefix has one possible last token, found from shorter prefixes, and a
boundary is certain as soon as every token that may still grow over the current byte
agrees on it. What is not certain yet is the transducer's state: the last certain token
and the bytes after it. States and transitions are made when first met and remembered up
to a bound, which only bounds memory: a forgotten one is made again.

Nulls and the rest: a null text is empty; an empty text has no ids and decodes to no
bytes; texts may be of any length; equal texts get equal ids.
"""

from __future__ import annotations

import base64
import codecs
import gc
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

BOS = -1
NEVER = 1 << 62
BYTES = [bytes((b,)) for b in range(256)]


class Merges:
    """A vocabulary of byte strings with ranks, and the plain merge procedure on short strings."""

    FITS = 1_000_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_id = {i: t for t, i in ranks.items()}
        # A node for every prefix of a token (0: no byte yet), its children by node and byte, its own id
        # if it is a token itself (else BOS), and whether a longer token begins with it.
        self.child: dict[int, int] = {}
        self.own: list[int] = [BOS]
        self.grows: list[bool] = [True]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                self.grows[node] = True
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.own)
                    self.own.append(BOS)
                    self.grows.append(False)
            self.own[node] = i
        self.known_fits: dict[tuple[int, int], bool] = {}
        self.known_steps: dict[int, list | None] = {}

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def plain(self, data: bytes, steps: list | None = None) -> list[int]:
        """Merge the pair of lowest rank until none is left. Quadratic: for single tokens and in tests.

        `steps` gets the first part, the rank of the merge that follows and the last part, before each merge."""
        if not data:
            return []
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.pair_rank(parts[i], parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            if steps is not None:
                steps.append((parts[0], best, parts[-1]))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pair_rank(self, left: bytes, right: bytes) -> int | None:
        return self.ranks.get(left + right)

    def steps(self, token: int) -> list[tuple[bytes, int, bytes]] | None:
        """How a token grows from its bytes; None if its bytes are encoded otherwise. At most one entry a token."""
        if token not in self.known_steps:
            data, steps = self.by_id[token], []
            whole = self.plain(data, steps) == [token]
            self.known_steps[token] = steps + [(data, NEVER, data)] if whole else None
        return self.known_steps[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes. Remembered in `known_fits`.

        At the start of a piece (left is BOS) the token must encode its own bytes. Otherwise both grow as they do
        alone, lowest rank first, until a merge across the boundary comes before the next merge of either."""
        if len(self.known_fits) > self.FITS:
            self.known_fits.clear()
        b = self.steps(right)
        got = b is not None
        if got and left != BOS:
            a = self.steps(left)
            got = a is not None and not self._meet(a, b)
        self.known_fits[left, right] = got
        return got

    def _meet(self, a: list, b: list) -> bool:
        """Whether a merge across the boundary happens. Of equal ranks the leftmost pair merges first."""
        i = j = 0
        while True:
            _, rank_a, end = a[i]
            start, rank_b, _ = b[j]
            cross = self.pair_rank(end, start)
            if cross is not None and cross < rank_a and cross <= rank_b:
                return True
            if rank_a == rank_b == NEVER:
                return False
            if rank_a <= rank_b:
                i += 1
            else:
                j += 1

    def fits_known(self, left: int, right: int) -> bool:
        got = self.known_fits.get((left, right))
        return self.fits(left, right) if got is None else got


class Remembered(dict):
    """A bounded memory of a function: the entries of the last two generations stay."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Transducer:
    """Bytes in, token ids out, with states made on demand."""

    MAX_STATES = 200_000

    def __init__(self, merges: Merges):
        self.merges = merges
        # For a node that was met: its longest proper suffix that is a node; the tokens that end with it, longest
        # first, with their lengths; and the lengths of those of its suffixes from which a token may still grow.
        self.link: dict[int, int] = {0: 0}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}
        self.lives: dict[int, tuple[int, ...]] = {0: (0,)}
        self.depth: dict[int, int] = {0: 0}
        self._forget()

    def _forget(self) -> None:
        # A state is the bytes after the last certain token; for each of their prefixes, where its last token
        # starts and which it is (for the empty one, the certain token); and the node of their longest suffix
        # with which a token begins. The boundaries from which a token may grow follow from that node.
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...], int]] = [(b"", (0,), (BOS,), 0)]
        # States that follow a token by what they are; others have one way to them from one of these.
        self.numbers: dict[tuple[int, bytes], int] = {(BOS, b""): 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}

    @staticmethod
    def _tokens(starts: tuple[int, ...], last: tuple[int, ...], end: int) -> list[int]:
        """The encoding up to a boundary, read backwards along the last tokens."""
        out = []
        while end:
            out.append(last[end])
            end = starts[end]
        return out[::-1]

    def _goto(self, node: int, byte: int) -> int:
        """The node of the longest suffix of a node's bytes and one more byte."""
        child, link = self.merges.child, self.link
        to = child.get(node << 8 | byte)
        while to is None and node:
            node = link[node]
            to = child.get(node << 8 | byte)
        if to is None:
            return 0
        if to not in link:
            shorter = self._goto(link[node], byte) if node else 0
            depth, token = self.depth[node] + 1, self.merges.own[to]
            self.depth[to], link[to] = depth, shorter
            self.ends[to] = (((depth, token),) if token >= 0 else ()) + self.ends[shorter]
            self.lives[to] = ((depth,) if self.merges.grows[to] else ()) + self.lives[shorter]
        return to

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        m = self.merges
        known_fits = m.known_fits
        tail, starts, last, node = self.states[state]
        tail += BYTES[byte]
        n = len(tail)
        node = self._goto(node, byte)
        for length, token in self.ends[node]:
            left = last[n - length]
            fit = known_fits.get((left, token))
            if fit or fit is None and m.fits(left, token):
                last += (token,)
                starts += (n - length,)
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        lives = self.lives[node]
        cut = n - lives[0]
        if cut:
            # Their encodings agree up to the boundary where the paths of last tokens meet.
            for length in lives:
                s = n - length
                while s != cut:
                    if s > cut:
                        s = starts[s]
                    else:
                        cut = starts[cut]
        if not cut:
            self.states.append((tail, starts, last, node))
            return len(self.states) - 1, ()
        emitted = tuple(self._tokens(starts, last, cut))
        tail, last = tail[cut:], last[cut:]
        key = (last[0], tail)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            starts = (0, *[s - cut for s in starts[cut + 1:]])
            self.states.append((tail, starts, last, node))
        return number, emitted

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(self.states) > self.MAX_STATES:
            self._forget()
        out: list[int] = []
        state = 0
        for byte in piece:
            key = state << 8 | byte
            got = self.next.get(key)
            if got is None:
                if len(self.states) > 2 * self.MAX_STATES:      # inside a very long piece: keep this state alone
                    held = self.states[state]
                    self._forget()
                    state = self.numbers.setdefault((held[2][0], held[0]), len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                    key = state << 8 | byte
                got = self.next[key] = self._step(state, byte)
            state, emitted = got
            if emitted:
                out += emitted
        tail, starts, last, _ = self.states[state]
        return out + self._tokens(starts, last, len(tail))


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same cut for texts of ASCII alone, in the standard library's faster syntax; None if it can't say it."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]")
    # The library's own \s takes U+001C to U+001F as well, which are no white space in Unicode.
    for class_, own in ((r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", r"[\t-\r ]"), (r"\S", r"[^\t-\r ]")):
        plain = plain.replace(class_, own)
    return None if r"\p" in plain or r"\P" in plain or "(?i" in plain else re.compile(plain)


class Encoder:
    """Whole texts to ids: the pattern cuts, the transducer encodes, frequent pieces are remembered."""

    PIECES = 500_000

    def __init__(self, merges: Merges, pattern: str):
        self.transducer = Transducer(merges)
        self.cut_any = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.cut_ascii = plain.findall if plain else self.cut_any
        self.known = Remembered(self._piece, self.PIECES)

    def cut(self, text: str) -> list[str]:
        return self.cut_ascii(text) if text.isascii() else self.cut_any(text)

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.cut(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()


class Decoder:
    """Ids back to bytes, and to text piece by piece."""

    def __init__(self, merges: Merges):
        self.table = [merges.by_id.get(i, b"") for i in range(max(merges.by_id, default=-1) + 1)]

    def bytes_of(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.table.__getitem__, ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole. The incremental UTF-8 machine holds back the
        bytes of an unfinished character; bytes that can't be UTF-8 become U+FFFD."""
        return self._machine(map(self.table.__getitem__, ids))

    def blocks(self, packed: bytes, block: int = 8192) -> Iterator[str]:
        """As `stream`, from packed ids, `block` of them at a time; a block may end inside a character."""
        size = 4 * block
        return self._machine(self.bytes_of(packed[at:at + size]) for at in range(0, len(packed), size))

    @staticmethod
    def _machine(parts: Iterable[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            text = machine.decode(part)
            if text:
                yield text
        rest = machine.decode(b"", final=True)
        if rest:
            yield rest


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: states and pieces are many and hold none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _once(made: dict, key, make):
    if key not in made:
        made[key] = make()
    return made[key]


_worker: dict = {}


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ids as packed 32-bit integers, and the bytes they decode to.

    `ranks` is the path of a rank file that every executor can open.
    """
    return _mapped(docs, ranks, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), hashed where the ids are made, so that only digests move."""
    return _mapped(docs, ranks, pattern, id_col, text_col, True)


def _mapped(docs, ranks, pattern, id_col, text_col, digests):
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = plain.schema["id"].dataType
    fields = ([("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests
              else [("ids", T.BinaryType()), ("decoded", T.BinaryType())])
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A Python worker serves many tasks; the vocabulary and what it has learned stay with it.
        merges = _once(_worker, ranks, lambda: Merges.from_file(ranks))
        encoder = _once(_worker, (ranks, pattern), lambda: Encoder(merges, pattern))
        decoder = _once(_worker, (ranks, "decoder"), lambda: Decoder(merges))
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            with uncollected():
                for text in batch.column(1):
                    ids = encoder.packed(text.as_py())
                    back = [part.encode() for part in decoder.blocks(ids)]
                    if digests:
                        digest = sha256()
                        for part in back:
                            digest.update(part)
                        row = len(ids) // 4, sha256(ids).hexdigest(), digest.hexdigest()
                    else:
                        row = ids, b"".join(back)
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)
    return plain.mapInArrow(run, schema)
