"""Token counts at every prefix, by dynamic programming over the bytes of each piece.

A prefix of a piece has one possible last token; its count is one more than the count of
the prefix before that token. A text's counts are its pieces' counts added up, so how
many tokens a text has, whether it is over a limit, and where to cut it for a budget
are all read off, without encoding anything again.

Nulls and the rest: a null text is empty and has no tokens; special strings in a text
count as one token each, as the library's default has it; texts may be of any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import BOS, Merges, Remembered, _once

LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes for
    themselves, the others from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerges(Merges):
    """As `Merges`, where the file ranks pairs of tokens rather than their concatenation."""

    def __init__(self, vocabulary: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int]):
        super().__init__(vocabulary)
        self.pairs = pairs

    @classmethod
    def from_json(cls, path: str) -> tuple[PairMerges, list[str]]:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in file["added_tokens"]]
        vocabulary = {raw(t): i for t, i in file["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        return cls(vocabulary, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}), special

    def pair_rank(self, left: bytes, right: bytes) -> int | None:
        return self.pairs.get((left, right))


class PrefixCounter:
    """Counts of tokens at every prefix of a text."""

    PIECES = 250_000

    def __init__(self, merges: Merges, pattern: str, special: list[str] = ()):
        self.merges = merges
        self.cut = regex.compile(pattern).findall
        self.special = sorted(special, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))).finditer
        self.known = Remembered(lambda piece: self.piece_counts(piece.encode("utf-8", "replace"))[-1], self.PIECES)

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for every i from 0 on."""
        m = self.merges
        child, own, grows, known_fits = m.child, m.own, m.grows, m.known_fits
        last, count, alive = [BOS], [0], [(0, 0)]       # alive: where a token may still grow, and its node so far
        for n, byte in enumerate(piece, 1):
            growing, best = [], -1
            for s, node in alive:
                node = child.get(node << 8 | byte)
                if node is None:
                    continue
                if grows[node]:
                    growing.append((s, node))
                if best < 0:
                    token = own[node]
                    if token >= 0:
                        fit = known_fits.get((last[s], token))
                        if fit or fit is None and m.fits(last[s], token):
                            best = s
                            last.append(token)
                            count.append(count[s] + 1)
            if best < 0:
                raise ValueError("the vocabulary lacks single bytes")
            growing.append((n, 0))
            alive = growing
        return count

    def spans(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches between special strings, and those strings."""
        at = 0
        if any(word in text for word in self.special):
            for found in self.find_special(text):
                yield text[at:found.start()], False
                yield found.group(), True
                at = found.end()
        yield text[at:] if at else text, False

    def total(self, text: str | None) -> int:
        return sum(1 if is_special else sum(map(self.known.__getitem__, self.cut(stretch)))
                   for stretch, is_special in self.spans(text or ""))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Entry i: the tokens that the first i bytes of the text's pieces take. At piece ends these are
        the text's own tokens; inside a piece the cut piece's."""
        out, before = [0], 0
        for stretch, is_special in self.spans(text or ""):
            if is_special:
                out += [before + 1] * len(stretch.encode())
                before += 1
                continue
            for piece in self.cut(stretch):
                counts = self.piece_counts(piece.encode("utf-8", "replace"))
                out += [before + c for c in counts[1:]]
                before += counts[-1]
        return np.array(out)

    def fitting(self, text: str | None, budget: int) -> int:
        """Bytes of the longest run of whole pieces from the start that takes no more tokens than the budget."""
        n, size = 0, 0
        for stretch, is_special in self.spans(text or ""):
            for piece in [stretch] if is_special else self.cut(stretch):
                n += 1 if is_special else self.known[piece]
                if n > budget:
                    return size
                size += len(piece.encode("utf-8", "replace"))
        return size


_worker: dict = {}


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fitting_bytes) of every whole text.

    fitting_bytes: how many bytes, in whole pieces from the start, the limit has room for.
    `vocabulary` is the path of a vocabulary file that every executor can open.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([plain.schema["id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
                           T.StructField("fitting_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            merges, special = PairMerges.from_json(vocabulary)
            return PrefixCounter(merges, pattern, special)
        counter = _once(_worker, (vocabulary, pattern), make)
        for batch in batches:
            size, tokens, fitting = [], [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                size.append(len(text.encode("utf-8", "surrogatepass")))
                tokens.append(counter.total(text))
                fitting.append(size[-1] if tokens[-1] <= limit else counter.fitting(text, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fitting, pa.int64())], names=schema.names)
    return plain.mapInArrow(run, schema)
