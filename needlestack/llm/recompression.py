"""A run-length grammar by recompression, and longest common extensions on it.

A sequence of symbols is rewritten level by level. Even levels turn every block of one
symbol into one symbol; odd levels split the symbols in two halves and turn every pair
of a left and a right one into one symbol. Equal stretches are rewritten alike but for
their edges, so two positions are compared by walking up: at each level the uneven edge
is matched symbol by symbol and the rest goes on to the next level. Where symbols first
differ the walk goes down again and ends at the first different word. All queries walk
together, as arrays; a query costs a constant at each of O(log n) levels.

Many texts share one grammar: a separator of its own before, between and after them is
never rewritten and equals nothing else, so no extension leaves its text.
"""

from __future__ import annotations

import numpy as np

from .text import U64, mixed


class Level:
    """Symbols of one level, and how they group into the next one's."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, blocks: bool):
        self.symbols, self.begin, self.blocks = symbols, begin, blocks
        self.up = np.repeat(np.arange(len(begin) - 1), np.diff(begin))

    def reversed(self) -> Level:
        return Level(self.symbols[::-1], len(self.symbols) - self.begin[::-1], self.blocks)


def _named(begin: np.ndarray, symbols: np.ndarray, many: np.ndarray, keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """The next level's symbols: groups marked in `many` get a new name for each distinct key."""
    out = symbols[begin[:-1]].copy()
    names, at = np.unique(keys, return_inverse=True)
    out[many] = fresh + at
    return out, fresh + len(names)


class Grammar:
    """Levels over texts whose words are numbered from 0: `words` joined, `lengths` of the texts."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        texts = len(lengths)
        self.offset = np.cumsum(np.concatenate([[1], lengths[:-1] + 1])) if texts else np.empty(0, dtype=np.int64)
        symbols = np.empty(len(words) + texts + 1, dtype=np.int64)
        mark = np.zeros(len(symbols), dtype=bool)
        mark[0] = True
        if texts:
            mark[self.offset + lengths] = True
        symbols[mark] = -1 - np.arange(texts + 1)
        symbols[~mark] = words
        self.text = symbols
        self.levels: list[Level] = []
        fresh, level = int(words.max()) + 1 if len(words) else 0, 0
        while True:
            symbols, fresh = self._blocks(symbols, fresh)
            apart = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            if not apart.any():
                break
            symbols, fresh = self._pairs(symbols, apart, fresh, level)
            level += 1
        self.levels.append(Level(symbols, np.arange(len(symbols) + 1), False))
        self._back: list[Level] | None = None

    def _blocks(self, symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        begin = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1], [True]]))
        self.levels.append(Level(symbols, begin, True))
        size = np.diff(begin)
        many = np.flatnonzero(size > 1)
        if not len(many):
            return symbols, fresh
        letters, at = np.unique(symbols[begin[many]], return_inverse=True)
        return _named(begin, symbols, many, at.astype(np.int64) * (int(size.max()) + 1) + size[many], fresh)

    def _pairs(self, symbols: np.ndarray, apart: np.ndarray, fresh: int, level: int) -> tuple[np.ndarray, int]:
        side = (mixed(symbols.view(np.uint64) + U64(level * 0x51ED2701)) & U64(1)).astype(bool)
        one = apart & ~side[:-1] & side[1:]
        two = apart & side[:-1] & ~side[1:]
        chosen = one if one.sum() >= two.sum() else two
        second = np.concatenate([[False], chosen])
        begin = np.flatnonzero(np.concatenate([~second, [True]]))
        self.levels.append(Level(symbols, begin, False))
        first = np.flatnonzero(chosen)
        many = self.levels[-1].up[first]
        return _named(begin, symbols, many, symbols[first] * fresh + symbols[first + 1], fresh)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and b on are the same; a and b are different places of `text`."""
        return _extend(self.levels, a, b)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a and b, themselves included, are the same."""
        if self._back is None:
            self._back = [level.reversed() for level in self.levels]
        last = len(self.text) - 1
        return _extend(self._back, last - a, last - b)


def _edge(level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal symbols to pass at this level, and whether different ones follow at this level.

    Where none do, both places are then at a start of the next level's symbols: equal blocks are passed whole, and
    who stands on the right half of a pair passes it, the other's equal symbol being a right one too."""
    same = level.symbols[a] == level.symbols[b]
    if level.blocks:
        left, right = level.begin[level.up[a] + 1] - a, level.begin[level.up[b] + 1] - b
        return np.where(same, np.minimum(left, right), 0), ~same | (left != right)
    inside = (level.begin[level.up[a]] != a) | (level.begin[level.up[b]] != b)
    return (same & inside).astype(np.int64), ~same


def _extend(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    origin = np.asarray(a)
    at_a, at_b = origin.copy(), np.array(b, copy=True)
    settled = np.zeros(len(at_a), dtype=np.int64)
    live = np.arange(len(at_a))
    for k, level in enumerate(levels):
        x, y = at_a[live], at_b[live]
        steps, apart = _edge(level, x, y)
        x, y = x + steps, y + steps
        done = live[apart]
        settled[done], at_a[done], at_b[done] = k, x[apart], y[apart]
        live = live[~apart]
        if not len(live):
            break
        at_a[live], at_b[live] = level.up[x[~apart]], level.up[y[~apart]]
    for k in range(int(settled.max(initial=0)), 0, -1):
        # Different symbols stand here; below them at most one block or one symbol is still the same.
        move = np.flatnonzero(settled >= k)
        level = levels[k - 1]
        x, y = level.begin[at_a[move]], level.begin[at_b[move]]
        same = level.symbols[x] == level.symbols[y]
        size = np.minimum(level.begin[level.up[x] + 1] - x, level.begin[level.up[y] + 1] - y) if level.blocks else 1
        steps = np.where(same, size, 0)
        at_a[move], at_b[move] = x + steps, y + steps
    return at_a - origin
