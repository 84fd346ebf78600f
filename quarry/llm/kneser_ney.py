"""Class-conditional Kneser-Ney models over the letters of words.

A word is spelt as its lower-cased bytes and an end mark; each symbol is predicted from the up to five
symbols before it in the word.  The three highest orders belong to one class, with absolute
discounting at the top and continuation counts below; the lower orders are continuation counts that
both classes share, so rare expressions are smoothed alike and do not tell the classes apart.
"""

from __future__ import annotations

import numpy as np

from quarry.llm.words import _FOLD

ORDER = 6
SHARED = 3
_START, _END = 1, 2


def spelt(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram key of every symbol of the given words, and the words' offsets into the keys.
    A key holds the predicted symbol in its low byte and the symbols before it above."""
    sizes = ends - starts + 1
    off = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(off[-1]) - off[:-1][word]
    symbols = np.full(off[-1], _END, np.uint64)
    inner = at < (sizes - 1)[word]
    symbols[inner] = _FOLD[buf[(starts[word] + at)[inner]]]
    keys = symbols.copy()
    for i in range(1, ORDER):
        before = np.zeros(len(symbols), np.uint64)
        before[i:] = symbols[:-i] if len(symbols) > i else symbols[:0]
        before[at < i] = 0
        before[at == i - 1] = _START
        keys |= before << np.uint64(8 * i)
    return keys, off


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class _Level:
    """Discounted counts of one order: P(w | h) = max(n - d, 0) / n(h) + weight(h) * lower."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = grams, counts.astype(np.float64)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        self.discount = min(0.95, max(0.5, once / (once + 2 * twice))) if once else 0.5
        self.heads, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)
        self.totals = np.bincount(inverse, self.counts, len(self.heads))
        self.kinds = np.bincount(inverse, minlength=len(self.heads)).astype(np.float64)

    def mixed(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return lower
        at, seen = _find(self.grams, keys)
        head, known = _find(self.heads, keys >> np.uint64(8))
        share = np.where(seen, np.maximum(self.counts[at] - self.discount, 0), 0)
        total = self.totals[head]
        return np.where(known, (share + self.discount * self.kinds[head] * lower) / total, lower)


def _cut(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * order)) - 1)


def _continuations(grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_cut(grams, order), return_counts=True)


class ClassModels:
    """Two models that share their low orders; ``ratio`` gives log P(toxic) - log P(ordinary)."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables: for class 0 and 1, the sorted distinct keys of order ``ORDER`` and their counts."""
        self.own: list[list[_Level]] = []
        pooled = np.unique(np.concatenate([t[0] for t in tables]))
        self.shared: list[_Level] = []
        grams = pooled
        for order in range(ORDER - 1, 0, -1):
            kinds, counts = _continuations(grams, order)
            if order <= SHARED:
                self.shared.insert(0, _Level(kinds, counts))
            grams = kinds
        for keys, counts in tables:
            levels, grams = [_Level(keys, counts)], keys
            for order in range(ORDER - 1, SHARED, -1):
                grams, kinds = _continuations(grams, order)
                levels.insert(0, _Level(grams, kinds))
            self.own.append(levels)

    def ratio(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        lower = np.full(len(keys), 1 / 256)
        for order, level in enumerate(self.shared, 1):
            lower = level.mixed(_cut(keys, order), lower)
        logs = []
        for levels in self.own:
            p = lower
            for order, level in enumerate(levels, SHARED + 1):
                p = level.mixed(_cut(keys, order), p)
            logs.append(np.log(p))
        return logs[1] - logs[0]
