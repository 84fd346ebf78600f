"""What a Python worker keeps between batches: values by 64-bit hash, one operator's at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import numpy as np

#: Entries after which a cache starts afresh; results never depend on what it holds.
MOST = 800_000
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps under a name.  Keeping something new lets go of everything else, so that a
    worker that outlives an operator does not carry its memory into the next."""
    if name not in _held:
        _held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)
        _held[name] = make()
    return _held[name]


class HashCache:
    """Rows of ``width`` values by key; ``compute`` makes the rows that are missing."""

    def __init__(self, dtype: type, width: int = 1) -> None:
        self.dtype, self.width = dtype, width
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, self.width), self.dtype)

    def get(self, keys: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """keys: sorted and distinct.  compute gets the indices of the missing keys."""
        at = np.searchsorted(self.keys, keys)
        safe = np.minimum(at, max(len(self.keys) - 1, 0))
        seen = self.keys[safe] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if seen.all():
            return self.values[safe]
        new = np.flatnonzero(~seen)
        made = compute(new).reshape(len(new), self.width)
        out = np.empty((len(keys), self.width), self.dtype)
        out[seen], out[new] = self.values[safe[seen]], made
        if len(self.keys) + len(new) > MOST:
            self.clear()
            at = np.zeros(len(keys), np.int64)
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.values = np.insert(self.values, at[new], made, axis=0)
        return out
