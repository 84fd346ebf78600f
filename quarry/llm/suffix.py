"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, binary-search merging."""

from __future__ import annotations

import numpy as np

_MOST = np.iinfo(np.int64).max


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a byte text in order.

    Groups start from eight-byte prefixes; each round sorts only the groups that are not yet single, by
    the group of the suffix as far on as is already sorted, and doubles that distance.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    keys = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n, 8), (1, 1)).copy().view(">u8").reshape(n).astype(np.uint64)
    # the last suffixes are shorter than their keys: each stands alone, before longer ones of its key
    full = max(n - 7, 0)
    order = np.argsort(keys[:full])
    tails = np.arange(n - 1, full - 1, -1)
    tails = tails[np.argsort(keys[tails], kind="stable")]
    spot = np.searchsorted(keys[order], keys[tails], "left")
    order = np.insert(order, spot, tails)
    alone = spot + np.arange(len(tails))
    keys = keys[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
    fresh[alone] = fresh[alone + 1] = True
    starts = np.flatnonzero(fresh[:-1])
    del keys
    group = np.empty(n + 1, np.int64)
    group[n] = 0  # behind the text: before everything
    sizes = np.diff(np.append(starts, n))
    group[order] = np.repeat(starts, sizes) + 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    reach = 8
    while len(slots):
        at = order[slots]
        pair = (group[at] << 32) | group[np.minimum(at + reach, n)]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        begin = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begin, len(at)))
        group[at] = np.repeat(slots[begin], sizes) + 1
        slots = slots[np.repeat(sizes > 1, sizes)]
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each suffix in order with the one before it.

    Kasai's walk in text order: from one position to the next a common prefix loses at most one byte.
    The text is walked in strips side by side, each a numpy lane of its own, eight bytes at a step.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int32)
    before = np.empty(n, np.int32)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    ahead = np.ndarray(n + 1, "<u8", padded, strides=(1,)).copy()
    strip = max(32, int(np.sqrt(n) / 16))
    lanes = np.arange(0, n, strip, dtype=np.int32)
    held = np.zeros(len(lanes), np.int32)
    by_position = np.zeros(n, np.int32)
    for step in range(strip):
        at = lanes + np.int32(step)
        if at[-1] >= n:
            lanes, at, held = lanes[:-1], at[:-1], held[:-1]
            if not len(lanes):
                break
        other = before[at]
        held[other < 0] = 0
        # what is left of the shorter of the two suffixes bounds the common prefix
        end = np.minimum(n - np.maximum(at, other), most)
        live = np.flatnonzero((other >= 0) & (held < end))
        while len(live):
            now = held[live]
            x = ahead[at[live] + now] ^ ahead[other[live] + now]
            same = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
            now = np.minimum(now + same, end[live])
            held[live] = now
            live = live[(same == 8) & (now < end[live])]
        by_position[at] = held
        np.maximum(held - 1, 0, out=held)
    return by_position[order]


def ordered_windows(text: np.ndarray, valid: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's distinct windows that start at a valid position, in order: their bytes, the least owner
    of the positions that start them, and every position's window number."""
    order = suffix_array(text)
    first = np.flatnonzero(common_prefixes(text, order, width) < width)
    if not len(order):
        return np.zeros(0, f"S{width + 1}"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.minimum.reduceat(np.where(valid, owner, _MOST)[order], first)
    begun = least < _MOST
    window = np.empty(len(text), np.int64)
    window[order] = np.repeat(np.cumsum(begun) - 1, np.diff(np.append(first, len(order))))
    return window_keys(text, order[first[begun]], width), least[begun], window


def window_keys(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The windows at some positions as fixed strings that sort by their bytes."""
    # a last byte of one keeps numpy from dropping zero bytes at a window's end
    keys = np.ones((len(at), width + 1), np.uint8)
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    keys[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    return keys.view(f"S{width + 1}").reshape(-1)


class MergedWindows:
    """The distinct windows of several shards in order, each with its least owner."""

    def __init__(self, keys: np.ndarray, least: np.ndarray) -> None:
        self.keys, self.least = keys, least

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows by binary search, and which of them are there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def add(self, keys: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Merge a shard's ordered windows in; returns the least owner of each so far."""
        at, there = self.find(keys)
        out = least.copy()
        out[there] = np.minimum(least[there], self.least[at[there]])
        self.least[at[there]] = out[there]
        self.keys = np.insert(self.keys, at[~there], keys[~there])
        self.least = np.insert(self.least, at[~there], least[~there])
        return out


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, merged: MergedWindows | None = None) -> list[np.ndarray]:
    """For every position of every shard (text, valid, owner), the least owner of its window over all
    shards and those already merged: each shard's array finds its windows by binary search.

    Shards in the order of their owners hear of those before them alone, as later ones have nothing older.
    """
    merged = merged or MergedWindows(np.zeros(0, f"S{width + 1}"), np.zeros(0, np.int64))
    tables, ordered, last = [], True, -1
    for text, valid, owner in shards:
        keys, own, window = ordered_windows(text, valid, owner, width)
        tables.append((keys, merged.add(keys, own), window))
        if len(own):
            ordered &= last <= own.min()
            last = max(last, own.max())
    if not ordered:
        tables = [(keys, merged.least[merged.find(keys)[0]], window) for keys, _, window in tables]
    return [least[window] if len(least) else np.full(len(window), _MOST) for _, least, window in tables]
