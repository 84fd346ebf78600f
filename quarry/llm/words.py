"""Vectorised word hashing over Arrow string buffers.

Every word-level operator of this subpackage reads its texts through this module: the concatenated
UTF-8 buffer of an Arrow column is cut into words and hashed with a handful of numpy passes, so no
Python loop ever touches a word.  A word is a maximal run of bytes other than space and \\x09-\\x0D,
after A-Z are lower-cased.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
LETTERS[128:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES, 1 << int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _R, np.uint64), np.full(size, _R_INV, np.uint64)
        up[0] = down[0] = 1
        table = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 8 * CHUNK_BYTES:
            return table  # an overlong text: not kept
        _POWERS[size] = table
    return _POWERS[size]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls have no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def row_chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row makes a range by itself."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, by one prefix sum over the buffer."""
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    values = (_FOLD[buf] if fold else buf).astype(np.uint64) + np.uint64(1)
    np.cumsum(values * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def byte_runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the rows' maximal runs of bytes in ``table``, and the rows' offsets."""
    inside = table[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[:-1] < off[1:]
        first[off[:-1][full]] = inside[off[:-1][full]]
        last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(buf, starts, ends), np.searchsorted(starts, off)


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end row, word hashes, and the rows' n + 1 offsets into them."""
    buf, off = text_buffer(column)
    for a, b in row_chunks(off):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        _, _, hashes, rows = byte_runs(part, at, WORD_BYTES)
        yield a, b, hashes, rows


def shingles(words: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words and the rows' offsets into them; a row of fewer
    words makes one shingle of all of them, a row without words none."""
    counts = np.diff(off)
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_off = np.concatenate([[0], np.cumsum(n_out)])
    weights = np.cumprod(np.full(size, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
    if len(words) >= size:
        runs = words[: len(words) - size + 1] * weights[0]
        for k in range(1, size):
            runs = runs + words[k : len(words) - size + 1 + k] * weights[k]
    else:
        runs = np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(counts)), n_out)
    src = off[:-1][row] + np.arange(len(row)) - out_off[:-1][row]
    out = np.zeros(len(row), np.uint64)
    whole = (counts >= size)[row]
    out[whole] = runs[src[whole]]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        out[out_off[r]] = (words[off[r] : off[r + 1]] * weights[: counts[r]]).sum(dtype=np.uint64) + np.uint64(counts[r])
    return mix(out), out_off


def distinct_by_row(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and made distinct."""
    parts = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
