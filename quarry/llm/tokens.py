"""Whole-text token ids from the tokenizers library, one library call per distinct piece of text.

Texts are cut where the tokenizer's own splitter is certain to cut, distinct pieces are encoded once
and kept by hash, and the ids of a text are gathered with numpy.  The places are chosen so that the
ids equal those of encoding the whole text: before white space that follows a visible character, after
a lone line break or tab, and between an ASCII letter and ASCII punctuation (never after an
apostrophe).  A text that may hold an added token's string, in whatever case, is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from quarry.llm.cache import held
from quarry.llm.words import row_chunks, span_hashes, text_buffer

_CHUNK = 2 << 20
_MOST_KEYS, _MOST_IDS = 1_200_000, 8_000_000
#: What a byte is: white space, lone-cut white space, visible ASCII, ASCII letter, ASCII punctuation,
#: first byte of a two-byte character from U+00C0 on (never white space), later byte of a character.
_WHITE, _BREAK, _VISIBLE, _LETTER, _PUNCT, _TWO, _LATER = (1 << i for i in range(7))


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[9, 10, 11, 12, 13]] = _WHITE | _BREAK
    kinds[32] = _WHITE
    kinds[33:127] = _VISIBLE | _PUNCT
    kinds[48:58] = _VISIBLE
    kinds[65:91] = kinds[97:123] = _VISIBLE | _LETTER
    kinds[0x80:0xC0] = _LATER
    kinds[0xC3:0xE0] = _TWO
    return kinds


_KINDS = _kinds()


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of pieces: every row's first byte and every certain cut within rows."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n:
        kind = _KINDS[buf]
        seen = (kind & _VISIBLE) > 0  # the last byte of a character that is certainly not white
        seen[1:] |= ((kind[:-1] & _TWO) > 0) & ((kind[1:] & _LATER) > 0)
        cut[1:n] = ((kind[1:] & _WHITE) > 0) & seen[:-1]
        cut[1:n] |= ((kind[:-1] & _LETTER) > 0) & ((kind[1:] & _PUNCT) > 0)
        cut[2:n] |= ((kind[1:-1] & _BREAK) > 0) & ((kind[2:] & (_VISIBLE | _TWO)) > 0) & seen[:-2]
    cut[off] = False
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class TokenEncoder:
    """Ids of text columns; lives in a worker and keeps what it has encoded."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.added = [x["content"].encode().lower() for x in settings["added_tokens"]]
        # a tokenizer that lower-cases and drops white space: pieces that differ in these alone are one
        lowers = '"Lowercase"' in json.dumps(settings.get("normalizer"))
        self.folds = lowers and len({tuple(x) for x in self._library(["ab", " ab", "\nAB"])}) == 1
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.spots = np.zeros((0, 2), np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used) + 1024, np.uint32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        spots = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], 1)
        self.used += total
        return spots

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spots(self, keys: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pool places of distinct pieces given by sorted hashes."""
        if len(self.keys) > _MOST_KEYS or self.used > _MOST_IDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        safe = np.minimum(at, max(len(self.keys) - 1, 0))
        seen = self.keys[safe] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), 2), np.int64)
        out[seen] = self.spots[safe[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            made = self._store(self._library([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
            out[new] = made
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.spots = np.insert(self.spots, at[new], made, axis=0)
        return out

    def _whole(self, data: bytes, off: np.ndarray) -> np.ndarray:
        """Which rows hold the string of an added token."""
        out = np.zeros(len(off) - 1, bool)
        lower = data.lower()
        for token in self.added:
            at = lower.find(token)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                out[row] |= at + len(token) <= off[row + 1]
                at = lower.find(token, at + 1)
        return out

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: first row, end row, all their ids, and the rows' n + 1 offsets."""
        buf, off = text_buffer(column)
        for a, b in row_chunks(off, _CHUNK):
            part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            starts, data = piece_starts(part, at), part.tobytes()
            whole = self._whole(data, at)
            special = np.zeros(len(starts), bool)
            if whole.any():
                row = np.searchsorted(at, starts, "right") - 1
                keep = ~whole[row] | (starts == at[row])
                starts, special = starts[keep], whole[row[keep]]
            begins = starts
            ends = np.append(starts[1:], len(part)) if len(starts) else starts
            if self.folds and len(starts):
                starts = starts + ((_KINDS[part[starts]] & _WHITE) > 0)
            plain = np.flatnonzero(~special)
            hashes = span_hashes(part, starts[plain], ends[plain], fold=self.folds)
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            spots = np.empty((len(starts), 2), np.int64)
            spots[plain] = self._spots(unique, data, starts[plain][first], ends[plain][first])[inverse]
            if len(plain) < len(starts):
                spots[special] = self._store(self._library([data[x:y].decode() for x, y in zip(begins[special].tolist(), ends[special].tolist(), strict=True)]))
            ends_at = np.cumsum(spots[:, 1])
            total = int(ends_at[-1]) if len(ends_at) else 0
            ids = self.pool[np.repeat(spots[:, 0] - (ends_at - spots[:, 1]), spots[:, 1]) + np.arange(total)]
            yield a, b, ids, np.concatenate([[0], ends_at])[np.searchsorted(begins, at)]


def encoder(path: str) -> TokenEncoder:
    """The worker's encoder of a tokenizer file."""
    return held(path, lambda: TokenEncoder(path))


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids with an end id appended to each."""
    n = len(off) - 1
    out_off = off + np.arange(n + 1)
    out = np.empty(len(ids) + n, np.uint32)
    out[out_off[1:] - 1] = end_id
    keep = np.ones(len(out), bool)
    keep[out_off[1:] - 1] = False
    out[keep] = ids
    return out, out_off
