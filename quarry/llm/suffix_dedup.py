"""Suffix-array dedup: bytes of 50-byte strings that also start in a document of a smaller id.

A window of ``WIDTH`` bytes is known by its least ``GRAM``-byte hash, so that equal windows meet in one
place, and neighbouring windows of one least hash make one string of at most ``WIDTH + STRIDE - 1`` bytes.
Hashes only choose what is compared and where; every decision is taken on bytes.

1. Shards of texts name the least hashes of their windows.  Those that occur in two documents or more are
   asked for again (``asked``), the others hold nothing that repeats.
2. Shards send the distinct strings around them, each once and with its least document, to content shards.
3. A content shard collapses equal strings, builds suffix arrays over them in the order of their documents,
   takes Kasai's common prefixes, and merges its arrays by binary search: every window hears of the least
   document that it starts in.  A hash of more than ``SPLIT`` strings is dealt over several content
   shards by where its strings come from, whose ordered windows are merged before they answer.
4. Shards of texts turn the answers into spans.  A string that a shard holds in several documents is
   kept by the smallest alone, so a passage of any number of documents is sent once per shard.

Every exchange has rows by the count of hashes or strings, which grow with the input and no faster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.store import Store
from quarry.llm.suffix import MergedWindows, merge_shards
from quarry.llm.words import _powers, mix, row_chunks, text_buffer

WIDTH, GRAM = 50, 20
#: Windows of one sent string at most; strings are at most WIDTH + STRIDE - 1 bytes.
STRIDE = 32
#: Bytes of text in a shard (a content shard has about twice that of strings); bytes of one suffix array.
SHARD_BYTES, ARRAY_BYTES = 2 << 20, 1 << 20
#: Strings of one hash, summed over the shards of texts, that a content shard takes.
SPLIT = 1 << 16
_CHUNK = 1 << 20
_MOST = np.iinfo(np.int64).max


def _pieces(off: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Row ranges as lists of (row, first byte, end byte) of about a chunk; long rows are cut into
    pieces that overlap by a window less one byte."""
    held, size = [], 0
    for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        while b - a >= WIDTH:
            to = min(b, a + _CHUNK)
            held.append((row, a, to))
            size += to - a
            if size >= _CHUNK:
                yield held
                held, size = [], 0
            if to == b:
                break
            a = to - WIDTH + 1
    if held:
        yield held


def runs_of_windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one least hash: row, first byte in the buffer, windows, that
    hash, and a hash of the run's bytes."""
    out: list[tuple[np.ndarray, ...]] = []
    for pieces in _pieces(off):
        row, begin, end = (np.array(x) for x in zip(*pieces, strict=True))
        size = end - begin
        at = np.concatenate([[0], np.cumsum(size)])
        text = np.concatenate([buf[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        n = len(text)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        least = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n + 1 - GRAM])
        span, need = 1, WIDTH - GRAM + 1
        while span < need:
            step = min(span, need - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        # least[i]: of the window that starts at i; windows must end in their piece
        last = at[1:] - WIDTH
        fresh = np.ones(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        fresh[at[:-1]] = True
        valid = np.zeros(len(least) + 1, np.int32)
        valid[at[:-1]] += 1
        np.subtract.at(valid, last + 1, 1)
        valid = np.cumsum(valid[:-1]) > 0
        after = last + 1
        fresh[after[after < len(least)]] = True
        start = np.flatnonzero(fresh)
        count = np.diff(np.append(start, len(least)))
        kept = valid[start]
        start, count = start[kept], count[kept]
        parts = -(-count // STRIDE)
        base = np.repeat(start, parts)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - nth * STRIDE, STRIDE)
        start = base + nth * STRIDE
        piece = np.searchsorted(at, start, "right") - 1
        own = mix((sums[start + count + WIDTH - 1] - sums[start]) * down[start] + count.astype(np.uint64))
        # minima crowd near zero: mixed once more, they fall evenly into buckets
        out.append((row[piece], start - at[piece] + begin[piece], count, mix(least[start] ^ np.uint64(0x5B)), own))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Shard:
    """The runs of a shard's texts and the distinct ones among them."""

    def __init__(self, table: pa.Table) -> None:
        column = table.column("text").combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_MOST).to_numpy()
        self.buf, self.off = text_buffer(column)
        self.row, self.start, self.count, self.least, self.own = runs_of_windows(self.buf, self.off)
        have = self.known[self.row]
        if not have.all():
            self.row, self.start, self.count, self.least, self.own = (x[have] for x in (self.row, self.start, self.count, self.least, self.own))
        self.doc = self.ids[self.row]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One run of each string, that string's least document, and every run's string number.

        Numbers follow hashes, whatever the order of rows; strings are told apart by their bytes."""
        _, first, inverse = np.unique(self.own, return_index=True, return_inverse=True)
        like = first[inverse]
        twin = np.flatnonzero(like != np.arange(len(self.own)))
        same = self.count[twin] == self.count[like[twin]]
        same[same] = self._equal(twin[same], like[twin[same]])
        if not same.all():  # strings of one hash: all of them are named anew, by their bytes
            for i in np.flatnonzero(np.isin(self.own, self.own[twin[~same]])).tolist():
                text = self.buf[self.start[i] : self.start[i] + self.count[i] + WIDTH - 1].tobytes()
                self.own[i] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
            return self.distinct()
        smallest = np.full(len(first), _MOST)
        np.minimum.at(smallest, inverse, self.doc)
        return first, smallest, inverse

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether runs of equal sizes have equal bytes."""
        out = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 15):
            x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            n = self.count[x] + WIDTH - 1
            ends = np.cumsum(n)
            inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            differ = self.buf[np.repeat(self.start[x], n) + inner] != self.buf[np.repeat(self.start[y], n) + inner]
            out[at : at + len(x)] = np.add.reduceat(differ, ends - n) == 0
        return out

    def flat(self, runs: np.ndarray) -> pa.Array:
        """The bytes of runs as a binary column."""
        n = self.count[runs] + WIDTH - 1
        off = np.concatenate([[0], np.cumsum(n)])
        flat = self.buf[np.repeat(self.start[runs] - off[:-1], n) + np.arange(int(off[-1]))]
        return pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


_ALL = (1 << 32) - 1


class _Content:
    """The strings of a content shard: rows as they were sent, distinct strings, and their windows."""

    def __init__(self, table: pa.Table, array_bytes: int) -> None:
        coded = table.column("bytes").combine_chunks().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.buf, self.off = text_buffer(coded.dictionary)
        self.doc = table.column("doc").to_numpy()
        self.owner = np.full(len(self.off) - 1, _MOST)
        np.minimum.at(self.owner, self.code, self.doc)
        order = np.argsort(self.owner, kind="stable")
        size = np.diff(self.off)
        array = np.cumsum(size[order]) // array_bytes
        cuts = np.concatenate([[0], np.flatnonzero(array[1:] != array[:-1]) + 1, [len(order)]]) if len(order) else [0]
        self.places, self.shards = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            which = order[a:b]
            n = size[which]
            ends = np.cumsum(n)
            inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            text = self.buf[np.repeat(self.off[:-1][which], n) + inner]
            starts = inner <= np.repeat(n, n) - WIDTH
            self.shards.append((text, starts, np.repeat(self.owner[which], n)))
            self.places.append((np.repeat(which, n)[starts], inner[starts], starts))

    def windows(self) -> MergedWindows:
        """All distinct windows and their least documents here."""
        merged = MergedWindows(np.zeros(0, f"S{WIDTH + 1}"), np.zeros(0, np.int64))
        merge_shards(self.shards, WIDTH, merged)
        return merged

    def answers(self, merged: MergedWindows | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that lose something, and which of their windows, as bits."""
        masks = np.zeros(len(self.owner), np.int64)
        for oldest, (which, inner, starts) in zip(merge_shards(self.shards, WIDTH, merged), self.places, strict=True):
            older = oldest[starts] < self.owner[which]
            np.bitwise_or.at(masks, which[older], np.int64(1) << inner[older])
        found = np.where(self.doc > self.owner[self.code], _ALL, masks[self.code])
        rows = np.flatnonzero(found)
        return rows, found[rows]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def duplicate_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, array_bytes: int = ARRAY_BYTES, split: int = SPLIT) -> DataFrame:
    """Bytes of each text that a 50-byte string covers which also starts in a document of a smaller id.

    Returns one row per input row: the id, ``n_bytes``, ``spans`` (maximal removed runs, start and end
    in bytes) and ``kept`` (the remaining bytes).  Strings are judged on the input.  Null texts are empty;
    texts under 50 bytes keep everything; rows of one id count as one document; a row without id loses
    nothing and takes nothing; texts of any length are whole; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    store = Store(spark, "suffix")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    buckets = max(1, math.ceil(total / (2 * shard_bytes)))
    # the row number only deals rows out, so that no id, copy or null makes a shard large
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least hashes of the shards that rows belong to: a document, the number of strings, and whether
        there are two documents."""
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for a, b in row_chunks(off, shard_bytes):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                shard, of = _Shard(part), part.column("shard").to_numpy()
                of = of[shard.row]
                order = np.lexsort((shard.least, of))
                hashes, of, doc = shard.least[order], of[order], shard.doc[order]
                name = mix(shard.own[order] + of.astype(np.uint64))
                if not len(hashes):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]))
                low = np.minimum.reduceat(doc, begin)
                several = low != np.maximum.reduceat(doc, begin)
                distinct = np.zeros(len(name), np.int32)
                distinct[np.unique(name, return_index=True)[1]] = 1
                strings = np.maximum(np.add.reduceat(distinct, begin), 1).astype(np.int32)
                yield pa.record_batch([pa.array(of[begin], pa.int32()), pa.array(hashes[begin].view(np.int64)), pa.array(low), pa.array(np.where(several, -strings, strings))], ["shard", "hash", "low", "strings"])

    hashes = dealt.mapInArrow(send_hashes, "shard int, hash long, low long, strings int")
    alike = W.partitionBy("hash")
    of_hash = hashes.select("shard", "hash", F.min("low").over(alike).alias("low"), F.max("low").over(alike).alias("high"), F.min("strings").over(alike).alias("least"), F.sum(F.abs("strings")).over(alike).alias("all"))
    asked = store.put(of_hash.where("least < 0 OR low <> high").select("shard", "hash", F.ceil(F.col("all") / F.lit(split)).cast("int").alias("parts")), "asked")

    def send_strings(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "nth": pa.array([], pa.int32()), "doc": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary())})
        shard, number = _Shard(texts), texts.column("shard")[0].as_py()
        wanted = answers.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(wanted)
        wanted, parts = wanted[order], answers.column("parts").to_numpy()[order]
        first, smallest, _ = shard.distinct()
        at = np.minimum(np.searchsorted(wanted, shard.least[first]), len(wanted) - 1)
        nth = np.flatnonzero(wanted[at] == shard.least[first])
        first, parts = first[nth], parts[at[nth]]
        bucket = np.where(parts > 1, shard.least[first].view(np.int64), _bucket(shard.least[first], buckets))
        part = np.where(parts > 1, 1 + number % parts, 0)
        return pa.table({"bucket": pa.array(bucket), "part": pa.array(part.astype(np.int32)), "shard": pa.array(np.full(len(nth), number, np.int32)), "nth": pa.array(nth.astype(np.int32)), "doc": pa.array(smallest[nth]), "bytes": shard.flat(first)})

    def strings_of(asked: DataFrame) -> DataFrame:
        return dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(send_strings, "bucket long, part int, shard int, nth int, doc long, bytes binary")

    def answered(table: pa.Table, rows: np.ndarray, masks: np.ndarray) -> pa.Table:
        some = pa.array(rows)
        return pa.table({"shard": table.column("shard").take(some), "nth": table.column("nth").take(some), "mask": pa.array(masks, pa.int64())})

    def compare(table: pa.Table) -> pa.Table:
        return answered(table, *_Content(table, array_bytes).answers())

    def list_windows(table: pa.Table) -> pa.Table:
        """The ordered windows of one part of a split hash."""
        merged = _Content(table, array_bytes).windows()
        n = len(merged.keys)
        return pa.table({"bucket": pa.array(np.full(n, table.column("bucket")[0].as_py(), np.int64)), "part": pa.array(np.full(n, table.column("part")[0].as_py(), np.int32)), "window": pa.array(merged.keys.tolist(), pa.binary()), "low": pa.array(merged.least)})

    def compare_part(table: pa.Table, others: pa.Table) -> pa.Table:
        """A part's answers after the windows that other parts hold in smaller documents are merged in."""
        if not table.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "nth": pa.array([], pa.int32()), "mask": pa.array([], pa.int64())})
        keys, least = np.array(others.column("window").to_pylist(), f"S{WIDTH + 1}"), others.column("oldest").to_numpy()
        order = np.argsort(keys)
        return answered(table, *_Content(table, array_bytes).answers(MergedWindows(keys[order], least[order])))

    kind = "shard int, nth int, mask long"
    older = strings_of(asked.where("parts = 1")).groupBy("bucket", "part").applyInArrow(compare, kind)
    if not asked.where("parts > 1").isEmpty():
        halves = store.put(strings_of(asked.where("parts > 1")), "split")
        windows = halves.groupBy("bucket", "part").applyInArrow(list_windows, "bucket long, part int, window binary, low long")
        oldest = windows.withColumn("oldest", F.min("low").over(W.partitionBy("bucket", "window"))).where("oldest < low").select("bucket", "part", "window", "oldest")
        older = older.unionByName(halves.groupBy("bucket", "part").cogroup(oldest.groupBy("bucket", "part")).applyInArrow(compare_part, kind))

    def cut_spans(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int64())), "ends": pa.array([], pa.list_(pa.int64())), "kept": pa.array([], pa.binary())})
        shard = _Shard(texts)
        n = len(shard.buf)
        cover = np.zeros(n + 1, np.int32)
        if len(shard.own):
            first, smallest, inverse = shard.distinct()
            mask = np.zeros(len(first), np.int64)
            if answers.num_rows:
                mask[answers.column("nth").to_numpy()] = answers.column("mask").to_numpy()
            mask = np.where(shard.doc > smallest[inverse], _ALL, mask[inverse])
            whole = mask == _ALL
            np.add.at(cover, shard.start[whole], 1)
            np.subtract.at(cover, shard.start[whole] + shard.count[whole] + WIDTH - 1, 1)
            rest = np.flatnonzero((mask > 0) & ~whole)
            bits = np.unpackbits(mask[rest].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            which, window = np.nonzero(bits)
            np.add.at(cover, shard.start[rest][which] + window, 1)
            np.subtract.at(cover, shard.start[rest][which] + window + WIDTH, 1)
        gone = np.cumsum(cover[:-1]) > 0
        first, last = gone.copy(), gone.copy()
        if n:
            first[1:] &= ~gone[:-1]
            last[:-1] &= ~gone[1:]
            full = shard.off[:-1] < shard.off[1:]
            first[shard.off[:-1][full]] = gone[shard.off[:-1][full]]
            last[shard.off[1:][full] - 1] = gone[shard.off[1:][full] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        rows = np.searchsorted(starts, shard.off).astype(np.int32)
        owner = np.repeat(np.arange(len(shard.off) - 1), np.diff(rows))
        left = np.concatenate([[0], np.cumsum(~gone)])[shard.off]
        kept = pa.Array.from_buffers(pa.large_binary(), len(shard.off) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(shard.buf[~gone]))]).cast(pa.binary())
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_bytes": np.diff(shard.off),
                "starts": pa.ListArray.from_arrays(rows, starts - shard.off[owner]),
                "ends": pa.ListArray.from_arrays(rows, ends - shard.off[owner]),
                "kept": kept,
            }
        )

    found = dealt.groupBy("shard").cogroup(older.groupBy("shard")).applyInArrow(cut_spans, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    return found.select(F.col("doc_id").alias(id_col), "n_bytes", spans.alias("spans"), "kept")
