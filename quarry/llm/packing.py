"""Packing: best-fit decreasing over windows of fixed length, exact for any number of documents.

Documents longer than a window are first cut into full windows.  What remains has fewer than
``window`` lengths, so best-fit decreasing runs over the histogram of lengths: a segment tree indexed
by remaining capacity gives the tightest open windows and all equal pieces that fit there are placed
at once, which is what placing them one by one would do.  The plan is a few thousand runs of equal
windows; documents find their places by their rank among the pieces of their length, counted per
block of input and shifted by a prefix sum over blocks.  No task sees more than its share of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.store import Store
from quarry.llm.tokens import encoder, with_end

WINDOW = 1024


class CapacityTree:
    """Segment tree over remaining capacities: the least capacity >= s that has open windows."""

    def __init__(self, window: int) -> None:
        self.size = 1 << (window + 1).bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): the pieces of a length with ranks in
    the run lie at the offset in consecutive sequences.  counts: pieces by length, 1 to ``window``."""
    tree = CapacityTree(window)
    #: capacity -> groups of equal windows: [windows, [(length, first rank, offset)]]
    groups: dict[int, list[list]] = {}

    def put(capacity: int, group: list) -> None:
        groups.setdefault(capacity, []).append(group)
        tree.set(capacity, True)

    def take(capacity: int, most: int) -> list:
        found = groups[capacity]
        group = found.pop()
        if group[0] > most:
            found.append([group[0] - most, [(n, r + most, o) for n, r, o in group[1]]])
            group = [most, group[1]]
        if not found:
            tree.set(capacity, False)
        return group

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            fits = (window if capacity is None else capacity) // length
            if capacity is None:
                capacity = window
                put(window, [max(1, left // fits), []])
            each = fits if left >= fits else left
            group = take(capacity, max(1, left // fits))
            q = group[0]
            slots = [(length, rank + j * q, window - capacity + j * length) for j in range(each)]
            put(capacity - each * length, [q, group[1] + slots])
            rank, left = rank + each * q, left - each * q
    runs, sequence = [], 0
    for capacity in sorted(groups):
        for q, slots in groups[capacity]:
            runs += [(length, r, q, sequence, o) for length, r, o in slots]
            sequence += q
    return sorted(runs)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", store: Store | None = None) -> DataFrame:
    """Pieces of all documents, written: id, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian
    unsigned 32-bit), ``block`` of input and ``nth`` piece of its length there.

    Full windows come first, then the rest of a document.  Null and empty texts have the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        met = np.zeros(window + 1, np.int64)
        for batch in batches:
            for a, b, ids, off in encoder(tokenizer).rows(batch.column(1)):
                ids, off = with_end(ids, off, end_id)
                sizes = np.diff(off)
                n = -(-sizes // window)
                row = np.repeat(np.arange(b - a), n)
                nth_of_doc = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = nth_of_doc * window
                length = np.minimum(sizes[row] - start, window)
                order = np.argsort(length, kind="stable")
                runs = np.bincount(length, minlength=window + 1)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(met, runs)
                met += runs
                bounds = np.append(off[row] + start, off[-1]) * 4
                blobs = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sizes[row]), blobs.cast(pa.binary()), pa.array(np.full(len(row), block, np.int64)), pa.array(nth)],
                    ["doc_id", "start", "length", "doc_tokens", "ids", "block", "nth"],
                )

    store = store or Store(docs.sparkSession, "packing")
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary, block long, nth long")
    return store.put(pieces.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else pieces, "pieces")


def plan_places(pieces: DataFrame, store: Store, window: int = WINDOW) -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """The rank at which each block's pieces of a length begin, and the runs of the plan.
    The driver sees one count per length, never more than ``window``."""
    per_block = store.put(pieces.groupBy("length", "block").count(), "counts")
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = store.put(per_block.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "bases")
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    return bases, best_fit_decreasing(counts, window)


def place(pieces: DataFrame, plan: tuple[DataFrame, list[tuple[int, int, int, int, int]]]) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    bases, runs = plan
    ranked = pieces.join(bases, ["length", "block"]).withColumn("rank", F.col("base") + F.col("nth"))
    table = np.array(runs, np.int64).reshape(-1, 5)
    lengths = np.unique(table[:, 0])
    first_run = np.searchsorted(table[:, 0], lengths)
    wide = pieces.sparkSession.sparkContext.broadcast((table, lengths, first_run))
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _, _ = wide.value
        keys = (table[:, 0].astype(object) * (1 << 50) + table[:, 1]).astype(np.int64)
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            run = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            found = table[run] if len(table) else np.zeros((0, 5), np.int64)
            yield pa.record_batch([*batch.columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*batch.schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*ranked.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(look_up, schema).drop("block", "nth", "base", "rank")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset.

    Every id lies in exactly one piece; a sequence holds at most ``window`` ids and its pieces follow
    each other without gaps from 0.  Null and empty texts are packed as their end id; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    store = Store(docs.sparkSession, "packing")
    pieces = cut_pieces(docs, tokenizer, end_id, window, id_col, text_col, store)
    return place(pieces, plan_places(pieces, store, window))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_tokens``, ``ids`` padded to ``window`` unless their
    number is a power of two.  A group never holds more than a window."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"), F.sum("length").alias("n_tokens"))
    text = F.array_join(F.transform("parts", lambda p: p["ids"]), "")
    pad = F.format_string("%02X%02X%02X%02X", *(F.lit(pad_id >> (8 * i) & 255) for i in range(4)))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return joined.select("sequence_id", "n_tokens", F.unhex(F.when(power, text).otherwise(F.concat(text, F.repeat(pad, (F.lit(window) - F.col("n_tokens")).cast("int"))))).alias("ids"))
