"""Token-id files: Simple-8b word-aligned coding with per-block offsets.

A 64-bit word holds a selector in its high four bits and, below it, as many ids of one width as fit:
2 x 30 up to 60 x 1 bits, or a run of 120 or 240 zeros.  Selector 15 is an escape: the next word is one
id of any 64-bit value.  Ids are coded in miniblocks of 240 that begin on words of their own; their word
offsets let a reader decode any miniblock, and all words of a selector decode in one numpy step.

A block is self-contained: header, document ids, their token counts, miniblock offsets, words.  A file
is a Parquet table of blocks in ascending id order, so any store that Spark reaches can hold it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.store import Store
from quarry.llm.tokens import encoder, with_end

MAGIC = b"QS8B"
MINIBLOCK = 240
#: Ids per word and bits per id, by selector; 0 bits: zeros only.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
_ESCAPE = 15
#: Ids after which a block ends, with the document that reaches it.
BLOCK_IDS = 1 << 18


def _table_of_bits() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for b in range(16):
        table[1 << b :] = b + 1
    return table


_BITS16 = _table_of_bits()


def _bits(values: np.ndarray) -> np.ndarray:
    """Significant bits of unsigned 64-bit values, exactly."""
    if not len(values) or values.max() < 1 << 16:
        return _BITS16[values]
    out = np.zeros(len(values), np.uint8)
    for shift in (0, 16, 32, 48):
        part = (values >> np.uint64(shift)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _BITS16[part] + np.uint8(shift), out)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned values and the miniblocks' word offsets.

    All miniblocks advance in step: in each step every miniblock takes the selector that packs the most
    of its next ids.
    """
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    minis = -(-n // MINIBLOCK)
    size = np.full(minis, MINIBLOCK)
    size[-1] = n - (minis - 1) * MINIBLOCK
    padded = np.zeros(minis * MINIBLOCK, np.uint64)
    padded[:n] = values
    bits = _bits(padded).reshape(minis, MINIBLOCK)
    # choice[i]: the selector at id i; widest: the most bits of the ids from i on that it would take,
    # by doubling windows; ids past the end count as too wide
    bits.reshape(-1)[n:] = 255
    choice = np.full((minis, MINIBLOCK), _ESCAPE, np.uint8)
    widest, run = bits, 1
    for s in range(_ESCAPE - 1, -1, -1):
        k = int(COUNTS[s])
        while run < k:
            step = min(run, k - run)
            widest = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            run += step
        np.copyto(choice[:, : MINIBLOCK - k + 1], np.uint8(s), where=widest <= WIDTHS[s])
    at = np.zeros(minis, np.int64)
    live = np.arange(minis)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        chosen = choice[live, at[live]].astype(np.int64)
        steps.append((live, at[live], chosen))
        at[live] += COUNTS[chosen]
        live = live[at[live] < size[live]]
    mini, begin, chosen = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(mini * MINIBLOCK + begin, kind="stable")
    mini, begin, chosen = mini[order], begin[order], chosen[order]
    used = np.where(chosen == _ESCAPE, 2, 1)
    spot = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), np.uint64)
    source = mini * MINIBLOCK + begin
    for s in range(len(COUNTS)):
        own = np.flatnonzero(chosen == s)
        if not len(own):
            continue
        if s == _ESCAPE:
            words[spot[own] + 1] = padded[source[own]]
        elif WIDTHS[s]:
            for j in range(COUNTS[s]):
                words[spot[own]] |= padded[source[own] + j] << np.uint64(j * WIDTHS[s])
        words[spot[own]] |= np.uint64(s << 60)
    offsets = np.append(spot[np.searchsorted(mini, np.arange(minis))], len(words))
    return words, offsets


def decode(words: np.ndarray) -> np.ndarray:
    """The values of whole miniblocks' words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(selector == _ESCAPE)
    if len(escapes):
        # a raw word may look like an escape itself: walk the runs of consecutive suspects
        last = -1
        for i in escapes.tolist():
            if i > last:
                raw[i + 1] = True
                last = i + 1
    coded = np.flatnonzero(~raw)
    selector = selector[coded]
    n = COUNTS[selector]
    spot = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint64)
    for s in range(len(COUNTS)):
        own = np.flatnonzero(selector == s)
        if not len(own) or not WIDTHS[s]:
            continue
        if s == _ESCAPE:
            out[spot[own]] = words[coded[own] + 1]
            continue
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
        out[spot[own][:, None] + np.arange(COUNTS[s])] = (words[coded[own]][:, None] >> shifts) & np.uint64((1 << WIDTHS[s]) - 1)
    return out


def block_bytes(doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: documents and their ids."""
    words, offsets = encode(ids)
    head = MAGIC + struct.pack("<IQQQ", len(doc_ids), len(ids), len(offsets), len(words))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), np.packbits(valid).tobytes(), counts.astype("<i8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def read_block(data: memoryview | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are valid, token counts and all ids of a block."""
    assert bytes(data[:4]) == MAGIC, "not a block of token ids"
    docs, n, minis, n_words = struct.unpack_from("<IQQQ", data, 4)
    at = 32
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    valid = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
    at += -(-docs // 8)
    counts = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs + 4 * minis
    ids = decode(np.frombuffer(data, "<u8", n_words, at))
    assert len(ids) == n, "a block's words do not match its header"
    return doc_ids, valid, counts, ids


def read_ids(data: memoryview | bytes, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a block, decoding only the miniblocks that hold them."""
    docs, total, minis, n_words = struct.unpack_from("<IQQQ", data, 4)
    at = 32 + 16 * docs + -(-docs // 8)
    offsets = np.frombuffer(data, "<u4", minis, at)
    n = max(0, min(n, total - first))
    a, b = first // MINIBLOCK, min(minis - 1, -(-(first + n) // MINIBLOCK))
    words = np.frombuffer(data, "<u8", n_words, at + 4 * minis)[offsets[a] : offsets[b]]
    return decode(words)[first - a * MINIBLOCK :][:n]


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append the end id, and write blocks in ascending id order.

    Null and empty texts have the end id alone; rows with equal ids stand by the hash of their texts;
    null ids come first; texts of any length stay whole, in one block; an empty table makes an empty
    file.
    """

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, base = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal number, base
            doc_ids, valid, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            out = pa.record_batch([pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([base], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([block_bytes(doc_ids, valid, counts, ids)], pa.binary())], ["shard", "number", "base", "n_ids", "data"])
            number, base = number + 1, base + len(ids)
            return out

        for batch in batches:
            for a, b, ids, off in encoder(tokenizer).rows(batch.column(1)):
                ids, off = with_end(ids, off, end_id)
                own = batch.column(0).slice(a, b - a)
                doc_ids, valid = own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)
                at = 0
                while at < b - a:
                    room = BLOCK_IDS - sum(len(x[3]) for x in held)
                    to = max(at + 1, int(np.searchsorted(off, off[at] + room, "right")) - 1)
                    held.append((doc_ids[at:to], valid[at:to], np.diff(off[at : to + 1]), ids[off[at] : off[to]]))
                    at = to
                    if at < b - a:
                        yield block()
                if held and sum(len(x[3]) for x in held) >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows of one id, or without any, spread by their texts, and equal ones by their place
    order = [F.asc_nulls_first("doc_id"), F.col("_text"), F.col("_row")]
    placed = keyed.withColumn("_text", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(encode_rows, "shard long, number long, base long, n_ids long, data binary").write.parquet(path)


def read_token_file(docs_path: str, spark, with_ids: bool = True) -> DataFrame:
    """Documents of a token-id file: ``doc_id``, ``start`` (ids before it in the file), ``n_tokens``,
    ``ids_crc32`` over little-endian 32-bit ids and, if asked for, ``ids``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before, data in zip(batch.column("base").to_pylist(), batch.column("before").to_pylist(), batch.column("data"), strict=True):
                doc_ids, valid, counts, ids = read_block(memoryview(data.as_buffer()))
                ends = np.cumsum(counts)
                flat = memoryview(ids.astype("<u4")).cast("B")
                checks = np.fromiter((zlib.crc32(flat[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)), np.int64, len(counts))
                columns = [pa.array(doc_ids, mask=~valid), pa.array(before + base + ends - counts), pa.array(counts), pa.array(checks)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    blocks = spark.read.schema("shard long, number long, base long, n_ids long, data binary").parquet(docs_path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(before), "shard").select("base", "before", "data")  # one row per file part
    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2, store: Store | None = None, with_ids: bool = False) -> DataFrame:
    """Write a token-id file to the shared folder and read it back."""
    store = store or Store(docs.sparkSession, "tokens")
    path = store.path("ids")
    write_token_file(docs, path, tokenizer, end_id)
    return read_token_file(path, docs.sparkSession, with_ids)
