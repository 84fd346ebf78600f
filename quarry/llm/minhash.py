"""MinHash near-duplicate detection: fast similarity sketching, banding, exact verification.

Sketch: in round i every element falls into one hashed bin with value (i, hash); from round t on,
round t + j sends every element to bin j.  A bin keeps its smallest value and a set stops as soon as
all bins are full, so every coordinate fills and a large set costs little more than one pass.

Groups of any size stay bounded.  Documents of one shingle set collapse to their smallest id before
anything is paired.  Two sets are a candidate pair if they share a band.  Every set is first verified
against its anchor, the smallest set that it shares a band with; the links found so settle most bands, in
which all sets are connected.  In the others, sets of different parts are compared only if they share one
of the rare shingles that no link can do without (prefix filter) and enough shingles follow it in both
(position filter); both filters are exact.  No bucket or partner count is capped, and every candidate
pair that may be a link and is not yet connected is verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.store import Store
from quarry.llm.words import distinct_by_row, hashed_words, mix, row_chunks, shingles

COORDINATES = 128
BANDS, ROWS = 32, 4
SHINGLE = 5
PERCENT = 75
#: Shingles of the sets that meet one copy of their anchor, about.
BLOCK = 150_000
#: Rows of a shared shingle that are compared in one place; shares that a set's pairs are confirmed in.
SHARE, SHARES = 1_000, 64
#: Comparisons a row beyond which sets are first connected through central ones.
PAIRS = 16

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64((1 << 56) - 1)


def sketch(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fast similarity sketches, one row of ``COORDINATES`` values per set; empty sets give zeros."""
    t, n = COORDINATES, len(off) - 1
    sizes = np.diff(off)
    out = np.full((n, t), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n), sizes)
    live = np.flatnonzero(sizes > 0)
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(values ^ _SEEDS[i])
        v = (h & _LOW) | np.uint64(i << 56)
        if i < t:
            np.minimum.at(flat, row * t + (h >> np.uint64(57)).astype(np.int64), v)
        else:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            least = np.minimum.reduceat(v, starts)
            out[row[starts], i - t] = np.minimum(out[row[starts], i - t], least)
        full = (out[live] != np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
        if full.any():
            live = live[~full]
            on = np.zeros(n, bool)
            on[live] = True
            stay = on[row]
            values, row = values[stay], row[stay]
    out[sizes == 0] = 0
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
    return keys.view(np.int64)


def _sets(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, words, off in hashed_words(text):
        yield distinct_by_row(*shingles(words, off, SHINGLE))


def _set_hashes(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: sums of two independent hashes of its elements."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(s)))]) for s in (0x51, 0xA7)]
    return tuple((s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums)


_SIGNED = "id long, row_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for values, off in _sets(batch.column(1)):
            n = len(off) - 1
            h1, h2 = _set_hashes(values, off)
            keys = band_keys(sketch(values, off))
            yield pa.record_batch(
                [batch.column(0).slice(at, n), pa.array(np.diff(off)), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.reshape(-1)))],
                ["id", "n_shingles", "h1", "h2", "bands"],
            )
            at += n


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets that share a band, as little-endian 64-bit values."""
    for batch in batches:
        at = 0
        for values, off in _sets(batch.column(batch.schema.get_field_index("text"))):
            n = len(off) - 1
            h1, h2 = _set_hashes(values, off)
            blobs = pa.array([values[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            part = batch.slice(at, n)
            same = pa.array((h1 == part.column("h1").to_numpy()) & (h2 == part.column("h2").to_numpy()))
            yield pa.record_batch([part.column("id"), part.column("anchor"), pa.array(np.diff(off)), blobs], ["id", "anchor", "n", "items"]).filter(same)
            at += n


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, anchors = batch.column("id").to_numpy(), batch.column("anchor").to_numpy()
        mine, theirs = batch.column("items"), batch.column("anchor_items")
        yes = np.array([_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(mine, theirs, strict=True)], bool)
        yield pa.record_batch([pa.array(ids[yes]), pa.array(anchors[yes])], ["a", "b"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        for a, b in row_chunks(np.concatenate([[0], np.cumsum(8 * n)])):
            values = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("items").slice(a, b - a)])
            yield pa.record_batch([pa.array(np.repeat(ids[a:b], n[a:b])), pa.array(np.repeat(n[a:b], n[a:b])), pa.array(values)], ["id", "n", "shingle"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store: Store | None = None) -> DataFrame:
    """Components of documents whose distinct five-word shingle sets have Jaccard similarity >= 0.75.

    Returns one row per input row: the id, ``n_shingles``, ``component_id`` (the smallest id
    reachable over links, itself included) and ``kept`` (id equals component_id).  Null and empty texts
    have no shingles and are linked with nothing; texts of one to four words count as one shingle;
    texts of any length are read whole; repeated rows give repeated result rows; a null id gives a
    null component and is kept; an empty table gives no rows.  Other columns are ignored.
    """
    store = store or Store(docs.sparkSession, "minhash")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = store.put(plain.mapInArrow(_sign, "id long, n_shingles long, h1 long, h2 long, bands array<long>"), "signed")
    of_class = store.put(
        signed.where("id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
    )
    keyed = of_class.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    shared = store.put(keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "buckets")
    in_bucket = store.put(keyed.join(shared, "key"), "members")
    anchored = store.put(in_bucket.groupBy("id").agg(F.min("least").alias("anchor")).join(of_class.select(F.col("rep").alias("id"), "h1", "h2"), "id"), "anchored")
    # Sets that share a band grow with the corpus: a merge join at every size, never a broadcast of them.
    sets = store.put(plain.hint("merge").join(anchored, "id").mapInArrow(_member_sets, "id long, anchor long, n long, items binary").dropDuplicates(["id"]), "sets")
    # the sets of an anchor are dealt over blocks, each of which gets a copy of the anchor's own set
    blocks = store.put(sets.groupBy("anchor").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = sets.join(blocks, "anchor").withColumn("block", _spot("id"))
    copies = blocks.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    anchors = sets.select(F.col("id").alias("anchor"), F.col("items").alias("anchor_items")).join(copies, "anchor")
    links = store.put(dealt.where("id <> anchor").join(anchors, ["anchor", "block"]).select("id", "anchor", "items", "anchor_items").mapInArrow(_verify_anchors, "a long, b long"), "links")
    parts = connected_components(store, links)
    rest = _links_of_mixed_bands(store, sets, in_bucket, links, parts)
    found = connected_components(store, links.unionByName(rest))
    final = store.put(
        of_class.select("h1", "h2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id")),
        "final",
    )
    # Only documents that carry a set look up a component; the others, one hot key, never enter the join.
    with_set, without = signed.where("id IS NOT NULL AND n_shingles > 0"), signed.where("id IS NULL OR n_shingles = 0")
    joined = with_set.select("id", "n_shingles", "h1", "h2").join(final, ["h1", "h2"]).select("id", "n_shingles", "component_id")
    out = joined.unionByName(without.select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _spot(id_col: str) -> F.Column:
    return F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")


def _confirmed(store: Store, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``id``, ``anchor`` that are links of full sets; a set of many pairs is copied for shares of them."""
    ends = (("id", "anchor", "items"), ("anchor", "id", "anchor_items"))
    pairs = store.put(pairs.select("id", "anchor", *(F.pmod(F.xxhash64(other), F.lit(SHARES)).alias(f"{end}_share") for end, other, _ in ends)), "pairs")
    both = pairs
    for end, _, items in ends:
        copies = pairs.select(end, f"{end}_share").distinct()
        both = both.join(sets.select(F.col("id").alias(end), F.col("items").alias(items)).join(copies, end), [end, f"{end}_share"])
    return store.put(both.select("id", "anchor", "items", "anchor_items").mapInArrow(_verify_anchors, "a long, b long"), "confirmed")


def _prefixes(store: Store, sets: DataFrame, in_bucket: DataFrame, parts: DataFrame) -> DataFrame:
    """Of each set in a band of several connected parts, the rarest shingles that a link cannot do without.

    Shingles are ordered from rare to frequent; ``at`` counts those before.  Two linked sets have at least
    three quarters of the larger in common, so their first common shingle comes before the last three
    quarters of either.  Shingles of one set alone only take up places.
    """
    placed = in_bucket.select("key", "id").join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    placed = store.put(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    unsettled = placed.join(mixed, "key", "left_semi").select("id").distinct()
    rows = store.put(sets.hint("merge").join(unsettled, "id").select("id", "n", "items").mapInArrow(_shingle_rows, "id long, n long, shingle long"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("held_by")).where("held_by > 1")
    of_set = Window.partitionBy("id")
    alone = F.col("n") - F.count("*").over(of_set)
    at = alone + F.row_number().over(of_set.orderBy("held_by", "shingle")) - 1
    ranked = rows.hint("merge").join(counts, "shingle").select("id", "n", "shingle", at.alias("at"))
    return store.put(ranked.where(f"100 * (n - at) >= {PERCENT} * n"), "prefixes")


def _by_shingle(store: Store, prefixes: DataFrame, parts: DataFrame) -> DataFrame:
    """Prefix rows of the shingles that several connected parts share: whether a row is outside the shingle's
    largest part, whether it may be the smaller set of a link, and the most central set of that part."""
    rows = prefixes.join(parts, F.col("id") == F.col("node"), "left").select("id", "n", "shingle", "at", F.coalesce("component", "id").alias("part"))
    rows = store.put(rows.withColumn("smaller", F.expr(f"{100 + PERCENT} * (n - at) >= {2 * PERCENT} * n")), "parted")
    held = rows.groupBy("shingle", "part").agg(F.count("*").alias("held"), F.count_if("smaller").alias("smaller"), F.min(F.struct("at", "id")).alias("hub"))
    size = held.groupBy("shingle").agg(F.max(F.struct("held", "part", "hub")).alias("top"), F.sum("held").alias("all"), F.sum("smaller").alias("able"), F.count("*").alias("parts"))
    size = size.where("parts > 1 AND able > 0").select("shingle", F.col("top.part").alias("top"), F.col("top.hub.id").alias("hub"), F.ceil(F.col("all") / SHARE).cast("int").alias("blocks"), "all", "able")
    return store.put(rows.join(size, "shingle").withColumn("outside", F.col("part") != F.col("top")).drop("top"), "by_shingle")


def _links_of_mixed_bands(store: Store, sets: DataFrame, in_bucket: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links in the bands whose sets the anchors left in several connected parts.

    Candidates share a shingle of their prefixes after which enough is left of both sets.  Where they are
    many, every set first meets the most central set of the largest part at its shingles, as long as that
    halves the comparisons left.
    """
    prefixes, found, before = _prefixes(store, sets, in_bucket, parts), None, None
    while True:
        rows = _by_shingle(store, prefixes, parts)
        work, n = rows.where("outside").agg(F.sum(F.when(F.col("smaller"), F.col("all")).otherwise(F.col("able"))), F.count("*")).first()
        if not n or work <= PAIRS * n or before and 2 * work > before:
            break
        before = work
        near = rows.where("outside").groupBy("id", "hub").agg(F.count("*").alias("shared")).groupBy("id").agg(F.max_by("hub", F.struct("shared", "hub")).alias("anchor"))
        more = _confirmed(store, sets, near)
        found = more if found is None else found.unionByName(more)
        parts = connected_components(store, links.unionByName(found))
    # each outside row meets all rows of its shingle, or only those that may be the smaller set where it is not
    x = rows.where("outside").select("shingle", "smaller", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "at", "part")))
    y = rows.select("shingle", _spot("id").alias("block"), *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "at", "part", "smaller")))
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    may = (F.col("part_x") != F.col("part_y")) & ((100 + PERCENT) * left >= PERCENT * (F.col("n_x") + F.col("n_y")))
    ends = F.least("id_x", "id_y").alias("id"), F.greatest("id_x", "id_y").alias("anchor")
    met = [x.where(mine).join(y.where(theirs), ["shingle", "block"]).where(may).select(*ends) for mine, theirs in (("smaller", "true"), ("NOT smaller", "smaller_y"))]
    rest = _confirmed(store, sets, met[0].unionByName(met[1]).distinct())
    return rest if found is None else found.unionByName(rest)
