"""Embedding near-duplicates: PCA-ordered tiled comparison.

Equal vectors of a label collapse first.  The others are turned into the eigenvector order of their
second moments, so that a few leading dimensions carry most of a product, and compared in tiles of
bounded size.  Tiles are cells of a tree over the leading components of a label; two tiles meet only if
the boxes of their leading components and suffix norms leave room for the threshold, which is decided
before any vector is copied.  A tile accumulates leading dimensions first; by Cauchy-Schwarz the rest of a product is
at most the product of the suffix norms, and pairs (mostly whole tiles) are dropped once that cannot
reach the threshold.  Survivors are decided on the given vectors in double precision.  A tile returns
counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quarry.llm.components import connected_components
from quarry.llm.store import Store

COSINE = 0.93
#: Vectors on a side of a tile, and of the parts that it is compared in.
TILE, PART = 2048, 512
#: Dimensions after which the bound is tested.
STEPS = (4, 8, 16, 32, 64, 128, 256, 512)
#: Leading components that tiles are cut by, and vectors that the cuts are chosen from (per length of vector).
LEADING, SAMPLE = 6, 200_000


def usable(embedding: str, label: str) -> F.Column:
    """Rows that can link: a label, and a vector of finite numbers that is not zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second moments of a partition's unit vectors by dimension count and cell."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        for dim in np.unique(sizes).tolist():
            x = _matrix(batch.column(0).filter(pa.array(sizes == dim)))
            held[dim] = held.get(dim, 0) + x.T @ x
    for dim, cells in held.items():
        flat = np.asarray(cells).reshape(-1)
        yield pa.record_batch([pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat))), pa.array(flat)], ["dim", "cell", "value"])


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, the matrix that turns vectors into PCA order (leading first)."""
    cells = classes.select("embedding", "dim").mapInArrow(_moments, "dim int, cell long, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value"))
    table = cells.toArrow()
    dims, cell, value = (table.column(c).to_numpy() for c in ("dim", "cell", "value"))
    out = {}
    for dim in np.unique(dims).tolist():
        own = np.zeros(dim * dim)
        own[cell[dims == dim]] = value[dims == dim]
        out[dim] = np.linalg.eigh(own.reshape(dim, dim))[1][:, ::-1]
    return out


def cell_cuts(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and values, in heap order, that halve points again and again along their widest axis."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    node = np.zeros(len(points), np.int64)
    for level in range(depth):
        for k in range((1 << level) - 1, (2 << level) - 1):
            own = np.flatnonzero(node == k)
            if len(own):
                axis[k] = np.ptp(points[own], axis=0).argmax()
                value[k] = np.median(points[own, axis[k]])
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > value[node])
    return axis, value


def cells(points: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of the tree that each point lies in."""
    axis, value = cuts
    node = np.zeros(len(points), np.int64)
    for _ in range(len(axis).bit_length()):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > value[node])
    return node - len(axis)


def near_cells(cell: np.ndarray, low: np.ndarray, high: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cells (places in ``cell``) whose boxes a pair of that cosine may span, down the tree of boxes.

    Of unit vectors with leading components l and suffix norms s, 2 - 2 cos >= |l - l'|^2 + (s - s')^2."""
    depth = int(cell.max()).bit_length()
    first = (1 << depth) - 1
    lows, highs = np.full((2 * first + 1, low.shape[1]), np.inf), np.full((2 * first + 1, low.shape[1]), -np.inf)
    lows[first + cell], highs[first + cell] = low, high
    for k in range(first - 1, -1, -1):
        lows[k], highs[k] = np.minimum(lows[2 * k + 1], lows[2 * k + 2]), np.maximum(highs[2 * k + 1], highs[2 * k + 2])
    a = b = np.zeros(1, np.int64)
    for level in range(depth + 1):
        gap = np.maximum(np.maximum(lows[a] - highs[b], lows[b] - highs[a]), 0)
        keep = (gap * gap).sum(axis=1) <= 2 - 2 * cosine + 1e-9
        a, b = a[keep], b[keep]
        if level < depth:
            a, b = np.concatenate([2 * a + 1, 2 * a + 1, 2 * a + 2, 2 * a + 2]), np.concatenate([2 * b + 1, 2 * b + 2, 2 * b + 1, 2 * b + 2])
            a, b = a[a <= b], b[a <= b]
    place = np.full(first + 1, -1)
    place[cell] = np.arange(len(cell))
    a, b = place[a - first], place[b - first]
    return a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]


def similar(x: np.ndarray, y: np.ndarray, turned_x: np.ndarray, turned_y: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with a cosine of at least ``cosine``: leading dimensions first, then
    the given vectors."""
    dim = x.shape[1]
    steps = [s for s in STEPS if s < dim]
    rows = cols = None
    done = 0
    for step in steps:
        rest_x = np.sqrt(np.maximum((turned_x[:, step:] ** 2).sum(axis=1), 0))
        rest_y = np.sqrt(np.maximum((turned_y[:, step:] ** 2).sum(axis=1), 0))
        if rows is None:
            dense = turned_x[:, done:step] @ turned_y[:, done:step].T if done == 0 else dense + turned_x[:, done:step] @ turned_y[:, done:step].T
            alive = dense + rest_x[:, None] * rest_y[None, :] >= cosine - 1e-9
            n = int(alive.sum())
            if n * 16 < alive.size:
                rows, cols = np.nonzero(alive)
                product = dense[rows, cols]
        else:
            product = product + np.einsum("ij,ij->i", turned_x[rows, done:step], turned_y[cols, done:step])
            keep = product + rest_x[rows] * rest_y[cols] >= cosine - 1e-9
            rows, cols, product = rows[keep], cols[keep], product[keep]
        done = step
        if rows is not None and not len(rows):
            return rows, cols
    if rows is None:
        rows, cols = np.nonzero(x @ y.T >= cosine - 1e-9)
    exact = np.concatenate([np.einsum("ij,ij->i", x[rows[i : i + 65536]], y[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)]) if len(rows) else np.zeros(0)
    keep = exact >= cosine
    return rows[keep], cols[keep]


def flattened(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        hi, lo = np.maximum(la, lb), np.minimum(la, lb)
        moved = hi != lo
        if not moved.any():
            break
        np.minimum.at(label, hi[moved], lo[moved])
        while (label[label] != label).any():
            label = label[label]
        a, b = a[moved], b[moved]
    return label


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Links between vectors of equal labels whose cosine is at least ``cosine``.

    Returns one row per input row: the id, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable) and ``kept``.  Rows without label or id, and null, empty or
    zero vectors or vectors with null or non-finite components, link with nothing; vectors of unequal
    lengths do not link; repeated rows count as vectors of their own; an empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    store = Store(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).alias("embedding"), F.col(label_col).alias("label"))
    can = usable("embedding", "label") & F.col("id").isNotNull()
    keyed = rows.where(can).withColumn("hash", F.xxhash64("label", "embedding"))
    classes = store.put(keyed.groupBy("hash", "label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")), "classes")
    turn = spark.sparkContext.broadcast(rotations(classes))
    tiled, met = _tiles(store, classes, turn, cosine)
    sides = met.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("tile"))

    def compare(table: pa.Table) -> pa.Table:
        rep, copies, tile = (table.column(c).to_numpy() for c in ("rep", "copies", "tile"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        x = _matrix(table.column("embedding"))
        turned = x @ turn.value[x.shape[1]]
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        weight, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for p in range(0, len(left), PART):
            for q in range(p if low == high else 0, len(right), PART):
                a, b = left[p : p + PART], right[q : q + PART]
                r, c = similar(x[a], x[b], turned[a], turned[b], cosine)
                r, c = a[r], b[c]
                if low == high and p == q:
                    upper = r < c
                    r, c = r[upper], c[upper]
                if len(r):
                    np.add.at(weight, r, copies[c])
                    np.add.at(weight, c, copies[r])
                    own = np.flatnonzero(label != np.arange(len(rep)))
                    label = flattened(len(rep), np.concatenate([own, r]), np.concatenate([label[own], c]))
        linked = np.flatnonzero(weight)
        return pa.table({"a": rep[linked], "b": rep[label[linked]], "links": weight[linked]})

    found = store.put(tiled.join(sides, "tile").groupBy("low", "high").applyInArrow(compare, "a long, b long, links long"), "links")
    counts = store.put(found.groupBy("a").agg(F.sum("links").alias("links")), "counts")
    parts = connected_components(store, found.select("a", "b"))
    final = store.put(
        classes.join(counts, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("node"), "left").select(
            "hash", "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
        ),
        "final",
    )
    out = keyed.join(final, ["hash", "label", "embedding"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~can).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _tiles(store: Store, classes: DataFrame, turn, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Vectors with the number of their tile, and the pairs of tiles (``low``, ``high``) that must meet.

    The cuts of a label's tree come from a bounded sample; every vector is placed by them, and a cell of
    more than ``TILE`` vectors makes several tiles.  The driver sees one box per cell."""
    spark = classes.sparkSession
    names = [f"c{k}" for k in range(LEADING + 1)]

    def lead(column: pa.Array, dim: int) -> np.ndarray:
        turned = _matrix(column) @ turn.value[dim]
        out = np.zeros((len(turned), LEADING + 1))
        out[:, : min(dim, LEADING)] = turned[:, :LEADING]
        out[:, LEADING] = np.sqrt((turned[:, LEADING:] ** 2).sum(axis=1))
        return out

    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    large = store.put(groups.where(F.col("n") > TILE), "large")
    total = large.agg(F.sum("n")).first()[0] or 0
    rows = classes.join(large.select("label", "dim"), ["label", "dim"], "left_semi").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))).orderBy("rep")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = np.zeros((len(batch), LEADING + 1)), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                out[own] = lead(batch.column(2).take(pa.array(own)), dim)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(LEADING + 1))], ["label", "dim", *names])

    kind = StructType([classes.schema["label"], classes.schema["dim"], *(StructField(n, DoubleType()) for n in names)])
    sample = rows.select("label", "dim", "embedding").mapInArrow(measure, kind).toArrow() if total else None  # at most SAMPLE rows of a few numbers
    trees: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for label, dim, n in large.select("label", "dim", "n").collect():
        own = sample.filter(pc.and_(pc.equal(sample.column("label"), pa.scalar(label, sample.schema.field("label").type)), pc.equal(sample.column("dim"), dim)))
        points = np.stack([own.column(n).to_numpy() for n in names], 1)
        trees[label, dim] = cell_cuts(points, int(-(-n // TILE) - 1).bit_length())
    known = spark.sparkContext.broadcast(trees)
    at = [classes.columns.index(c) for c in ("label", "dim", "embedding")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(at[0]), batch.column(at[1]).to_numpy()
            out, cell = np.zeros((len(batch), LEADING + 1)), np.zeros(len(batch), np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                out[own] = lead(batch.column(at[2]).take(pa.array(own)), dim)
                coded = labels.take(pa.array(own)).dictionary_encode()
                for k, label in enumerate(coded.dictionary.to_pylist()):
                    if (label, dim) in known.value:
                        rows = own[coded.indices.to_numpy() == k]
                        cell[rows] = cells(out[rows], known.value[label, dim])
            yield pa.record_batch([*batch.columns, pa.array(cell), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(LEADING + 1))], [*batch.schema.names, "cell", *(f"c{k}" for k in range(LEADING + 1))])

    fields = [*classes.schema.fields, StructField("cell", LongType()), *(StructField(n, DoubleType()) for n in names)]
    placed = store.put(classes.mapInArrow(place, StructType(fields)), "placed")
    boxes = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), *(F.min(n).alias(f"low_{n}") for n in names), *(F.max(n).alias(f"high_{n}") for n in names))
    found = boxes.orderBy("label", "dim", "cell").toArrow()
    parts = -(-found.column("n").to_numpy() // TILE)
    base = np.cumsum(parts) - parts
    low, high = (np.stack([found.column(f"{side}_{n}").to_numpy() for n in names], 1) if len(found) else np.zeros((0, len(names))) for side in ("low", "high"))
    keys = found.select(["label", "dim"]).to_pylist()
    cell, pairs = found.column("cell").to_numpy(), []
    begin = 0
    while begin < len(keys):
        end = begin + 1
        while end < len(keys) and keys[end] == keys[begin]:
            end += 1
        a, b = near_cells(cell[begin:end], low[begin:end], high[begin:end], cosine)
        pairs.append((a + begin, b + begin))
        begin = end
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    # tiles of two cells that meet: all of one with all of the other
    times = parts[a] * parts[b]
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    wide = np.repeat(parts[b], times)
    i, j = np.repeat(base[a], times) + nth // np.maximum(wide, 1), np.repeat(base[b], times) + nth % np.maximum(wide, 1)
    met = spark.createDataFrame(pa.table({"low": pa.array(i[i <= j], pa.int64()), "high": pa.array(j[i <= j], pa.int64())}))
    leaves = spark.createDataFrame(pa.table({"label": found.column("label"), "dim": found.column("dim"), "cell": found.column("cell"), "base": pa.array(base, pa.int64()), "parts": pa.array(parts, pa.int64())}))
    tiled = placed.join(leaves, ["label", "dim", "cell"]).select("rep", "copies", "embedding", (F.col("base") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("tile"))
    return tiled, met
