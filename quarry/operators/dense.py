"""Dense lane: exact cosine top-k, scoped search, best per group, neighbour pairs in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 2048


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors, in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, limit: int = 20) -> DataFrame:
    """The rows of the largest product with a query vector; ties by id, null vectors never."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col), F.round(dot(F.col(vector_col), q), 6).alias("score"))
    return scored.where(~F.isnan("score")).orderBy(F.desc("score"), id_col).limit(limit)


def best_per_group(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, group_col: str, limit: int = 20) -> DataFrame:
    """Each group once, at its best row."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.col(vector_col).isNotNull()).select(group_col, id_col, F.round(dot(F.col(vector_col), q), 6).alias("score"))
    best = scored.groupBy(group_col).agg(F.max(F.struct(F.col("score"), -F.col(id_col))).alias("top"))
    return best.select(group_col, (-F.col("top.col2")).alias(id_col), F.col("top.score").alias("score")).orderBy(F.desc("score"), group_col).limit(limit)


def neighbour_pairs(vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.75, neighbours: int = 5) -> DataFrame:
    """Unordered pairs ``left_id`` < ``right_id`` of product >= threshold that are among the nearest
    ``neighbours`` of either row, once, at their score.

    Rows are dealt into tiles of bounded size; a task multiplies two tiles and returns at most
    ``neighbours`` rows for each of theirs, so the exchange after it grows with rows times tiles.
    """
    n = vectors.where(F.col(vector_col).isNotNull()).count()
    blocks = max(1, -(-n // TILE))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    tiled = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def nearest(table: pa.Table) -> pa.Table:
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        v = table.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sides = [(np.flatnonzero(block == i), np.flatnonzero(block == j))]
        if i != j:
            sides.append(sides[0][::-1])
        out: list[list[np.ndarray]] = [[], [], []]
        for left, right in sides:
            right = right[np.argsort(ids[right], kind="stable")]  # equal scores go by the smaller id
            for a in range(0, len(left), 256):
                own = left[a : a + 256]
                s = x[own] @ x[right].T
                r, c = np.nonzero((s >= threshold - 1e-6) & (own[:, None] != right[None, :]))
                v = s[r, c]
                v = np.copysign(np.floor(np.abs(v) * 1e6 + 0.5) / 1e6, v)  # the score that pairs are ranked by
                best = np.lexsort((c, -v, r))
                best = best[v[best] >= threshold]
                r, c, v = r[best], c[best], v[best]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < neighbours
                out[0].append(ids[own[r[keep]]])
                out[1].append(ids[right[c[keep]]])
                out[2].append(v[keep])
        return pa.table({k: np.concatenate(v) if v else np.zeros(0) for k, v in zip(("a", "b", "score"), out, strict=True)})

    kind = dict(rows.dtypes)["id"]
    found = tiled.groupBy("i", "j").applyInArrow(nearest, f"a {kind}, b {kind}, score double").withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)
    first = found.withColumn("nth", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("nth") <= neighbours)
    pair = first.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "score")
    return pair.groupBy("left_id", "right_id").agg(F.max("score").alias("score"))


def current_vectors(vectors: DataFrame, records: DataFrame, id_col: str, revision_col: str) -> DataFrame:
    """Vectors of records that still have the text they were made from."""
    return vectors.join(records.select(id_col, revision_col).distinct(), [id_col, revision_col], "left_semi")


def pending(records: DataFrame, vectors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Records without a vector, shortest first."""
    return records.join(vectors.select(id_col), id_col, "left_anti").orderBy(F.length(text_col), id_col)


def hashed_embedder(dims: int = 64):
    """A deterministic offline embedder: signed token hashes, unit norm; the plug-in point for models."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch), dims))
            for r, text in enumerate(batch.column(1).to_pylist()):
                for tok in (text or "").lower().split():
                    h = int.from_bytes(__import__("hashlib").blake2b(tok.encode(), digest_size=8).digest(), "little")
                    out[r, h % dims] += 1 if h >> 63 else -1
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(batch) + 1) * dims, dims), pa.int32()), pa.array(out.reshape(-1)))
            yield pa.record_batch([batch.column(0), vector], [batch.schema.names[0], "vector"])

    return embed


def embed(records: DataFrame, id_col: str, text_col: str, embedder=None) -> DataFrame:
    """Vectors of records by an Arrow embedder (id, text) -> (id, vector)."""
    kind = dict(records.dtypes)[id_col]
    return records.select(id_col, text_col).mapInArrow(embedder or hashed_embedder(), f"{id_col} {kind}, vector array<float>")


def presence(vectors: DataFrame, scope_col: str, vector_col: str, scopes: list) -> DataFrame:
    """Scopes that have vectors, with their number; partial counts are all that is exchanged."""
    return vectors.where(F.col(scope_col).isin(*scopes) & F.col(vector_col).isNotNull()).groupBy(scope_col).agg(F.count("*").alias("vectors"))
