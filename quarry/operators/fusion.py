"""Fusion: weighted reciprocal ranks, adaptive routing, rerank order, interleaving, page shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, DEPTH = 60, 60
LEXICAL_WEIGHT = 0.7
RERANK_FLOOR = -0.8


def ranked(lane: DataFrame, id_col: str, score_col: str = "score", depth: int = DEPTH) -> DataFrame:
    """id and ``rank`` from 1 of a lane's best rows; the sort sees only the lane's top rows."""
    top = lane.orderBy(F.desc(score_col), id_col).limit(depth)
    return top.select(id_col, F.row_number().over(W.orderBy(F.desc(score_col), id_col)).alias("rank"))


def rrf(lanes: list[tuple[DataFrame, float]], id_col: str, limit: int) -> DataFrame:
    """Fuse ranked lanes (id, rank): the sum of weight / (K + rank), ties by id."""
    parts = [lane.select(id_col, (F.lit(weight) / (F.lit(K) + F.col("rank"))).alias("part"), F.lit(n).alias("lane")) for n, (lane, weight) in enumerate(lanes)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # a fixed order of adding keeps scores the same on every run
    summed = union.groupBy(id_col).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("lane", "part"))), F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))
    return summed.select(id_col, F.round("score", 9).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def adaptive(lexical: DataFrame, dense: DataFrame, id_col: str, limit: int, weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """One lane alone if the other is empty, else both fused.  ``via`` names the route."""
    if dense.isEmpty():
        return lexical.select(id_col, F.round("score", 9).alias("score"), F.lit("lexical").alias("via")).orderBy(F.desc("score"), id_col).limit(limit)
    if lexical.isEmpty():
        return dense.select(id_col, F.round("score", 9).alias("score"), F.lit("dense").alias("via")).orderBy(F.desc("score"), id_col).limit(limit)
    return rrf([(ranked(lexical, id_col), weight), (ranked(dense, id_col), 1 - weight)], id_col, limit).withColumn("via", F.lit("fused"))


def reordered(fused: DataFrame, scored: DataFrame, id_col: str, rank_col: str = "rank") -> DataFrame:
    """Scored rows by score, ties in fused order; unscored rows after them as they were."""
    rows = fused.join(scored.select(id_col, F.col("score").alias("rerank")), id_col, "left")
    order = W.orderBy(F.col("rerank").isNull(), F.desc("rerank"), rank_col)
    return rows.withColumn("position", F.row_number().over(order))


def merged(populations: DataFrame, floor: float = RERANK_FLOOR) -> DataFrame:
    """Reranked rows of all populations in one order: best first, history before notes on ties, weak
    rows dropped.  Columns: population, id, score."""
    order = W.orderBy(F.desc("score"), F.when(F.col("population") == "history", 0).otherwise(1), "id")
    return populations.where(F.col("score") >= floor).withColumn("position", F.row_number().over(order))


def interleaved(populations: DataFrame) -> DataFrame:
    """Rows of both populations in turn by their own rank, history first."""
    turn = F.when(F.col("population") == "history", 0).otherwise(1)
    return populations.withColumn("position", F.row_number().over(W.orderBy("rank", turn, "id")))


def page_shortlist(lanes: list[DataFrame], folders: list[str], limit: int = 5, depth: int = 40) -> DataFrame:
    """Pages by fused chunk ranks: a page counts once per lane, at the rank of its first chunk there.
    Lanes have ``chunk``, ``path`` and ``score``."""
    wanted: Column = F.lit(False)
    for folder in folders:
        wanted = wanted | F.startswith(F.col("path"), F.lit(folder))
    parts = []
    for lane in lanes:
        top = lane.orderBy(F.desc("score"), "chunk").limit(depth)
        rank = F.row_number().over(W.orderBy(F.desc("score"), "chunk"))
        parts.append(top.withColumn("rank", rank).where(wanted).groupBy("path").agg(F.min("rank").alias("rank")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("path").agg(F.round(F.sum(F.lit(1.0) / (F.lit(K) + F.col("rank"))), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "path").limit(limit)


def with_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates in their order, every note followed by its links.

    candidates: population, id, position; links: parent, id, ordinal.  Rows of one answer."""
    kind = dict(candidates.dtypes)["id"]
    own = candidates.select("population", "id", F.lit(None).cast(kind).alias("parent"), "position", F.lit(-1).alias("ordinal"))
    notes = candidates.where("population <> 'history'").select(F.col("id").alias("parent"), "position")
    followed = links.join(notes, "parent").select(F.lit("link").alias("population"), "id", "parent", "position", F.col("ordinal").cast("int").alias("ordinal"))
    both = own.unionByName(followed)
    return both.withColumn("place", F.row_number().over(W.orderBy("position", "ordinal", "id"))).drop("position", "ordinal")


def scored_within(fused: DataFrame, scored_order: Column, budget: int) -> DataFrame:
    """The rows that a shared budget scores: both populations in turn, best first.  fused: population, id, rank."""
    turn = F.when(F.col("population") == "history", 0).otherwise(1)
    return fused.withColumn("turn", F.row_number().over(W.orderBy("rank", turn, "id"))).where(F.col("turn") <= budget).withColumn("score", scored_order)
