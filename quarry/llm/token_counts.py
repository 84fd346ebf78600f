"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.store import Store
from quarry.llm.tokens import encoder

#: Lengths summed together before the running sum over all lengths.
STRIDE = 4096


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text", end_ids: int = 0) -> DataFrame:
    """Documents by encoded length: ``n_tokens``, ``n_docs``.

    Null and empty texts have ``end_ids`` tokens; repeated rows count each time; an empty table gives
    no rows.  Each partition sends one row per distinct length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        sizes: list[np.ndarray] = []
        for batch in batches:
            sizes += [np.diff(off) + end_ids for _, _, _, off in encoder(tokenizer).rows(batch.column(0))]
        if sizes:
            held, n = np.unique(np.concatenate(sizes), return_counts=True)
            yield pa.record_batch([pa.array(held.astype(np.int64)), pa.array(n.astype(np.int64))], ["n_tokens", "n"])

    return docs.select(text_col).mapInArrow(count, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def context_totals(histogram: DataFrame, store: Store | None = None) -> DataFrame:
    """For every length L that occurs: documents and tokens at and above it, the share of documents of
    at most L tokens, the tokens of all documents, and the tokens left when every document is cut to L.

    The running sums take two levels, strides of lengths and lengths within a stride, so no task sees
    more than a stride's lengths or one row per stride.
    """
    store = store or Store(histogram.sparkSession, "lengths")
    h = store.put(histogram.withColumn("stride", F.floor(F.col("n_tokens") / STRIDE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "histogram")
    strides = h.groupBy("stride").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = W.orderBy(F.desc("stride")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.desc("stride")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row per stride
    above = strides.select(
        "stride",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("above_tokens"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    within = W.partitionBy("stride").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = h.join(above, "stride").withColumns({"docs_from": F.sum("n_docs").over(within) + F.col("above_docs"), "tokens_from": F.sum("tokens").over(within) + F.col("above_tokens")})
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_within"),
        "all_tokens",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("tokens_cut"),
    )


def length_quantile(totals: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed (one row, or none)."""
    return totals.where(F.col("share_within") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def tokens_within(totals: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to any ``limit``, by the next length that occurs."""
    above = F.col("n_tokens") >= limit
    return totals.agg(
        F.coalesce(
            F.min_by(F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.lit(limit), F.when(above, F.col("n_tokens"))),
            F.max("all_tokens"),
            F.lit(0),
        ).alias("tokens")
    )
