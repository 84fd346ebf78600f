"""Reranking: a pluggable scorer of query and text, with lexical overlap as its offline default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens

TEXT_TOKENS, QUERY_TOKENS = 256, 128


def overlap_scores(rows: DataFrame, query: str, text_col: str) -> DataFrame:
    """Rows with a ``score`` from -1 to 1: twice the share of the query's words in the text's first
    words, less one."""
    wanted = F.array_distinct(F.slice(tokens(F.lit(query)), 1, QUERY_TOKENS))
    have = F.slice(tokens(F.coalesce(F.col(text_col), F.lit(""))), 1, TEXT_TOKENS)
    share = F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(1))
    return rows.withColumn("score", F.round(2 * share - 1, 6))


def model_scores(rows: DataFrame, id_col: str, text_col: str, scorer: Callable[[list[str]], list[float]], depth: int) -> DataFrame:
    """id and ``score`` of the first rows by ``rank``, by a model of texts; a depth instead of a deadline
    keeps the result the same on every run."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scorer(batch.column(1).to_pylist()), pa.float64())], [id_col, "score"])

    return rows.where(F.col("rank") <= depth).select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double").where("NOT isnan(score) AND abs(score) < double('infinity')")
