"""Queries over the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontamination import benchmark_leaks
from quarry.llm.embedding_dedup import near_duplicate_vectors
from quarry.llm.minhash import near_duplicates
from quarry.llm.oracles import ORACLE_SQL
from quarry.llm.packing import cut_pieces, place, plan_places
from quarry.llm.quality import THRESHOLD as QUALITY_THRESHOLD
from quarry.llm.quality import fit_quality, with_quality
from quarry.llm.secrets import built_in_forest, secret_findings
from quarry.llm.simple8b import token_file
from quarry.llm.store import Store
from quarry.llm.suffix_dedup import duplicate_bytes
from quarry.llm.token_counts import context_totals, length_histogram
from quarry.llm.tokens import tokenizer_path
from quarry.llm.toxicity import THRESHOLD as TOXIC_THRESHOLD
from quarry.llm.toxicity import fit_toxicity, with_toxicity
from quarry.sources.tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def _held_out(modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text falls into the held-out fold; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False)).alias("held_out")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(_table(spark, sf_dir, "documents"), built_in_forest(spark))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs, model, score_col="score")
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "packing")
    pieces = cut_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, store=store)
    plan = plan_places(pieces, store)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), plan)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")), score_col="score")
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_id_output": op5_token_id_output,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
