"""The corpus pipeline: five stages over ``documents``.

Each stage takes all that its predecessor kept, is written as Parquet and read again.  All stages but
the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontamination import without_leaks
from quarry.llm.minhash import near_duplicates
from quarry.llm.packing import pack
from quarry.llm.secrets import built_in_forest, without_secrets
from quarry.llm.store import Store
from quarry.llm.tokens import tokenizer_path
from quarry.llm.toxicity import THRESHOLD, fit_toxicity, with_toxicity

TOKENIZER, END_ID = "byte_bpe_50k.json", 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go.

    Null and empty texts score as documents without evidence; whole texts of any length are scored;
    repeated rows stay or go alike; columns of any name stay; an empty table gives an empty one."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "toxicity_score"
    while score in docs.columns:
        score += "_"
    scored = with_toxicity(docs, model, score_col=score)
    return scored.where(F.col(score) < THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id.

    Documents without an id stay, and so do null and empty texts, which are linked with nothing; rows that
    share an id are one document and stay or go together; columns of any name stay; an empty table gives an
    empty one."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; whole texts are searched; repeated rows stay or go alike; without items all
    documents stay; columns of any name stay; an empty table gives an empty one."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked.

    Null and empty texts stay as they are; whole texts are scanned; repeated rows are masked alike; columns
    of any name stay; an empty table gives an empty one."""
    return without_secrets(docs, built_in_forest(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed: one row per piece with its ids, sequence and offset.

    Null and empty texts have the end id alone; texts of any length are cut into windows; repeated rows,
    rows of one id and rows without an id are packed each; other columns are left behind; an empty table
    gives no rows."""
    return pack(docs, tokenizer_path(TOKENIZER), END_ID).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: No stage of models, sketches or tokenizers has an equal in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
