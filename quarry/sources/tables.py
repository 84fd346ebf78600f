"""The engine's tables by folder, and the records that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.identity import record_id


SMALL = 64 << 20
#: Tables of long texts, whose operators spend their time in the scan's own stage.
TEXTS = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores, dealt over all cores; anything larger as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Records of conversation turns: one per turn, keyed by conversation and event."""
    return conversations.select(
        record_id(F.col("conv_id"), F.col("turn")).alias("record_id"),
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("event_index"),
        "role",
        "text",
    )


def note_path(source: str = "source", doc: str = "doc_id") -> F.Column:
    return F.concat(F.col(source), F.lit("/"), F.col(doc).cast("string"), F.lit(".md"))
