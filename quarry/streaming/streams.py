"""Structured Streaming: windows over event time, duplicates, incremental ingest, keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import shared_dir


#: Bytes of a row group of an arriving file, the least that a task reads of it.
ROW_GROUP = 8 << 20


def event_stream(spark: SparkSession, path: str, late: str = "2 days", batches: int = 4) -> DataFrame:
    """A table as a stream with a watermark on ``ts``: its rows arrive in order of time, in batches.

    The table is first written as that many files, each of one span of time, in the shared folder, and every
    batch takes one, so that state is carried from batch to batch."""
    root = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    days = table.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if days["a"] is not None:
        width = max((days["b"] - days["a"]).total_seconds() / batches, 1.0)
        since = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.lit(days["a"]).cast("timestamp")) / 1e6
        span = F.least(F.lit(batches - 1), F.floor(since / width)).cast("int")
        for n in range(batches):  # one after the other, as files arrive; read by all tasks, in row groups that all can read again
            table.where(span == n).repartition(1).write.option("parquet.block.size", ROW_GROUP).parquet(f"{root}/part={n}")
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(root)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(stream: DataFrame, size: str = "1 day") -> DataFrame:
    """Events and their value per window and type."""
    return stream.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events closer than a gap."""
    return stream.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; state older than the watermark is dropped."""
    return stream.dropDuplicatesWithinWatermark(keys)


def running_totals(stream: DataFrame) -> DataFrame:
    """Keyed state: events and value of each user so far, by batch.

    A batch is summed by user where it is read, and state holds a sum a user; only users of a batch are in
    its output."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(spark: SparkSession, result: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what there is and return the result as a table of the shared folder.

    Complete results replace each other; appended ones add up.  A batch is written under its number,
    so a repeated batch after a failure overwrites itself."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last.append(number)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    if mode == "complete":
        return spark.read.schema(result.schema).parquet(f"{root}/out/batch={last[-1]}")
    return spark.read.schema(result.schema).parquet(*(f"{root}/out/batch={n}" for n in sorted(set(last))))


def ingest_stream(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Hand every batch of a stream to an incremental ingest; returns the running query."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
