"""Readers of archives, notes, registries, logs and vectors."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
EVENT = T.StructType([T.StructField(n, _S) for n in ("id", "kind", "role", "text", "timestamp")])
CONVERSATION = T.StructType(
    [
        *(T.StructField(n, _S) for n in ("kind", "id", "source", "sourceId", "title", "startedAt", "updatedAt", "workspace")),
        T.StructField("schemaVersion", T.IntegerType()),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("provenance", T.StructType([T.StructField("contentSha256", _S), T.StructField("redactions", T.IntegerType())])),
        T.StructField("hosts", T.ArrayType(_S)),
    ]
)
QUERY_EVENT = T.StructType(
    [
        *(T.StructField(n, _S) for n in ("ts", "entrypoint", "query", "workspace", "lane", "index_status", "served_by")),
        T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("record_id", _S), T.StructField("score", T.DoubleType()), T.StructField("lane", _S), T.StructField("via", _S)]))),
        T.StructField("warnings", T.ArrayType(_S)),
    ]
)
REGISTRY = T.StructType(
    [
        *(T.StructField(n, _S) for n in ("job_key", "conversation_id", "source", "revision_sha256", "episode_id", "model_requested", "model_resolved", "authored_at", "synthesized_at", "workspace")),
        T.StructField("event_ids", T.ArrayType(_S)),
        T.StructField("usage", T.StructType([T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])),
        T.StructField("output", T.StructType([T.StructField("title", _S), T.StructField("summary", _S), T.StructField("facts", T.ArrayType(_S)), T.StructField("open_ends", T.ArrayType(_S))])),
        T.StructField("supersedes", T.ArrayType(_S)),
    ]
)


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of a line-per-conversation archive; its manifest line is no conversation, blank
    lines are nothing, and a malformed line fails the read."""
    return spark.read.schema(CONVERSATION).option("mode", "FAILFAST").json(path).where("kind IS NULL")


def archive_events(conversations: DataFrame) -> DataFrame:
    """One row per event with its index; conversations must carry an id and a content hash."""
    keyed = conversations.withColumn("id", F.when(F.col("id").isNull() | F.col("provenance.contentSha256").isNull(), F.raise_error(F.lit("conversation lacks id or provenance.contentSha256"))).otherwise(F.col("id")))
    each = keyed.select(
        F.col("id").alias("conversation_id"), F.col("provenance.contentSha256").alias("source_sha256"), F.coalesce("source", F.lit("unknown")).alias("provider"), "workspace", "title", "startedAt", F.sort_array(F.array_distinct("hosts")).alias("hosts"), F.posexplode("events").alias("event_index", "e")
    )
    return each.select("*", F.col("e.id").alias("event_id"), "e.kind", "e.role", "e.text", F.coalesce("e.timestamp", "startedAt").alias("authored_at")).drop("e", "startedAt")


def notes(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Markdown files below a folder, by relative path, with their text and content hash; hidden
    folders, ``node_modules`` and the named ones stay out, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    relative = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    rows = files.select(F.substring_index(relative, base, -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return rows.where(~F.exists(folders, lambda f: F.startswith(f, F.lit(".")) | f.isin("node_modules", *exclude))).orderBy("path")


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Records of a registry, one file each, with the file's name; unreadable files are left out."""
    rows = spark.read.schema(T.StructType([*REGISTRY.fields, T.StructField("_corrupt_record", _S)])).option("multiLine", True).option("mode", "PERMISSIVE").json(root)
    return rows.withColumn("file", F.col("_metadata.file_name")).where("_corrupt_record IS NULL AND job_key IS NOT NULL").drop("_corrupt_record")


def registry_files(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Files of a registry, newest first, without opening them: all, or as many as asked for."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root).select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path")
    return rows if most is None else rows.limit(most)


def written_at(spark: SparkSession, root: str) -> DataFrame:
    """When a folder's files were last written, in any format, without opening them (one row)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.agg(F.max("modificationTime").alias("written_at"), F.count("*").alias("files"))


def query_log(spark: SparkSession, root: str, days: int, today: date) -> DataFrame:
    """Events of the last days' files; torn lines are left out, missing days are nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    named = [f"{root}/{(today - timedelta(days=n)).isoformat()}.jsonl" for n in range(days - 1, -1, -1)]
    there = [p for p in named if fs.exists(path(p))]
    if not there:
        return spark.createDataFrame([], QUERY_EVENT)
    rows = spark.read.schema(QUERY_EVENT).option("mode", "DROPMALFORMED").json(there)
    return rows.orderBy(F.col("_metadata.file_name"), "ts")  # a log's few days, oldest first


def ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A line-per-event ledger; an absent one is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def log_tail(spark: SparkSession, path: str, most: int = 256 * 1024) -> list[str]:
    """The last whole lines of a log within a number of bytes; a first line that is cut is left out.

    Only these bytes are read, by the driver, as they are few by definition."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    size = fs.getFileStatus(place).getLen()
    start = max(0, size - most)
    stream = fs.open(place)
    try:
        stream.seek(start)
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size - start)))
        cut = start > 0
        if cut:
            stream.seek(start - 1)
            cut = stream.read() != 10
    finally:
        stream.close()
    lines = data.decode("utf-8", "replace").splitlines()
    return lines[1:] if cut else lines


def newest_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Stubs of an archive's conversations, newest first: id, source, workspace and the time of the last
    change.  The texts are never parsed; ``conversation_bodies`` fetches those of chosen stubs."""
    stub = T.StructType([f for f in CONVERSATION.fields if f.name in ("kind", "id", "source", "workspace", "startedAt", "updatedAt")])
    rows = spark.read.schema(stub).json(path).where("kind IS NULL AND id IS NOT NULL")
    return rows.select("id", "source", "workspace", F.coalesce("updatedAt", "startedAt").alias("changed")).orderBy(F.desc_nulls_last("changed"), "id")


def conversation_bodies(spark: SparkSession, path: str, stubs: DataFrame) -> DataFrame:
    """Whole conversations of chosen stubs."""
    return archive(spark, path).join(stubs.select("id"), "id", "left_semi")


def semantic_snapshot(records: DataFrame, vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Notes and syntheses with a vector of length one whose texts redaction leaves alone; equal texts share
    the vector of the smallest id.  records: record_id, role, text; vectors: record_id, vector."""
    from quarry.functions.redaction import redacted

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = records.where(F.col("role").isin("note", "synthesis") & (redacted(F.col("text")) == F.col("text"))).join(vectors, "record_id").where(F.abs(norm - 1) <= tolerance)
    key = F.sha2("text", 256)
    first = rows.groupBy(key.alias("_key")).agg(F.min_by("vector", "record_id").alias("vector"))
    return rows.drop("vector").withColumn("_key", key).join(first, "_key").drop("_key")


PASS_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) pass (start|done): (\S+?)(?: exit (\d+);)?(?: .*)?$"


def pass_log(spark: SparkSession, path: str) -> DataFrame:
    """Start and done lines of a pass log: stamp, kind, lane, code."""
    lines = spark.read.text(path).where(F.col("value").rlike(PASS_LINE))
    part = lambda n: F.regexp_extract("value", PASS_LINE, n)
    return lines.select(F.to_timestamp(part(1)).alias("stamp"), part(2).alias("kind"), part(3).alias("lane"), F.nullif(part(4), F.lit("")).cast("int").alias("code"))
