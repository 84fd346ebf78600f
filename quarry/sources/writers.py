"""Writers: replacement by key, guarded vectors, ledgers, published documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import reconcile
from quarry.sources.shared import shared_dir


def _files(spark: SparkSession, path: str):
    """Hadoop's path class and the file system of a path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    return jpath, jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> str | None:
    """Finish or undo a swap that ended between its two renames; says which, if there was one.

    A whole new table beside a missing one takes its place, else the old one comes back.  What a swap
    left behind goes."""
    jpath, fs = _files(spark, path)
    home = jpath(path)
    left = [f.getPath() for f in fs.globStatus(jpath(f"{path}.swap-*")) or []]
    done = None
    if not fs.exists(home):
        whole = [p for p in left if str(p).endswith(".new") and fs.exists(jpath(f"{p}/_SUCCESS"))]
        old = [p for p in left if str(p).endswith(".old")]
        for found, name in ((whole, "finished"), (old, "undone")):
            if found and done is None:
                fs.rename(found[0], home)
                done = name
    for p in left:
        if fs.exists(p):
            fs.delete(p, True)
    return done


def _swap(df: DataFrame, path: str) -> None:
    """Write beside a table and rename into its place.

    Directories cannot be replaced in one step: a reader that comes between the two renames finds no table,
    and a writer that dies there leaves it so until ``recover``, which every writer here calls first."""
    spark = df.sparkSession
    jpath, fs = _files(spark, path)
    mark = uuid.uuid4().hex
    staged, old = f"{path}.swap-{mark}.new", f"{path}.swap-{mark}.old"
    df.write.parquet(staged)
    if fs.exists(jpath(path)):
        fs.rename(jpath(path), jpath(old))
    fs.rename(jpath(staged), jpath(path))
    if fs.exists(jpath(old)):
        fs.delete(jpath(old), True)


def replace_by_key(path: str, arriving: DataFrame, key: str, digest: str, group: str, full: bool = True) -> DataFrame:
    """Ingest into a table: unchanged keys keep their rows, changed keys get theirs, absent keys of a
    full ingest go.  Returns the actions.  If all keys keep their rows, the table is left alone.

    The actions are written before the table changes, so that they never depend on what it was."""
    spark = arriving.sparkSession
    recover(spark, path)
    stored = spark.read.parquet(path)
    actions = reconcile.ingest_actions(stored.select(key, digest, group).distinct(), arriving.select(key, digest, group).distinct(), key, digest, group, full)
    kept = f"{shared_dir(spark)}/actions-{uuid.uuid4().hex}"
    actions.write.parquet(kept)
    actions = spark.read.schema(actions.schema).parquet(kept)
    if not actions.where("action IN ('write', 'sweep')").isEmpty():
        _swap(reconcile.replaced(stored, arriving, actions, key), path)
    return actions


def publish_json(spark: SparkSession, path: str, document: dict) -> None:
    """Publish one small document: readers find the old or the new one, whole.  A file, unlike a folder,
    is replaced in one step."""
    jpath, fs = _files(spark, path)
    staged = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(jpath(staged), True)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    out.hsync() if hasattr(out, "hsync") else out.flush()
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    mode = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = mode
    context.rename(jpath(staged), jpath(path), options)


def write_metadata(path: str, arriving: DataFrame, key: str, value: str) -> DataFrame:
    """Bring a metadata table to what arrives: differing values are written, unknown ones deleted, keys that
    do not arrive stay.  Returns the actions; without any the table is left alone."""
    spark = arriving.sparkSession
    recover(spark, path)
    stored = spark.read.parquet(path)
    actions = reconcile.metadata_upserts(stored, arriving, key, value)
    kept = f"{shared_dir(spark)}/actions-{uuid.uuid4().hex}"
    actions.write.parquet(kept)
    actions = spark.read.schema(actions.schema).parquet(kept)
    if not actions.isEmpty():
        fresh = arriving.join(actions.where("action = 'write'").select(key), key, "left_semi").select(stored.columns)
        _swap(stored.join(actions.select(key), key, "left_anti").unionByName(fresh), path)
    return actions


def append_claims(path: str, claims: DataFrame, key: str) -> None:
    """Append the claims that a ledger of JSON lines does not have; a torn last line counts for nothing, and
    a batch is appended whole or not at all."""
    claims.join(done_keys(claims.sparkSession, path, key), key, "left_anti").write.mode("append").json(path)


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys that a ledger of JSON lines has in whole lines; none if it does not exist."""
    jpath, fs = _files(spark, path)
    if not fs.exists(jpath(path)):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.schema(f"{key} string").option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull()).distinct()


def save_vectors(path: str, vectors: DataFrame, generation: str) -> None:
    """Save a table of vectors under the generation of the records that it was made of."""
    _swap(vectors.withColumn("generation", F.lit(generation)), path)


def load_vectors(spark: SparkSession, path: str, generation: str) -> DataFrame | None:
    """Vectors saved for a generation; none if there are none, or of another generation, or malformed."""
    jpath, fs = _files(spark, path)
    if not fs.exists(jpath(f"{path}/_SUCCESS")):
        return None
    table = spark.read.parquet(path)
    if not {"generation", "vector"} <= set(table.columns) or not table.where(~F.col("generation").eqNullSafe(F.lit(generation))).isEmpty():
        return None
    return table.drop("generation")


def resume_vectors(path: str, texts: DataFrame, id_col: str, embed) -> int:
    """Embed the texts that a table of vectors does not have yet and append them; returns how many.

    embed: a function of a DataFrame (id, text) that gives one with the id and ``vector``."""
    spark = texts.sparkSession
    jpath, fs = _files(spark, path)
    left = texts.join(spark.read.parquet(path).select(id_col), id_col, "left_anti") if fs.exists(jpath(path)) else texts
    n = left.count()
    if n:
        embed(left).select(id_col, "vector").write.mode("append").parquet(path)
    return n


def write_vectors(path: str, vectors: DataFrame, records: DataFrame, id_col: str, revision_col: str) -> None:
    """Append vectors whose record still has the text they were made from."""
    from quarry.operators.dense import current_vectors

    current_vectors(vectors, records, id_col, revision_col).write.mode("append").parquet(path)


def append_new(path: str, rows: DataFrame, key: str, order: str) -> None:
    """Append to a registry of immutable rows: the first writer of a key wins."""
    stored = rows.sparkSession.read.parquet(path)
    reconcile.first_writer_wins(stored, rows, key, order).write.mode("append").parquet(path)


def write_ledger(path: str, rows: DataFrame, key: str) -> None:
    """Lines of JSON in key order; the same rows give the same bytes."""
    ordered = rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("value")).repartitionByRange(key).sortWithinPartitions(key, "value")
    ordered.select("value").write.mode("overwrite").text(path)


def append_daily(path: str, rows: DataFrame, stamp: str) -> None:
    """Append events to their days' folders."""
    rows.withColumn("day", F.to_date(stamp)).write.mode("append").partitionBy("day").json(path)


def erase(path: str, key: str, gone: DataFrame) -> None:
    """Rewrite a table without keys; the old files go with the swap."""
    from quarry.operators.lifecycle import erased

    recover(gone.sparkSession, path)
    _swap(erased(gone.sparkSession.read.parquet(path), key, gone), path)
