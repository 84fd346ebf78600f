"""Intermediate tables in the cluster's shared folder.

Iterative operators cut their lineage by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs the reread of a few files.  The setting is read from the session and a folder of
our own is named only where it is unset, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-shared-')}"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


class Store:
    """Tables of one operator run; removed when the driver's JVM ends, or earlier with ``drop``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.paths: dict[int, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return its reader."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))), True)
