"""Connected components by hooking, pointer jumping and edge contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _relabel(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    to = hooks.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    return df.join(to, F.col(column) == F.col("_hi"), "left").withColumn(column, F.coalesce("_lo", column)).drop("_hi", "_lo")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable over edges ``a``, ``b``.

    Every round is checkpointed to the shared folder, so a lost executor costs one round."""
    from quarry.sources.shared import shared_dir

    edges.sparkSession.sparkContext.setCheckpointDir(shared_dir(edges.sparkSession))
    live = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().checkpoint()
    labels = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node"))
    live = live.where("hi <> lo")
    while not live.isEmpty():
        hooks = live.groupBy("hi").agg(F.min("lo").alias("lo")).checkpoint()
        while True:
            up = hooks.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
            if hooks.join(up, hooks["lo"] == up["mid"], "left_semi").isEmpty():
                break
            hooks = hooks.join(up, hooks["lo"] == up["mid"], "left").select("hi", F.coalesce("top", "lo").alias("lo")).checkpoint()
        labels = _relabel(labels, "component", hooks)
        moved = _relabel(_relabel(live, "hi", hooks), "lo", hooks).where("hi <> lo")
        live = moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct().checkpoint()
    return labels
