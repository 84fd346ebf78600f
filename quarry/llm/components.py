"""Connected components by hooking, pointer jumping and edge contraction, all in DataFrames.

Every round hooks each root to its smallest neighbouring root, flattens the hooks by pointer jumping
and contracts the edges, so stars take one round and paths a logarithmic number.  Nothing is
collected; each round is a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import Store


def _relabel(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    to = hooks.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    return df.join(to, F.col(column) == F.col("_hi"), "left").withColumn(column, F.coalesce("_lo", column)).drop("_hi", "_lo")


def connected_components(store: Store, edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (columns ``a`` and ``b``).

    Returns ``node``, ``component``.  Self loops give a node its own component; null ends are
    ignored; repeated edges count once; no edges give no rows.
    """
    edges = store.put(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    labels = store.put(edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    live = store.put(edges.where("hi <> lo"), "live")
    while not live.isEmpty():
        hooks = store.put(live.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        while True:
            up = hooks.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
            if hooks.join(up, hooks["lo"] == up["mid"], "left_semi").isEmpty():
                break
            hooks = store.put(hooks.join(up, hooks["lo"] == up["mid"], "left").select("hi", F.coalesce("top", "lo").alias("lo")), "hooks")
        labels = store.put(_relabel(labels, "component", hooks), "labels")
        moved = _relabel(_relabel(live, "hi", hooks), "lo", hooks).where("hi <> lo")
        live = store.put(moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "live")
    return labels
