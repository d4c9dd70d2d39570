"""Connected components of an edge table by repeated least labels; all joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, steps: int = 100) -> DataFrame:
    """node, root (the least node it reaches). nodes(node), edges(a, b) in either direction.

    Each step takes the least label among a node's neighbours and then that label's own label, so
    long chains shorten fast. The labels of a step are persisted, and cut from their lineage by
    a checkpoint where the session has a folder for them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    lasting = nodes.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    label = nodes.select("node", F.col("node").alias("root"))
    for _ in range(steps):
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        near = label.join(seen, "node", "left").select("node", "root", F.least("root", F.coalesce("least", "root")).alias("new"))
        jump = near.join(label.select(F.col("node").alias("new"), F.col("root").alias("far")), "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("root"), F.col("root").alias("old"))
        jump = jump.checkpoint() if lasting else jump.persist()
        label = jump.select("node", "root")
        if jump.where("root != old").isEmpty():
            break
    return label
