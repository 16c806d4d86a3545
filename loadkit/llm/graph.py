"""Tables kept in the shared folder, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadkit.session import scratch_path


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids sent to all executors at once (8 MB); more go by a shuffled join.
BROADCAST_IDS = 1_000_000


def some_ids(ids: DataFrame) -> DataFrame:
    """A table of ids to join with: marked for broadcast if its counted size allows."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return F.broadcast(ids) if few else ids


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then
    that label's own label, so chains halve.  A hot node's edges are split by
    the adaptive skew join, and the minimum is pre-aggregated.  Rounds end
    when no label changes.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), "cc-edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                  .select("node", F.least("least", "node").alias("component")), "cc-labels")
    while True:
        near = (both.join(labels, both.b == labels.node)
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        pulled = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("hook"))
        jump = labels.select(F.col("node").alias("hook"), F.col("component").alias("far"))
        step = kept(pulled.join(jump, "hook").select(
            "node", F.col("component").alias("old"), F.least("hook", "far").alias("component")), "cc-labels")
        changed = step.filter("component != old").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
