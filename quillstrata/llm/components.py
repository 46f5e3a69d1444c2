"""Connected components by label propagation with pointer jumping, every round cut at the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) for every node of edges (a, b); self-links and repeats do no harm.

    A round takes the least label among neighbours (a partial aggregate, so that a hub's links shrink before the
    shuffle), then the label of the label. Rounds grow with the logarithm of a component's width on the graphs met here.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(low.join(up, "root").select("node", "old", F.least("root", "above").alias("root")))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
