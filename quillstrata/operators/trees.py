"""Trees given as edge tables, walked level by level: one join of the last level with the edges each."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.sources.lineage import cut


def effective_edges(arcs: DataFrame) -> DataFrame:
    """tree, parent, child, place, label: of arcs (the same, priority int, prohibited boolean) that say the same, the greatest priority decides.

    A prohibiting arc takes away those of its own priority and below. Arcs are the same if tree, parent, child and place are.
    """
    key = ("tree", "parent", "child", "place")
    best = arcs.groupBy(*key).agg(F.max(F.struct(F.coalesce("priority", F.lit(0)).alias("p"), F.coalesce("prohibited", F.lit(False)).alias("no"), "label")).alias("x"))
    return best.where("NOT x.no").select(*key, "x.label")


def walk_trees(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """tree, node, depth (0 for a root), path, labels, places (arrays from the root on), cycle; one row a way down to a node.

    edges: tree, parent, child, place (double, orders siblings), label (of the child at this place, or null). labels: node,
    label, what a root is called, and a child without a label of its own. A root is no child in its tree; a tree that is
    one ring has none and gives no rows. A way that comes back to one of its own nodes ends there, with cycle true.
    """
    children = edges.select("tree", F.col("child").alias("node")).distinct()
    roots = edges.select("tree", F.col("parent").alias("node")).distinct().join(children, ["tree", "node"], "left_anti")
    if labels is not None:
        named = labels.groupBy("node").agg(F.min("label").alias("known"))
        edges = edges.join(named.withColumnRenamed("node", "child"), "child", "left").withColumn("label", F.coalesce("label", "known")).drop("known")
        roots = roots.join(named, "node", "left").withColumnRenamed("known", "label")
    else:
        roots = roots.withColumn("label", F.lit(None).cast("string"))
    edges = edges.select("tree", F.col("parent").alias("node"), "child", F.col("place").cast("double").alias("place"), F.col("label").alias("child_label"))
    level = cut(roots.select("tree", "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.array("label").alias("labels"), F.array().cast("array<double>").alias("places"), F.lit(False).alias("cycle")))
    levels = [level]
    while True:
        below = level.where("NOT cycle").join(edges, ["tree", "node"]).select(
            "tree", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path"), F.array_append("labels", F.col("child_label")).alias("labels"),
            F.array_append("places", F.col("place")).alias("places"), F.array_contains("path", F.col("child")).alias("cycle"),
        )
        level = cut(below)
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, levels)
        levels.append(level)
