"""Retrieval metrics: per query, per evidence group, and summaries by method and by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def first_ranks(hits: DataFrame) -> DataFrame:
    """method, query_id, target, rank: a target's first occurrence, ranks compacted."""
    once = hits.groupBy("method", "query_id", "target").agg(F.min("rank").alias("r"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("method", "query_id").orderBy("r"))).drop("r")


def ranking_metrics(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """hits: method, query_id, target, rank. qrels: query_id, target. One row a method and query that has qrels."""
    wanted = qrels.select("query_id", "target").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("relevant_count"))
    asked = hits.select("method", "query_id").distinct().join(sizes, "query_id")
    found = first_ranks(hits).join(wanted, ["query_id", "target"])
    best = found.groupBy("method", "query_id").agg(F.min("rank").alias("first_relevant_rank"), *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"n{k}") for k in CUTS))
    rows = asked.join(best, ["method", "query_id"], "left")
    n = lambda k: F.coalesce(F.col(f"n{k}"), F.lit(0))
    return rows.select(
        "method", "query_id", "relevant_count", "first_relevant_rank",
        *((n(k) > 0).cast("int").alias(f"hit_at_{k}") for k in CUTS), *((n(k) / F.col("relevant_count")).alias(f"recall_at_{k}") for k in CUTS),
        F.when(F.col("first_relevant_rank") <= 10, F.lit(1.0) / F.col("first_relevant_rank")).otherwise(0.0).alias("reciprocal_rank_at_10"),
    )


def group_metrics(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: query_id, entity, target. group_recall_at_k and complete_group_hit_at_k of each method and query."""
    wanted = groups.select("query_id", "entity", "target").distinct()
    asked = hits.select("method", "query_id").distinct()
    best = first_ranks(hits).join(wanted, ["query_id", "target"]).groupBy("method", "query_id", "entity").agg(F.min("rank").alias("rank"))
    rows = asked.join(wanted.select("query_id", "entity").distinct(), "query_id").join(best, ["method", "query_id", "entity"], "left")
    hit = lambda k: F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    return rows.groupBy("method", "query_id").agg(*(F.avg(hit(k)).alias(f"group_recall_at_{k}") for k in CUTS), *(F.min(hit(k)).alias(f"complete_group_hit_at_{k}") for k in CUTS))


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    means = [F.round(F.avg(c), 9).alias(c) for k in CUTS for c in (f"hit_at_{k}", f"recall_at_{k}")]
    return metrics.groupBy(*(by or ("method",))).agg(F.count("*").alias("query_count"), *means, F.round(F.avg("reciprocal_rank_at_10"), 9).alias("mrr_at_10"))


def grouped_report(metrics: DataFrame, *dims: str) -> DataFrame:
    """Overall per method and by each of dims, in one pass."""
    sets = [[F.col("method")], *([F.col("method"), F.col(d)] for d in dims)]
    return metrics.groupingSets(sets, "method", *dims).agg(F.count("*").alias("query_count"), F.round(F.avg("hit_at_10"), 9).alias("hit_at_10"), F.round(F.avg("reciprocal_rank_at_10"), 9).alias("mrr_at_10"))


def parent_diversity(hits: DataFrame, top: int = 10) -> DataFrame:
    """hits: method, query_id, rank, parent. Distinct parents and most siblings among the top rows."""
    counts = hits.where(F.col("rank") <= top).groupBy("method", "query_id", "parent").agg(F.count("*").alias("n"))
    return counts.groupBy("method", "query_id").agg(F.count("*").alias("unique_parents"), F.max("n").alias("max_siblings"))
