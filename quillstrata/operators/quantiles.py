"""Exact quantiles of groups of any size: histograms narrow down where a rank lies, no group is sorted in one task.

A round counts each group's values in BINS equal slices of the range that still holds its rank (a partial aggregate), and
keeps the slice with it. Where few rows of a group are left, they are ranked themselves; a slice of equal values is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.sources.lineage import cut

BINS = 1_024
#: Rows of a group that may be ranked in one task.
FEW = 4_096
#: Ranges (of groups and ranks) that may be sent to every task.
MOST_RANGES = 50_000


def _counted(ranges: DataFrame) -> DataFrame:
    """ranges, sent to every task if they are few: then a hot group's rows stay where they are."""
    return F.broadcast(ranges) if ranges.count() <= MOST_RANGES else ranges


def rank_values(rows: DataFrame, group: str, value: str, ranks: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """group, rank, value: the value at each rank (0 for the least) among a group's non-null values.

    ranks: group, rank. Ranks beyond a group's values have none. value: a number; it is compared as a double.
    """
    data = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    sizes = data.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    asked = ranks.select(F.col(group).alias("k"), "rank").distinct()
    open_ = cut(asked.join(sizes, F.col("k").eqNullSafe(F.col("g"))).where("rank >= 0 AND rank < n").select("g", "rank", F.col("rank").alias("left"), "lo", "hi", "n"))
    done = []
    key = lambda t: F.struct("g").alias(t)  # noqa: E731 nulls are a group
    while True:
        done.append(open_.where("lo = hi").select("g", "rank", F.col("lo").alias("x")))
        # Few rows left: rank them.
        small = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= few))
        inside = data.withColumn("kg", key("kg")).join(_counted(small.select(key("kg"), "rank", "left", "lo", "hi")), "kg").where("x BETWEEN lo AND hi")
        at = F.row_number().over(Window.partitionBy("kg", "rank").orderBy("x")) - 1
        done.append(inside.withColumn("at", at).where("at = left").select(F.col("kg.g").alias("g"), "rank", "x"))
        wide = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        if not wide.limit(1).count():
            break
        # The slice of a value; the last one takes the upper end.
        ranges = wide.select(key("kg"), "lo", "hi").distinct()
        slice_ = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = data.withColumn("kg", key("kg")).join(_counted(ranges), "kg").where("x BETWEEN lo AND hi").groupBy("kg", "lo", "hi", slice_.alias("s")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = F.sum("c").over(Window.partitionBy("kg", "lo", "hi").orderBy("s")) - F.col("c")
        placed = cut(counts.withColumn("before", before))
        asked = wide.select(key("kg"), "rank", "left", "lo", "hi")
        open_ = cut(asked.join(placed, ["kg", "lo", "hi"]).where("left >= before AND left < before + c").select(F.col("kg.g").alias("g"), "rank", (F.col("left") - F.col("before")).alias("left"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("c").alias("n")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group), "rank", F.col("x").alias(value))


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """group, share, quantile: by linear interpolation between the two nearest ranks, as percentile() says."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("__qs_n"))
    at = n.select(group, F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"), "__qs_n").withColumn("__qs_at", F.col("share") * (F.col("__qs_n") - 1))
    # A row for either rank, with its part in the result.
    upper = F.col("__qs_at") - F.floor("__qs_at")
    ends = F.array(F.struct(F.floor("__qs_at").alias("rank"), (1 - upper).alias("part")), F.struct(F.ceil("__qs_at").alias("rank"), upper.alias("part")))
    places = cut(at.select(group, "share", F.explode(ends).alias("e")).select(group, "share", "e.rank", "e.part"))
    found = rank_values(rows, group, value, places, bins, few).select(F.col(group).alias("__qs_g"), F.col("rank").alias("__qs_r"), F.col(value).alias("__qs_x"))
    return places.join(found, F.col(group).eqNullSafe(F.col("__qs_g")) & (F.col("rank") == F.col("__qs_r"))).groupBy(group, "share").agg(F.sum(F.col("part") * F.col("__qs_x")).alias("quantile"))
