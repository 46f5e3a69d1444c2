"""Scans over an order of all rows without a task that sees them all: partition totals are scanned, rows add their own.

prefix_sums numbers rows and adds flags up along an order. scanned_runs cuts an ordered stream of texts into runs under a
token bound: where a run ends depends on where it began, so each block of rows tells, for every place at which it could be
entered, where it would be left; such functions of blocks are composed by doubling, and what is entered is known at last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.sources.lineage import cut

#: Rows of a block.
BLOCK = 256


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of sums: the sum of its value (int, null as 0) over all earlier rows and the row's own.

    order must tell rows apart, or rows that agree in it come in any order. One row a partition reaches the driver.
    """
    flagged = rows.withColumns({f"__qs_{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in sums.items()})
    sorted_ = cut(flagged.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__qs_part", F.spark_partition_id())
    totals = sorted_.groupBy("__qs_part").agg(*(F.sum(f"__qs_{name}").alias(name) for name in sums)).orderBy("__qs_part").collect()
    before, at = {}, dict.fromkeys(sums, 0)
    for r in totals:
        before[r["__qs_part"]] = dict(at)
        for name in sums:
            at[name] += r[name]
    kept, names = rows.columns, list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = held or dict(before[b.column("__qs_part")[0].as_py()])
            new = []
            for name in names:
                along = held[name] + np.cumsum(b.column(f"__qs_{name}").to_numpy())
                held[name] = int(along[-1])
                new.append(pa.array(along, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], [*kept, *names])

    return sorted_.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(name, T.LongType()) for name in sums)]))


def run_end(texts: list[str], segments: list, first: int, count: Callable[[str], int], target: int, most: int) -> int | None:
    """Where the run that begins at first ends: before most tokens, at target tokens or with its segment; None: not within texts."""
    for i in range(first, len(texts)):
        if segments[i] != segments[first]:
            return i
        tokens = count("\n\n".join(texts[first : i + 1]))
        if i > first and tokens > most:
            return i
        if tokens >= target:
            return i + 1
    return None


def _ways(texts: list[str], segments: list, begin: int, own: int, whole: bool, count, target: int, most: int) -> Iterator[tuple[int | None, int | None, bool, list[tuple[int, int]]]]:
    """(entry or None, exit or None, whether it stays open, runs) of a block: its rows are begin to own, later rows follow it.

    Entry None: the runs from the places that begin a segment, which are known. Other ways: as if a run began at entry,
    up to the first known beginning. Exit: the first beginning behind the block that hangs on this way.
    """
    known = [i for i in range(begin, own) if i == 0 or segments[i] != segments[i - 1]]
    ends: dict[int, int | None] = {}

    def follow(i: int, until: int) -> tuple[int | None, bool, list[tuple[int, int]]]:
        runs = []
        while i < until:
            if i not in ends:
                ends[i] = run_end(texts, segments, i, count, target, most)
            j = ends[i]
            if j is None:
                if not whole:
                    return None, True, runs
                j = len(texts)
            runs.append((i, j))
            if j >= len(texts) or segments[j] != segments[i]:
                # The segment is over; at the end of what is seen the next row tells, so a way may be left there.
                return (j if j >= len(texts) and not whole else None), False, runs
            i = j
        return i, False, runs

    for k in known:
        yield None, *follow(k, own)
    for i in range(begin, known[0] if known else own):
        yield i, *follow(i, own)


def scanned_runs(rows: DataFrame, doc: str, place: str, closes: Column, kept: Column, count: Callable[[str], int], target: int, most: int, *carried: str, block: int = BLOCK) -> DataFrame:
    """rows: doc, place, content, carried. doc, number (of the run in its doc, from 0) and items (array of structs place,
    content, carried), one row a run, as folds.segment_runs cuts them.

    A row of closes begins a segment; only rows of kept enter runs; null flags count as false. No task holds more than a few
    blocks of rows, whatever a document's or a segment's length: a run that no few blocks end widens them for all.
    """
    flags = rows.withColumns({"__qs_k": F.coalesce(kept, F.lit(False)), "__qs_c": F.coalesce(closes, F.lit(False))})
    order = [F.col(doc), F.col(place), F.col("content")]
    summed = prefix_sums(flags.select(doc, place, "content", *carried, "__qs_k", "__qs_c"), order, {"segment": F.col("__qs_c"), "at": F.col("__qs_k")})
    placed = cut(summed.where("__qs_k").withColumn("at", F.col("at") - 1).drop("__qs_k", "__qs_c"))
    total = placed.count()
    seg = F.struct(F.col(doc).alias("d"), "segment")
    own = F.floor(F.col("at") / block)
    schema = "entry long, exit long, open boolean, runs array<struct<start:long,end:long>>"
    ahead = 1
    while True:

        def ways(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("at")
            b, at = int(pdf["block"].iloc[0]), int(pdf["at"].iloc[0])
            names = pdf["seg"].astype(str).tolist()
            whole = at + len(pdf) == total
            begin, end = b * block - at, min(b * block - at + block, len(pdf))
            up = lambda i: None if i is None else i + at
            out = [(up(i), up(j), open_, [{"start": x + at, "end": y + at} for x, y in runs]) for i, j, open_, runs in _ways(pdf["content"].tolist(), names, begin, end, whole, count, target, most)]
            return pd.DataFrame(out, columns=["entry", "exit", "open", "runs"]).astype({"entry": "Int64", "exit": "Int64"})

        # A row goes to its block, to those that look ahead to it, and as the row before to the next one.
        last = F.when(F.col("at") % block == block - 1, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
        to = F.explode(F.array_union(F.sequence(F.greatest(own - ahead, F.lit(0)), own), last))
        dealt = placed.select("at", F.to_json(seg).alias("seg"), "content", to.alias("block")).where(F.col("block") <= F.lit((total - 1) // block))
        found = cut(dealt.groupBy("block").applyInPandas(ways, schema))
        if not found.where("open").limit(1).count():
            break
        ahead *= 2
    # Ways that are entered: those that known ones lead to, and what these lead to; jumps double.
    reach = cut(found.where("entry IS NULL AND exit IS NOT NULL").select(F.col("exit").alias("entry")).distinct())
    jump = found.where("entry IS NOT NULL AND exit IS NOT NULL").select("entry", "exit")
    while True:
        further = reach.join(jump, "entry").select(F.col("exit").alias("entry")).distinct()
        grown = cut(reach.union(further).distinct())
        if grown.count() == reach.count():
            break
        reach = grown
        jump = cut(jump.join(jump.select(F.col("entry").alias("exit"), F.col("exit").alias("beyond")), "exit").select("entry", F.col("beyond").alias("exit")))
    runs = found.where("entry IS NULL").select("runs").unionByName(found.where("entry IS NOT NULL").join(reach, "entry", "left_semi").select("runs")).select(F.explode("runs").alias("r")).select("r.start", "r.end").distinct()
    members = runs.select("start", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
    made = placed.join(members, "at").groupBy(doc, "start").agg(F.sort_array(F.collect_list(F.struct(place, "content", *carried))).alias("items"))
    counted = prefix_sums(made, [F.col("start")], {"__qs_run": F.lit(1)})
    firsts = counted.groupBy(F.col(doc).alias("__qs_doc")).agg(F.min("__qs_run").alias("__qs_first"))
    return counted.join(firsts, F.col(doc).eqNullSafe(F.col("__qs_doc"))).select(doc, (F.col("__qs_run") - F.col("__qs_first")).alias("number"), "items")
