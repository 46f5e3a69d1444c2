"""Stateful cuts under a token bound: runs of an ordered element stream and bounded parts of texts.

The injected tokenizer is a Python function, so these are Arrow UDFs; what they see is one segment or one text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions.text import is_heading_start
from quillstrata.operators.records import MOST, OVERLAP, TARGET, split_tokens, word_tokens
from quillstrata.operators.scans import scanned_runs

Counter = Callable[[str], int]


def counted(count: Counter):
    """The injected tokenizer as an Arrow UDF: of a batch, one text at a time is a Python object."""

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array((count(t.as_py() or "") for t in texts), pa.int64())

    # Marked so that no rule copies it into several filters.
    return tokens.asNondeterministic()


def _listed(texts: pa.ListScalar) -> list[str]:
    return list(texts.values.to_numpy(zero_copy_only=False))


def bounded_parts(count: Counter, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP):
    """split_tokens as an Arrow UDF of (text, sentence units)."""

    @F.arrow_udf("array<string>")
    def parts(texts: pa.Array, units: pa.Array) -> pa.Array:
        return pa.array((split_tokens(t.as_py() or "", _listed(u), count, target, most, overlap) for t, u in zip(texts, units, strict=True)), pa.list_(pa.string()))

    return parts


def fold_runs(count: Counter, target: int = TARGET, most: int = MOST):
    """Arrow UDF from a segment's texts to its runs (first: 1-based place, n): a run ends at target tokens or before most."""

    def runs(texts: list[str]) -> list[dict[str, int]]:
        out, first = [], 0
        for i in range(len(texts)):
            if i > first and count("\n\n".join(texts[first : i + 1])) > most:
                out.append((first, i))
                first = i
            if count("\n\n".join(texts[first : i + 1])) >= target:
                out.append((first, i + 1))
                first = i + 1
        if first < len(texts):
            out.append((first, len(texts)))
        return [{"first": a + 1, "n": b - a} for a, b in out]

    @F.arrow_udf("array<struct<first:int,n:int>>")
    def fold(segments: pa.Array) -> pa.Array:
        return pa.array((runs(_listed(s)) for s in segments), pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))

    return fold


def segment_runs(rows: DataFrame, doc: str, place: str, closes: Column, kept: Column, fold, *carried: str) -> DataFrame:
    """rows: doc, place, content, carried. doc and items (array of structs place, content, carried), one row a run.

    A row of closes starts a segment; only rows of kept enter runs. Null flags count as false.
    """
    order = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("__qs_segment", F.sum(F.coalesce(closes, F.lit(False)).cast("int")).over(order)).where(kept)
    whole = marked.groupBy(doc, "__qs_segment").agg(F.sort_array(F.collect_list(F.struct(place, "content", *carried))).alias("__qs_items"))
    cut = whole.select(doc, "__qs_items", F.explode(fold(F.col("__qs_items.content"))).alias("__qs_run"))
    return cut.select(doc, F.slice("__qs_items", F.col("__qs_run.first"), F.col("__qs_run.n")).alias("items"))


def narrative_fold(elements: DataFrame, count: Counter = word_tokens, target: int = TARGET, most: int = MOST, block: int | None = None) -> DataFrame:
    """elements: doc, place, kind, content. doc, narrative, first, last, content: runs closed by headings, size and tables.

    Blank texts are left out, null kinds are texts. Elements of one place are ordered by content. block: fold by a scan over
    blocks of so many rows, which no document is too long for; without it a segment's texts meet in one call.
    """
    rows = elements.select("doc", "place", (F.coalesce("kind", F.lit("text")) == "table").alias("table"), F.trim(F.coalesce("content", F.lit(""))).alias("content")).where("table or content <> ''")
    closes, kept = F.col("table") | is_heading_start(F.col("content")), ~F.col("table")
    ends = (F.col("items")[0]["place"].alias("first"), F.element_at("items", -1)["place"].alias("last"), F.array_join("items.content", "\n\n").alias("content"))
    if block is not None:
        return scanned_runs(rows, "doc", "place", closes, kept, count, target, most, block=block).select("doc", F.col("number").cast("int").alias("narrative"), *ends)
    runs = segment_runs(rows, "doc", "place", closes, kept, fold_runs(count, target, most))
    order = Window.partitionBy("doc").orderBy(F.col("items")[0]["place"], F.col("items")[0]["content"])
    return runs.select("doc", (F.row_number().over(order) - 1).alias("narrative"), *ends)
