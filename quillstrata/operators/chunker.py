"""The element chunker: filings' elements to text chunks under a token bound and to table parts under their headers.

elements: accession_number, order_index, element_type (paragraph, list, heading, table), text, is_navigation, sec_item,
section_title, and the filing's ticker, cik, filing_date, report_date, source_url. Text elements in a row that share item
and section are one group; navigation and tables end it. Only a group's texts, or one table, meet in a Python function.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions import elements as E
from quillstrata.operators import locators, proxies
from quillstrata.operators.folds import Counter, counted
from quillstrata.operators.records import islands, word_tokens

TARGET, MOST, LEAST, OVERLAP = 600, 700, 80, 80
#: Separators from the widest to the narrowest; the last cuts anywhere.
LADDER = ("\n\n", "\n", r"(?<=[.!?])\s+", "; ", ", ", " ", "")
FILING = ("ticker", "cik", "accession_number", "filing_date", "report_date", "source_url")


def _pieces(text: str, separator: str) -> list[str]:
    """The parts of a text, each with the separator that ends it."""
    if not separator:
        return list(text)
    ends = [m.end() for m in re.finditer(separator, text) if m.end() > m.start()]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if b > a]


def _joined(pieces: list[str], size: Callable[[str], int], target: int, overlap: int) -> list[str]:
    """Pieces side by side, up to target; the next part begins with the last pieces that fit overlap."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces:
        n = size(piece)
        if held and total + n > target:
            out.append("".join(p for p, _ in held).strip())
            while held and (total > overlap or total + n > target):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    if held:
        out.append("".join(p for p, _ in held).strip())
    return [x for x in out if x]


def recursive_parts(text: str, size: Callable[[str], int], target: int = TARGET, overlap: int = OVERLAP, ladder: tuple[str, ...] = LADDER) -> list[str]:
    """Parts of about target tokens, cut at the widest separator of the ladder that occurs; larger pieces go on down it."""
    at = next((i for i, s in enumerate(ladder) if not s or re.search(s, text)), len(ladder) - 1)
    below = ladder[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, ladder[at]):
        if size(piece) < target:
            small.append(piece)
            continue
        out += _joined(small, size, target, overlap)
        small = []
        out += recursive_parts(piece, size, target, overlap, below) if below else [piece]
    return out + _joined(small, size, target, overlap)


def bounded(text: str, size: Callable[[str], int], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """The text itself, if it has at most most tokens, or its parts."""
    plain = text.strip()
    return [plain] if size(plain) <= most else [p.strip() for p in recursive_parts(plain, size, target, overlap) if p.strip()]


def packed(texts: list[str], places: list[int], size: Callable[[str], int], target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(text, first place, last place): parts packed one after another, while below target and not beyond most.

    A chunk of fewer than least tokens joins the chunk before it, if the two fit most.
    """
    out: list[tuple[str, int, int]] = []
    open_: tuple[str, int, int] | None = None

    def close(chunk: tuple[str, int, int]) -> None:
        if out and size(chunk[0]) < least:
            both = f"{out[-1][0]}\n\n{chunk[0]}"
            if size(both) <= most:
                out[-1] = (both, out[-1][1], chunk[2])
                return
        out.append(chunk)

    for text, place in zip(texts, places, strict=True):
        for part in bounded(text, size, target, most, overlap):
            if open_ is not None and size(open_[0]) < target and size(f"{open_[0]}\n\n{part}") <= most:
                open_ = (f"{open_[0]}\n\n{part}", open_[1], place)
                continue
            if open_ is not None:
                close(open_)
            open_ = (part, place, place)
    if open_ is not None:
        close(open_)
    return out


def packing(count: Counter):
    """packed() as a pandas UDF of (texts, places)."""

    @F.pandas_udf("array<struct<text:string,order_start:long,order_end:long>>")
    def run(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "order_start": a, "order_end": b} for t, a, b in packed(list(x), [int(i) for i in p], count)] for x, p in zip(texts, places, strict=True)])

    return run


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")


def _text_chunks(elements: DataFrame, count: Counter, *same: str) -> DataFrame:
    barrier = F.coalesce(F.col("is_navigation"), F.lit(False)) | (F.col("element_type") == "table")
    order = Window.partitionBy("accession_number").orderBy("order_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = elements.withColumn("__qs_barrier", barrier).withColumn("__qs_after", F.sum(F.col("__qs_barrier").cast("int")).over(order)).where("not __qs_barrier")
    runs = islands(marked, "accession_number", "order_index", "__qs_after", *same)
    first = F.min_by(F.struct(*FILING, "sec_item", "section_title"), "order_index").alias("about")
    groups = runs.groupBy("accession_number", "island").agg(F.sort_array(F.collect_list(F.struct("order_index", F.coalesce("text", F.lit("")).alias("text")))).alias("x"), first)
    chunks = groups.select("about", F.posexplode(packing(count)(F.col("x.text"), F.col("x.order_index"))).alias("part", "c"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return chunks.select("about.*", F.lit("text").alias("element_type"), "c.order_start", "c.order_end", "part", "c.text", none("table_id", "string"), none("table_part_index", "int"), none("table_part_count", "int"), none("table_header", "string"), none("table_context", "string"))


def _table_chunks(elements: DataFrame, count: Counter, single_header: bool) -> DataFrame:
    seen = elements.select(F.col("accession_number").alias("doc"), F.col("order_index").alias("place"), F.col("element_type").alias("kind"), "text", F.col("sec_item").alias("item"), F.col("section_title").alias("section"), F.col("is_navigation").alias("navigation"))
    said = locators.introductions(seen).select(F.col("doc").alias("accession_number"), F.col("place").alias("order_index"), "introduction")
    tables = elements.where((F.col("element_type") == "table") & ~F.coalesce(F.col("is_navigation"), F.lit(False))).join(said, ["accession_number", "order_index"], "left")
    head = F.slice(_lines(F.col("text")), 1, 1) if single_header else locators.header_rows(F.col("text"))
    rows = tables.withColumns({"lines": _lines(F.col("text")), "head": head})
    rows = rows.withColumn("table_header", F.nullif(F.array_join("head", "\n"), F.lit("")))
    body = F.slice("lines", F.size("head") + 1, F.greatest(F.size("lines"), F.lit(1)))
    whole = F.array_join("lines", "\n")
    # A table that fits stays whole, one that does not is dealt to parts under its header.
    split = F.when(counted(count)(whole) <= MOST, F.array(whole)).otherwise(locators.table_parts(count, MOST)(F.coalesce("table_header", F.lit("")), body))
    parts = rows.withColumn("parts", split)
    context = E.table_context(F.col("section_title"), F.col("table_header"), F.col("introduction"))
    return parts.withColumn("table_context", F.lit(None).cast("string") if single_header else context).select(
        *FILING, "sec_item", "section_title", F.lit("table").alias("element_type"), F.col("order_index").alias("order_start"), F.col("order_index").alias("order_end"), F.posexplode("parts").alias("part", "text"),
        proxies.builtin_table_id(F.col("accession_number"), F.col("source_url"), F.col("order_index")).alias("table_id"), F.size("parts").alias("table_part_count"), "table_header", "table_context",
    ).withColumn("table_part_index", F.col("part")).where("text <> ''")


def chunk_elements(elements: DataFrame, count: Counter = word_tokens, by_item_only: bool = False) -> DataFrame:
    """The chunks of filings in order, with chunk_index, chunk_id and token_count.

    by_item_only: the older generation, where sections don't end a group, a table's first line alone is its header, and
    tables have neither context, header nor id.
    """
    texts = _text_chunks(elements, count, "sec_item", *(() if by_item_only else ("section_title",)))
    both = texts.unionByName(_table_chunks(elements, count, by_item_only))
    order = Window.partitionBy("accession_number").orderBy("order_start", "part", "order_end")
    rows = both.withColumn("chunk_index", F.row_number().over(order) - 1).drop("part")
    rows = rows.withColumns({"chunk_id": proxies.builtin_chunk_id(F.col("accession_number"), F.col("chunk_index"), F.col("text")), "token_count": counted(count)(F.col("text"))})
    return rows.drop("section_title", "table_id", "table_part_index", "table_part_count", "table_header", "table_context") if by_item_only else rows


def chunk_violations(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (rule, key): empty chunks and those of more than most tokens."""
    rules = F.array(F.when(F.coalesce(F.trim("text") == "", F.lit(True)), "empty chunk"), F.when(F.col("token_count") > most, "too many tokens"))
    return chunks.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), F.col("chunk_id").alias("key"))
