"""Corpus build: pages of filings to text chunks, whole tables and table descriptions, declared as DataFrames.

A narrative run never passes a table, a glossary element or a heading. Elements are cut into segments there, and only a
segment's texts meet in a Python function, so no task holds a whole filing's fold. Everything else is column expressions.

filings: accession_number, ticker, cik, legal_name, filing_date, report_date, source_url, raw_sha256 (strings).
pages: accession_number, number int, display_page int, content, elements array<struct<id, kind, content string,
page_start, page_end int, tags array<string>>>. Pages are in the order of their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators import descriptions
from quillstrata.operators.folds import Counter, bounded_parts, counted, fold_runs, segment_runs
from quillstrata.operators.records import corpus_violations, word_tokens

VERSION = "quillstrata-corpus-1"
# How a glossary is laid out, and the classes of tables that nobody searches.
GLOSSARY_TITLE = r"(?i)^\s*\*\*glossary of terms and acronyms\*\*\s*"
GLOSSARY_ENTRY = r"(\*\*[^*\n]{1,180}\*\*)"
NOT_SEARCHED = ("layout", "index")

FILING = ("ticker", "cik", "accession_number", "filing_date", "report_date", "source_url", "raw_sha256")
SPAN = ("page_start", "page_end", "start_display_page", "end_display_page")


def is_glossary_page(content: Column) -> Column:
    return F.coalesce(content, F.lit("")).rlike(GLOSSARY_TITLE)


def glossary_parts(content: Column) -> Column:
    """Text before the first bold entry (may be blank), then one text an entry, all stripped."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), GLOSSARY_TITLE, "")
    return F.transform(F.split(F.regexp_replace(body, GLOSSARY_ENTRY, "\0$1"), "\0"), X.strip)


def ordered_elements(pages: DataFrame) -> DataFrame:
    """accession_number, element_index (counts all), id, kind, content, tags, page span with display pages, glossary.

    Of elements that share an id the first stays. Spans default to the element's page. Where a page number repeats, its
    greatest display page counts.
    """
    known = pages.groupBy("accession_number", "number").agg(F.max("display_page").alias("display"), F.max(is_glossary_page(F.col("content"))).alias("glossary"))
    # One row a filing: lookups by page then need no further shuffle than the windows by filing.
    maps = known.groupBy("accession_number").agg(F.map_from_entries(F.collect_list(F.struct("number", F.struct("display", "glossary")))).alias("known"))
    flat = pages.select("accession_number", F.col("number").alias("page"), F.posexplode("elements").alias("at", "e"))
    first = flat.groupBy("accession_number", "e.id").agg(F.min_by(F.struct("page", "at", "e"), F.struct("page", "at")).alias("x"))
    place = F.row_number().over(Window.partitionBy("accession_number").orderBy("x.page", "x.at")) - 1
    rows = first.select(
        "accession_number", place.alias("element_index"), F.col("id").cast("string"), F.lower(F.coalesce("x.e.kind", F.lit("text"))).alias("kind"), X.strip(F.coalesce("x.e.content", F.lit(""))).alias("content"),
        F.coalesce("x.e.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("x.e.page_start", "x.page").alias("page_start"), F.coalesce("x.e.page_end", "x.page").alias("page_end"),
    ).join(maps, "accession_number")
    at = lambda c: F.try_element_at("known", F.col(c))
    return rows.withColumns({"start_display_page": at("page_start")["display"], "end_display_page": at("page_end")["display"], "glossary": F.coalesce(at("page_start")["glossary"], F.lit(False)) & (F.col("kind") == "text")}).drop("known")


def _described(rows: DataFrame) -> DataFrame:
    """Adds embedding_text and packs metadata; rows hold the filing's fields and the record's own."""
    item = X.sec_item(F.col("document"))
    rows = rows.withColumns({
        "sec_item": F.concat(F.lit("Item "), item), "sec_item_source": F.when(item.isNull(), "unassigned").otherwise("explicit_heading_in_chunk"), "sec_item_confidence": F.when(item.isNull(), 0.0).otherwise(1.0),
        "xbrl_tags": F.array_sort(F.array_distinct("xbrl_tags")), "chunk_variant": F.lit("structure_aware"), "chunker_version": F.lit(VERSION), "retrieval_eligible": F.lit(True),
    })
    text = X.embedding_text(F.col("ticker"), F.col("legal_name"), F.col("report_date"), F.col("record_type"), F.col("page_start"), F.col("page_end"), F.col("document"), F.col("section_title"))
    kept = (*FILING, *SPAN, "element_ids", "xbrl_tags", "sec_item", "sec_item_source", "sec_item_confidence", "section_title", "chunk_variant", "chunker_version", "retrieval_eligible", "record_type", "text_kind", "table_id", "table_index", "table_type", "description_provenance")
    return rows.select("record_id", "target_chunk_id", "record_type", text.alias("embedding_text"), "document", F.struct(*kept).alias("metadata"))


def _text_chunks(elements: DataFrame, count: Counter) -> DataFrame:
    parts = bounded_parts(count)
    split = lambda c: F.posexplode(parts(F.col(c), X.sentence_units(F.col(c))))
    carried = ("id", "page_start", "page_end", "start_display_page", "end_display_page", "tags")
    table = F.col("kind") == "table"
    runs = segment_runs(elements, "accession_number", "element_index", table | F.col("glossary") | X.is_heading_start(F.col("content")), ~table & ~F.col("glossary"), fold_runs(count), *carried)
    entries = elements.where("glossary").withColumn("parts", glossary_parts(F.col("content")))
    prefix = entries.where(F.col("parts")[0] != "").select("accession_number", F.array(F.struct("element_index", F.col("parts")[0].alias("content"), *carried)).alias("items"))
    place = F.row_number().over(Window.partitionBy("accession_number").orderBy(F.col("items")[0]["element_index"])) - 1
    first = F.array_min(F.transform("items", lambda e: F.struct(e["page_start"].alias("p"), e["start_display_page"].alias("d"))))
    last = F.array_max(F.transform("items", lambda e: F.struct(e["page_end"].alias("p"), e["end_display_page"].alias("d"))))
    stories = runs.unionByName(prefix).select(
        "accession_number", place.alias("story"), F.array_join("items.content", "\n\n").alias("whole"), first["p"].alias("page_start"), last["p"].alias("page_end"),
        first["d"].alias("start_display_page"), last["d"].alias("end_display_page"), F.array_distinct("items.id").alias("element_ids"), F.flatten("items.tags").alias("xbrl_tags"),
    )
    narrative = stories.select("*", split("whole").alias("part", "document")).where(~X.is_navigation(F.col("document")) & ~X.is_page_furniture(F.col("document"))).withColumns({"text_kind": F.lit("narrative"), "child_key": F.concat_ws(":", F.lit("narrative"), "story", "part")})
    named = entries.select("*", F.posexplode(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))).alias("entry", "whole")).where("whole <> ''").select("*", split("whole").alias("part", "document"))
    glossary = named.withColumns({"text_kind": F.lit("glossary"), "element_ids": F.array("id"), "xbrl_tags": F.col("tags"), "child_key": F.concat_ws(":", F.lit("glossary"), "element_index", "entry", "part")})
    kept = ("accession_number", *SPAN, "element_ids", "xbrl_tags", "text_kind", "child_key", X.strip(F.col("document")).alias("document"))
    return narrative.select(*kept).unionByName(glossary.select(*kept))


def _tables(elements: DataFrame, grids: DataFrame | None) -> DataFrame:
    order = Window.partitionBy("accession_number").orderBy("element_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.last(F.when((F.col("kind") != "table") & ~F.col("glossary"), X.section_title(F.col("content"))), ignorenulls=True).over(order)
    rows = elements.withColumn("heading", title).where("kind = 'table'").withColumn("table_index", F.row_number().over(Window.partitionBy("accession_number").orderBy("element_index")) - 1)
    parsed = M.markdown_matrices(F.col("content"))
    if grids is not None:
        rows = rows.join(grids.select("accession_number", "id", "grids"), ["accession_number", "id"], "left")
        parsed = F.when(F.size("grids") > 0, F.transform("grids", lambda m: F.transform(m, lambda r: F.transform(r, X.normalize_space)))).otherwise(parsed)
    rows = rows.withColumns({"cell_matrices": parsed, "section_title": F.coalesce("heading", M.table_title(F.col("content")))})
    made = rows.withColumns({"table_id": X.chunk_id(F.col("accession_number"), "structure_aware_parent", F.concat(F.lit("table-parent:"), F.col("element_index")), F.array("id"), F.col("content")), "table_type": M.table_class(F.col("content"), F.col("cell_matrices"))})
    return made.withColumns({"retrieval_eligible": ~F.col("table_type").isin(*NOT_SEARCHED), "element_ids": F.array("id"), "xbrl_tags": F.col("tags")})


def build_corpus(filings: DataFrame, pages: DataFrame, count: Counter = word_tokens, grids: DataFrame | None = None, synopsis: Callable[[Column, Column], Column] | None = None, describe: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks (record_id, target_chunk_id, record_type, embedding_text, document, metadata) and tables (table_id,
    table_index, table_type, retrieval_eligible, document, cell_matrices, metadata).

    grids: accession_number, id, grids (cells of HTML tables; markdown is parsed where they are absent). synopsis: from a
    table's document and its description to a text that is added to the description. describe: descriptions.described with
    its mode and client bound; what it says replaces the description, and its provenance is in the metadata.
    """
    about = filings.select(*FILING, "legal_name")
    elements = ordered_elements(pages).where("content <> '' or kind = 'table'")
    texts = _text_chunks(elements, count).join(about, "accession_number")
    own = X.chunk_id(F.col("accession_number"), "structure_aware", F.col("child_key"), F.col("element_ids"), F.col("document"))
    nothing = {"table_id": F.lit(None).cast("string"), "table_index": F.lit(None).cast("int"), "table_type": F.lit(None).cast("string"), "description_provenance": F.lit(None).cast(descriptions.PROVENANCE)}
    texts = texts.withColumns({"target_chunk_id": own, "record_type": F.lit("text"), "section_title": X.section_title(F.col("document")), **nothing}).withColumn("record_id", F.concat(F.lit("structure_aware::"), F.col("target_chunk_id")))
    tables = _tables(elements, grids).join(about, "accession_number")
    said = M.table_description(F.col("content"), F.col("cell_matrices"))
    if synopsis is not None:
        said = F.concat(said, F.lit("\nLLM synopsis: "), synopsis(F.col("content"), said))
    eligible = tables.where("retrieval_eligible")
    told = (describe or descriptions.described)(eligible.select("table_id", said.alias("local"), "content", "ticker", "report_date", "section_title", "page_start", "page_end"))
    searched = eligible.join(told, "table_id").withColumns({"record_id": F.concat(F.lit("structure_aware::table::"), F.col("table_id")), "target_chunk_id": F.col("table_id"), "record_type": F.lit("table"), "text_kind": F.lit(None).cast("string"), "document": F.col("description"), "description_provenance": F.col("provenance")})
    meta = F.struct(*FILING, *SPAN, "element_ids", F.array_sort(F.array_distinct("xbrl_tags")).alias("xbrl_tags"), "section_title", F.col("element_index").alias("source_element_index"), F.col("id").alias("table_element_id"))
    store = tables.select("table_id", "table_index", "table_type", "retrieval_eligible", F.col("content").alias("document"), "cell_matrices", meta.alias("metadata"))
    return _described(texts).unionByName(_described(searched)), store


def violations(chunks: DataFrame, tables: DataFrame, count: Counter = word_tokens) -> DataFrame:
    """Rows (rule, key) of what is wrong; none for a sound corpus. One token is added to each text."""
    records = chunks.select("record_id", "record_type", "document", F.when(F.col("record_type") == "table", F.col("target_chunk_id")).alias("table_id"), (counted(count)(F.col("embedding_text")) + 1).alias("tokens"))
    return corpus_violations(records, tables.select("table_id", F.col("retrieval_eligible").alias("eligible")))


def require_none(found: DataFrame) -> None:
    """Fails where found has rows, naming a few of them."""
    if some := found.limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.key}" for r in some))


def manifest(chunks: DataFrame, tables: DataFrame, count: Counter = word_tokens) -> DataFrame:
    """Counts a filing and over all (ticker and accession_number null), with the longest embedding text in tokens."""
    keys = [F.col("metadata.ticker").alias("ticker"), F.col("metadata.accession_number").alias("accession_number")]
    is_text, is_table = F.lit(0).alias("text"), F.lit(0).alias("described")
    a = chunks.select(*keys, (F.col("record_type") == "text").cast("int").alias("text"), (F.col("record_type") == "table").cast("int").alias("described"), F.lit(0).alias("tables"), F.lit(0).alias("eligible"), (counted(count)(F.col("embedding_text")) + 1).alias("tokens"))
    b = tables.select(*keys, is_text, is_table, F.lit(1).alias("tables"), F.col("retrieval_eligible").cast("int").alias("eligible"), F.lit(None).cast("long").alias("tokens"))
    sums = [F.sum(c).alias(n) for c, n in (("text", "text_chunk_count"), ("described", "table_chunk_count"), ("tables", "table_count"), ("eligible", "retrieval_eligible_table_count"))]
    return a.unionByName(b).groupingSets([["ticker", "accession_number"], []], "ticker", "accession_number").agg(F.sum(F.col("text") + F.col("described")).alias("chunk_count"), *sums, F.max("tokens").alias("observed_max_embedding_tokens"))
