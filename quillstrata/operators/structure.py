"""The structure-aware record corpus: narrative and glossary records, table parents and their locators, and their checks.

Also records from another chunker's chunks, the context of markdown tables, canonical JSON and configuration hashes.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators import corpus, locators
from quillstrata.operators.folds import Counter, counted
from quillstrata.operators.records import word_tokens

# Token bounds of records, and what configuration hashes are of.
TEXT_TARGET, TEXT_MOST, TEXT_OVERLAP, DATA_MOST, TABLE_TEXT_MOST = 512, 1024, 64, 512, 1024
PARSER = ("sec2md", "0.1.23")
#: Names of the chunkers in configurations, where a caller gives no others; identities of a corpus made elsewhere need its own.
CHUNKERS = {"sec2md_builtin": "sec2md-built-in-v1", "structure_aware": "structure-aware-v3"}
MOST_TITLE, CONTEXT_LINES = 180, 4


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _configuration(variant: object, chunker: object) -> dict[str, object]:
    return {
        "variant": variant, "text_target_tokens": TEXT_TARGET, "text_max_tokens": TEXT_MOST, "text_overlap_tokens": TEXT_OVERLAP, "data_locator_max_tokens": DATA_MOST,
        "table_text_locator_max_tokens": TABLE_TEXT_MOST, "parser_name": PARSER[0], "parser_version": PARSER[1], "chunker_version": chunker,
    }


def config_hash(variant: str, chunker: str | None = None) -> str:
    """SHA-256 of a variant's configuration."""
    return hashlib.sha256(canonical_json(_configuration(variant, chunker or CHUNKERS[variant])).encode()).hexdigest()


def config_hashes(variant: Column, chunker: Column) -> Column:
    """config_hash of rows."""
    fields = sorted(_configuration(variant, chunker).items())
    return F.sha2(F.to_json(F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(name) for name, x in fields))), 256)


def table_blocks(text: Column) -> Column:
    """array<struct<context, lines>>: runs of lines that start with a pipe, each with the last CONTEXT_LINES other lines before it."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.rtrim(x))
    piped = F.transform(lines, lambda x: F.ltrim(x).startswith("|"))
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(piped, i) & ~F.coalesce(F.get(piped, i - 1), F.lit(False)))
    before = lambda i: F.transform(F.filter(F.slice(lines, 1, i), lambda x: ~F.ltrim(x).startswith("|") & (F.trim(x) != "")), lambda x: F.trim(x))
    after = lambda i: F.array_position(F.slice(piped, i + 1, n), False).cast("int")
    size = lambda i: F.when(after(i) > 0, after(i) - 1).otherwise(n - i)
    last = lambda a: F.slice(a, F.greatest(F.size(a) - (CONTEXT_LINES - 1), F.lit(1)), CONTEXT_LINES)
    return F.transform(starts, lambda i: F.struct(F.array_join(last(before(i)), "\n\n").alias("context"), F.transform(F.slice(lines, i + 1, size(i)), lambda x: F.trim(x)).alias("lines")))


def table_title(text: Column, with_period: Column) -> Column:
    """The last short line before the table; where with_period holds and the first header cell names a period, that is added.

    Without such a line it is the first header cell; where the two are too long together it is that cell alone.
    """
    lines = F.transform(F.split(F.substring_index(text, "|", 1), r"\R"), lambda x: F.regexp_replace(X.normalize_space(F.regexp_replace(x, "[*_#]+", "")), "[.:]+$", ""))
    prefix = F.try_element_at(F.filter(lines, lambda x: (x != "") & (F.length(x) <= MOST_TITLE)), F.lit(-1))
    cells = F.transform(F.filter(F.split(text, r"\R"), lambda x: F.ltrim(x).startswith("|")), lambda x: X.normalize_space(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|")[0]))
    header = F.get(F.filter(cells, lambda c: (c != "") & (F.length(c) <= MOST_TITLE) & ~c.rlike("^:?-+:?$")), F.lit(0))
    both = F.concat(prefix, F.lit(" — "), header)
    return F.when(with_period & prefix.isNotNull() & header.rlike(X.PERIOD), F.when(F.length(both) <= MOST_TITLE, both).otherwise(header)).otherwise(F.coalesce(prefix, header))


def records(rows: DataFrame, variant: str) -> DataFrame:
    """record_id, record_type, embedding_text, document, target_chunk_id, metadata (struct).

    rows: the filing's fields and legal_name, document, record_type, page_start, page_end, start_display_page,
    end_display_page, element_ids, xbrl_tags, child_key, retrieval_eligible, parent_id, table_element_id, section
    (a title that goes before the document's own).
    """
    item = X.sec_item(F.col("document"))
    made = rows.withColumns({"document": X.strip(F.col("document")), "element_ids": F.array_distinct("element_ids"), "xbrl_tags": F.array_sort(F.array_distinct("xbrl_tags"))})
    made = made.withColumns({
        "target_chunk_id": X.chunk_id(F.col("accession_number"), variant, F.col("child_key"), F.col("element_ids"), F.col("document")), "own_title": X.section_title(F.col("document")), "sec_item": F.concat(F.lit("Item "), item),
        "sec_item_source": F.when(item.isNull(), "unassigned").otherwise("explicit_heading_in_chunk"), "sec_item_confidence": F.when(item.isNull(), 0.0).otherwise(1.0), "parser_name": F.lit(PARSER[0]), "parser_version": F.lit(PARSER[1]), "chunk_variant": F.lit(variant), "chunker_version": F.lit(CHUNKERS[variant]),
    })
    text = X.embedding_text(F.col("ticker"), F.col("legal_name"), F.col("report_date"), F.col("record_type"), F.col("page_start"), F.col("page_end"), F.col("document"), F.col("own_title"))
    kept = [*corpus.FILING, "parser_name", "parser_version", "chunk_variant", "chunker_version", "record_type", "page_start", "page_end", "start_display_page", "end_display_page", "element_ids", "xbrl_tags", "retrieval_eligible", "sec_item", "sec_item_source", "sec_item_confidence", "parent_id", F.col("parent_id").alias("logical_table_id"), "table_element_id"]
    located = [c for c in ("table_type", "locator_scope", "matrix_index", "row_index", "column_group_index", "row_path", "cell_coordinates") if c in rows.columns]
    metadata = F.struct(*kept, F.coalesce("section", "own_title").alias("section_title"), *located)
    return made.select(F.concat_ws("::", F.lit(variant), "target_chunk_id").alias("record_id"), "record_type", text.alias("embedding_text"), "document", "target_chunk_id", metadata.alias("metadata"))


def adapted_chunks(chunks: DataFrame, filings: DataFrame) -> DataFrame:
    """Records of another chunker's chunks. chunks: accession_number, index, content, has_table, start_page, end_page,
    start_display_page, end_display_page, elements array<struct<id, kind string, tags array<string>>>.

    A chunk of tables and other elements is mixed, one of tables alone a table, any other text; blank chunks give none.
    Navigation and page furniture are records, but not eligible.
    """
    elements = F.coalesce("elements", F.array())
    other = F.exists(elements, lambda e: e["kind"] != "table")
    kind = F.when(F.col("has_table") & other, "mixed").when(F.col("has_table"), "table").otherwise("text")
    rows = chunks.withColumn("document", X.strip(F.coalesce("content", F.lit("")))).where("document <> ''").join(filings, "accession_number")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({
        "record_type": kind, "page_start": F.coalesce("start_page", F.lit(1)), "page_end": F.coalesce("end_page", "start_page", F.lit(1)), "element_ids": F.transform(elements, lambda e: e["id"].cast("string")),
        "xbrl_tags": F.flatten(F.transform(elements, lambda e: F.coalesce(e["tags"], F.array().cast("array<string>")))), "child_key": F.col("index").cast("string"),
        "retrieval_eligible": ~X.is_navigation(F.col("document")) & ~X.is_page_furniture(F.col("document")), "parent_id": none, "table_element_id": none, "section": none,
    })
    return records(rows, "sec2md_builtin")


def structure_corpus(filings: DataFrame, chunks: DataFrame, tables: DataFrame, count: Counter = word_tokens) -> tuple[DataFrame, DataFrame]:
    """(records, parents): texts and glossary entries under token bounds, locators of tables' rows, and the whole tables.

    chunks, tables: what corpus.build_corpus gives, stored and read again, so that it is not built twice.
    """
    about = filings.select("accession_number", "legal_name")
    m = lambda c: F.col(f"metadata.{c}")
    # Texts keep the identities that the corpus gave them.
    texts = chunks.where("record_type = 'text'").withColumn("record_type", F.when(m("text_kind") == "glossary", "glossary_child").otherwise("text"))
    named = F.regexp_replace("embedding_text", r"\A((?s:.*?))Evidence type: text\n", "$1Evidence type: glossary_child\n")
    texts = texts.withColumn("embedding_text", F.when(F.col("record_type") == "text", F.col("embedding_text")).otherwise(named))
    fields = lambda df: df.select("*", *(m(c).alias(c) for c in (*corpus.FILING, *corpus.SPAN, "element_ids", "xbrl_tags"))).join(about, "accession_number")
    whole = fields(tables.withColumn("table_element_id", m("table_element_id")).withColumn("place", m("source_element_index")).withColumn("section", m("section_title")))
    alone = lambda r: (F.size(M.unique(r)) == 1) & X.is_period(M.unique(r)[0])
    periods = F.aggregate("cell_matrices", F.lit(0), lambda n, x: F.greatest(n, F.size(F.filter(x, alone))))
    head = locators.locator_head(F.col("ticker"), F.col("legal_name"), F.col("report_date"), F.col("section"), table_title(F.col("document"), periods < 2), X.table_unit(F.col("document")))
    found = locators.table_locators(whole.select("table_id", "table_type", "cell_matrices", head.alias("head")), count)
    order = Window.partitionBy("table_id").orderBy("matrix", "row", "part")
    placed = found.withColumn("at", F.row_number().over(order) - 1).join(whole.drop("document", "cell_matrices", "metadata", "retrieval_eligible"), "table_id")
    rows = placed.withColumns({
        "record_type": F.lit("table_locator"), "child_key": F.concat_ws(":", F.lit("table-locator"), "place", "at"), "retrieval_eligible": F.lit(True), "parent_id": F.col("table_id"),
        "locator_scope": F.col("scope"), "matrix_index": F.col("matrix"), "row_index": F.col("row"), "column_group_index": F.col("part"),
    })
    located = records(rows, "structure_aware")
    common = ("record_id", "record_type", "embedding_text", "document", "target_chunk_id")
    place = lambda df: F.struct(*(F.col(f"metadata.{c}").alias(c) for c in ("ticker", "accession_number", "page_start", "page_end", "section_title", "retrieval_eligible")), *((F.col(f"metadata.{c}") if df is located else F.lit(None).cast(t)).alias(c) for c, t in (("parent_id", "string"), ("table_type", "string"), ("locator_scope", "string"), ("matrix_index", "int"), ("row_index", "int"))))
    parents = tables.select(F.col("table_id").alias("parent_id"), F.col("table_id").alias("logical_table_id"), "table_type", "document", "cell_matrices", "metadata")
    return texts.select(*common, place(texts).alias("metadata")).unionByName(located.select(*common, place(located).alias("metadata"))), parents


def token_limit(record_type: Column, table_type: Column, scope: Column) -> Column:
    """Row locators of data tables have DATA_MOST tokens, other locators TABLE_TEXT_MOST, texts TEXT_MOST."""
    locator = record_type == "table_locator"
    return F.when(locator & (table_type == "data_table") & (scope == "row"), DATA_MOST).when(locator, TABLE_TEXT_MOST).otherwise(TEXT_MOST)


def record_violations(rows: DataFrame, count: Counter = word_tokens) -> DataFrame:
    """Rows (rule, key): no records, repeated ids, empty documents, pages below one, eligible records beyond their limit."""
    repeated = lambda c, rule: rows.groupBy(c).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(c).alias("key"))
    bad = lambda c: F.coalesce(F.col(f"metadata.{c}") <= 0, F.lit(True))
    most = token_limit(F.col("record_type"), F.col("metadata.table_type"), F.col("metadata.locator_scope"))
    sized = rows.withColumn("__qs_tokens", counted(count)(F.col("document")))
    rules = F.array(F.when(F.coalesce(F.trim("document") == "", F.lit(True)), "empty document"), F.when(bad("page_start") | bad("page_end"), "no page"), F.when(F.coalesce(F.col("metadata.retrieval_eligible"), F.lit(False)) & (F.col("__qs_tokens") > most), "too many tokens"))
    own = sized.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), F.col("record_id").alias("key"))
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no records").alias("rule"), F.lit(None).cast("string").alias("key"))
    return own.unionByName(repeated("record_id", "repeated record id")).unionByName(repeated("target_chunk_id", "repeated target")).unionByName(none)


def corpus_violations(rows: DataFrame, parents: DataFrame, count: Counter = word_tokens) -> DataFrame:
    """record_violations and, of what is embedded: ineligible records, locators without their parent or of tables nobody searches."""
    repeated = parents.groupBy("parent_id").count().where("count > 1").select(F.lit("repeated parent").alias("rule"), F.col("parent_id").alias("key"))
    wrong = rows.where(~F.coalesce(F.col("metadata.retrieval_eligible"), F.lit(False)) | (F.col("record_type") == "table_parent")).select(F.lit("not for retrieval").alias("rule"), F.col("record_id").alias("key"))
    located = rows.where("record_type = 'table_locator'").withColumn("parent_id", F.col("metadata.parent_id"))
    orphans = located.join(parents.select("parent_id").distinct(), "parent_id", "left_anti").select(F.lit("no table parent").alias("rule"), F.col("record_id").alias("key"))
    layout = located.where(F.col("metadata.table_type").isin(*corpus.NOT_SEARCHED)).select(F.lit("locator of a layout table").alias("rule"), F.col("record_id").alias("key"))
    return record_violations(rows, count).unionByName(repeated).unionByName(wrong).unionByName(orphans).unionByName(layout)
